"""Melody tables from the driver's star schema, with explicit types.

Times are seconds from the start of a recording; missing pitch is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melodyspark.sources.scratch import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_of(events: DataFrame) -> DataFrame:
    """Pitch frames: recording_id, frame_id, t, midi, voiced, rms, event_type."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    hundredths = F.round(F.col("value") * 100).cast("bigint")
    return events.select(
        F.col("user_id").alias("recording_id"),
        F.col("event_id").alias("frame_id"),
        (micros / F.lit(1e6) / F.lit(21600.0)).alias("t"),
        (45 + (hundredths % 4000) / F.lit(100.0)).alias("midi"),
        (F.col("event_type") != "error").alias("voiced"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("rms"),
        "event_type",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(table(spark, sf_dir, "events"))


def by_time(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("recording_id",))).orderBy("t", "frame_id")


def notes_of(frames: DataFrame) -> DataFrame:
    """Notes: recording_id, frame_id, onset, end, midi, median, lyric, rms. A note ends where the next begins."""
    voiced = frames.where("voiced")
    end = F.least(F.col("t") + 0.2 + F.col("rms"), F.lead("t").over(by_time()))
    lyric = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return voiced.select("recording_id", "frame_id", F.col("t").alias("onset"), end.alias("end"), F.rint("midi").cast("int").alias("midi"), F.col("midi").alias("median"), lyric.alias("lyric"), "rms")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_of(frames(spark, sf_dir))


def steps(frames: DataFrame, width: float, name: str) -> DataFrame:
    """recording_id and numbers from 0 to that of the step of ``width`` seconds that holds the recording's last frame."""
    last = frames.groupBy("recording_id").agg(F.greatest(F.lit(0), F.floor(F.max("t") / width).cast("int")).alias("last"))
    return last.select("recording_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias(name))


def beats(frames: DataFrame) -> DataFrame:
    """One beat a second for every recording, up to its last frame: recording_id, beat, t_start."""
    return steps(frames, 1.0, "beat").select("recording_id", "beat", F.col("beat").cast("double").alias("t_start"))


def lengths(frames: DataFrame, tail: float = 2.0) -> DataFrame:
    """recording_id, length: ``tail`` seconds after the last frame, so that the last note has ended."""
    return frames.groupBy("recording_id").agg((F.max("t") + tail).alias("length"))


def sections(notes: DataFrame, width: float = 20.0) -> DataFrame:
    """Sections of equal width that hold notes: recording_id, section, start, end."""
    s = F.floor(F.col("onset") / width)
    return notes.select("recording_id", s.cast("int").alias("section")).distinct().select("recording_id", "section", (F.col("section") * width).alias("start"), ((F.col("section") + 1) * width).alias("end"))


def with_section(notes: DataFrame) -> DataFrame:
    """Notes with section (20 s) and line (5 s)."""
    return notes.withColumn("section", F.floor(F.col("onset") / 20).cast("int")).withColumn("line", F.floor(F.col("onset") / 5).cast("int"))


def readings(notes: DataFrame) -> DataFrame:
    """Three independent readings of every note: recording_id, frame_id, reader, median."""
    third = F.when(F.col("frame_id") % 7 == 0, F.col("median") + 12).otherwise(F.col("median") + 0.05)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("reader"), m.alias("median")) for n, m in (("a", F.col("median")), ("b", F.col("median") + 0.1), ("c", third))]))
    return notes.select("recording_id", "frame_id", each.alias("r")).select("recording_id", "frame_id", "r.reader", F.col("r.median").alias("median"))


def charts(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An old and a new version of the notes: the old lacks some rows, the new has some pitches changed."""
    old = notes.where(F.col("frame_id") % 11 != 0)
    new = notes.withColumn("midi", F.when(F.col("frame_id") % 13 == 0, F.col("midi") + 1).otherwise(F.col("midi")))
    return old, new


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript words of every document: recording_id, pos, word, start, end, p, segment."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("q"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "[ \\n]+")).alias("pos", "word"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("recording_id"), "pos", "word", (F.col("pos") * 0.4).alias("start"), (F.col("pos") * 0.4 + 0.3).alias("end"),
        F.coalesce("q", F.lit(0.5)).alias("p"), F.floor(F.col("pos") / 12).cast("int").alias("segment"),
    )


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score events of every customer: song, seq, midi, dur, tie."""
    at = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("song"), F.row_number().over(at).alias("seq"), (48 + k % 24).cast("int").alias("midi"),
        (1 + k % 3).cast("int").alias("dur"), (k % 5 == 0).alias("tie"), "o_orderkey",
    )


def rows_of(column: str) -> Column:
    """Rows of a text column split at line feeds."""
    return F.split(F.col(column), "\n")
