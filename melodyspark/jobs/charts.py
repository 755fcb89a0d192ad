"""Composed jobs: a chart from notes and words, and the audit of charts against their recordings.

Both keep ``recording_id`` as the key from one step to the next, so a recording's rows stay where its first shuffle put them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.jobs.registry import query
from melodyspark.operators import audit as U
from melodyspark.operators import charting as C
from melodyspark.operators import sequences as Q
from melodyspark.operators import stats as A
from melodyspark.operators import voice as V
from melodyspark.sources import files as D
from melodyspark.sources import tables as T

KEY, ORDER = "recording_id", ["onset", "note"]


def chart(notes: DataFrame, units: DataFrame) -> DataFrame:
    """Charted notes: recording_id, section, i, id, note, onset, end, midi, lyric, lane, phrase, tonic.

    Notes: recording_id, section, line, line_start, note, onset, end, midi. Units: recording_id, section, unit, _order, text, start, end, weak, line_start.
    """
    placed = C.place_units(notes.select(KEY, "section", "note", "onset", "end", "midi"), units.drop("text"), [KEY, "section"], "note", "unit")
    texts = placed.where("note is not null").join(units.select(KEY, "section", "unit", "_order", "text"), [KEY, "section", "unit"])
    lyric = texts.groupBy("note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "text"))), lambda x: x["text"]), " ").alias("lyric"))
    tonic = A.key_by_profile(notes.withColumn("frame_id", F.col("note")), KEY).select(KEY, "tonic")
    n = notes.join(lyric, "note", "left").join(tonic, KEY).withColumn("lyric", F.coalesce("lyric", F.lit("")))
    n = n.withColumn("line", F.when(F.col("lyric") == "", -1).otherwise(F.col("line")))

    def number(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"note": p["note"], "phrase": Q.phrases(*(p[c].to_numpy() for c in ("section", "line", "line_start", "onset", "end")))})

    phrases = Q.by_key(n.select(KEY, "note", "section", "line", "line_start", "onset", "end"), [KEY], ORDER, number, "note long, phrase int")
    n = n.join(phrases, "note").withColumn("i", (F.row_number().over(Window.partitionBy(KEY).orderBy(*ORDER)) - 1).cast("int"))
    n = n.withColumn("_id", S.centisecond_id(F.col(KEY), F.col("section"), F.col("onset")))
    again = F.row_number().over(Window.partitionBy("_id").orderBy("note")) > 1
    one_id = F.concat("_id", F.when(again, "b").otherwise("")).alias("id")
    lane = S.round_to(S.lane(F.col("midi") - 60 - F.col("tonic")), 3).alias("lane")
    return n.select(KEY, "section", "i", one_id, "note", "onset", "end", "midi", "lyric", lane, "phrase", "tonic")


def audit(frames: DataFrame, notes: DataFrame, attacks: DataFrame, words: DataFrame, least: int = 5, gap: float = 0.10, merge: float = 1.5, span: int = 30) -> DataFrame:
    """One row a recording: how its chart agrees with the voice, and what asks for a review.

    Frames: recording_id, frame_id, t, midi, voiced, rms. Notes: recording_id, section, note, onset, end, midi, lyric. Attacks:
    recording_id, at. Words: recording_id, t.
    """
    spans = notes.select(KEY, "note", F.col("onset").alias("start"), "end", F.col("midi").alias("expected"))
    match = V.chart_match(frames, spans, [KEY], "note", least=least)
    late = U.nearest_attack(notes, attacks, [KEY], "note").where("late").join(notes.select("note", KEY), "note").groupBy(KEY).agg(F.count(F.lit(1)).alias("late_attacks"))
    voice = V.voiced_sections(frames, [KEY], ["t", "frame_id"], gap=gap, merge=merge).groupBy(KEY).agg(F.count(F.lit(1)).alias("acoustic_sections"), F.min("start").alias("voice_start"), F.max("end").alias("voice_end"))
    first = V.first_voice(frames, [KEY], ["t", "frame_id"], span=span)
    quality = U.section_quality(notes, [KEY, "section"], ["onset", "note"], F.lit(False)).groupBy(KEY).agg(F.count_if(F.col("quality") == "pitch-unreliable").alias("unreliable"), F.count_if(F.col("quality") == "lyrics-sparse").alias("sparse"))
    cut = notes.groupBy(KEY).agg(F.max("end").alias("cut"))
    summary = U.song_summary(notes, words, [KEY], {"unlabelled": F.col("lyric") == ""}, cut).drop("notes")
    out = match
    for part in (late, voice, first, quality, summary):
        out = out.join(part, KEY, "left")
    return out.withColumn("late_attacks", F.coalesce("late_attacks", F.lit(0)))


@query()
def chart_build(spark: SparkSession, sf: str) -> DataFrame:
    """Charts of all recordings as nested documents, with their key and number of phrases."""
    n = T.with_section(T.notes(spark, sf)).withColumnRenamed("frame_id", "note").withColumn("line_start", F.col("line") % 2 == 0)
    w = Window.partitionBy(KEY, "section").orderBy(*ORDER)
    at = F.when(F.col("lyric") != "", F.col("onset") + 0.1)
    units = n.select(KEY, "section", F.col("note").alias("unit"), F.row_number().over(w).alias("_order"), F.coalesce(F.nullif("lyric", F.lit("")), F.lit("la")).alias("text"), at.alias("start"), (at + 0.2).alias("end"), at.isNull().alias("weak"), F.coalesce(F.col("line") != F.lag("line").over(w), F.lit(True)).alias("line_start"))
    charted = chart(n.select(KEY, "section", "line", "line_start", "note", "onset", "end", "midi"), units)
    facts = charted.groupBy(F.col(KEY).cast("string").alias("key")).agg(F.max("tonic").alias("tonic"), F.count_distinct("phrase").alias("phrases"), F.count_if(F.col("lyric") != "").alias("labelled"))
    return D.chart_documents(charted, KEY).join(facts, "key")


@query()
def catalogue_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every recording's chart against its own voice; one voiced frame is enough here, and gaps are wider, as frames are sparse."""
    f = T.frames(spark, sf)
    n = T.with_section(T.notes_of(f)).withColumnRenamed("frame_id", "note")
    attacks = f.where(~F.col("voiced")).select(KEY, F.col("t").alias("at"))
    return audit(f, n, attacks, f.select(KEY, "t"), least=1, gap=1.5, merge=4.0, span=10)
