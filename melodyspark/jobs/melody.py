"""Melody transcription: from pitch frames and beats to merged notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.jobs.registry import query
from melodyspark.jobs.sql import case_list, duck, r
from melodyspark.operators.intervals import interval_join
from melodyspark.operators.islands import changed, islands
from melodyspark.operators.stats import detect_key
from melodyspark.sources import tables as T


def beat_medians(frames: DataFrame, beats: DataFrame) -> DataFrame:
    """Median frequency of the voiced frames inside each beat; beats without any stay, with null."""
    hz = frames.where("voiced").select("recording_id", "t", S.midi_to_hz(F.col("midi")).alias("hz"))
    spans = beats.withColumn("t_end", F.col("t_start") + 1.0)
    # frames outside every beat fall away; beats of one second are their own buckets
    hit = interval_join(hz, spans, ["recording_id"], "t", "t_start", "t_end", 1.0).groupBy("recording_id", "beat").agg(F.median("hz").alias("hz"), F.count(F.lit(1)).alias("frames"))
    return beats.join(hit, ["recording_id", "beat"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))


def transcribe(frames: DataFrame, beats: DataFrame) -> DataFrame:
    """recording_id, beat, beats, note, degree, ratio: equal consecutive notes merged."""
    tonic = detect_key(frames)
    heard = beat_medians(frames, beats).join(tonic, "recording_id")
    snapped = heard.withColumn("snapped", F.when(F.col("hz").isNotNull(), S.snap_to_scale(S.hz_to_midi(F.col("hz")), F.col("tonic"))))
    degree = S.scale_degree(F.col("snapped"), F.col("tonic"))
    rest = F.col("snapped").isNull()
    named = snapped.select(
        "recording_id", "beat",
        F.when(rest, "REST").otherwise(S.note_name(F.col("snapped"))).alias("note"),
        F.when(rest, "REST").otherwise(S.degree_name(degree)).alias("degree"),
        F.when(rest, -1.0).otherwise(S.degree_ratio(degree)).alias("ratio"),
    )
    runs = islands(named, ["recording_id"], ["beat"], changed(["recording_id"], ["beat"], "note"))
    return runs.groupBy("recording_id", "grp").agg(F.min("beat").alias("beat"), F.count(F.lit(1)).alias("beats"), F.first("note").alias("note"), F.first("degree").alias("degree"), F.first("ratio").alias("ratio")).drop("grp")


KEY_SQL = {
    "chroma": "SELECT recording_id, (round_even(midi, 0)::INT % 12) AS pc, count(*) AS n FROM frames WHERE voiced GROUP BY ALL",
    "scored": "SELECT recording_id, tonic::INT AS tonic, sum(n) AS s FROM chroma, range(12) x(tonic), (VALUES (0),(2),(4),(5),(7),(9),(11)) v(st) WHERE pc = (tonic + st) % 12 GROUP BY ALL",
    "keys": "SELECT recording_id, coalesce(tonic, 0)::INT AS tonic FROM (SELECT DISTINCT recording_id FROM frames) LEFT JOIN (SELECT recording_id, tonic FROM scored QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY s DESC, tonic) = 1) USING (recording_id)",
}
BEAT_SQL = {
    "heard": "SELECT recording_id, floor(t)::INT AS beat, median(440 * pow(2.0, (midi - 69) / 12)) AS hz, count(*) AS n FROM frames WHERE voiced AND t >= 0 GROUP BY ALL",
    "grid": "SELECT b.recording_id, b.beat, hz, coalesce(n, 0) AS frames FROM beats b LEFT JOIN heard USING (recording_id, beat)",
}


@query(duck("frames", more=KEY_SQL, body="SELECT recording_id, tonic FROM keys"))
def a1_detect_key(spark: SparkSession, sf: str) -> DataFrame:
    return detect_key(T.frames(spark, sf))


@query(duck("frames", "beats", more=BEAT_SQL, body=f"SELECT recording_id, beat, {r('hz', 4)} AS hz, frames FROM grid"))
def j1_a3_beat_medians(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    return beat_medians(f, T.beats(f)).select("recording_id", "beat", S.round_to(F.col("hz"), 4).alias("hz"), "frames")


_D = "d"
_STAGES = {
    "m": "SELECT g.recording_id, beat, tonic, round_even(12 * log2(hz / 440.0) + 69, 0)::INT AS m FROM grid g JOIN keys USING (recording_id)",
    "c": """SELECT *, m - m % 12 + (SELECT x.pc FROM (SELECT (tonic + s) % 12 AS pc, i FROM (VALUES (0,0),(2,1),(4,2),(5,3),(7,4),(9,5),(11,6)) v(s, i)) x
        ORDER BY least(abs(x.pc - m % 12), 12 - abs(x.pc - m % 12)), x.i LIMIT 1) AS q FROM m""",
    "z": "SELECT recording_id, beat, tonic, CASE WHEN abs(q - m) > 6 THEN CASE WHEN q < m THEN q + 12 ELSE q - 12 END ELSE q END AS midi FROM c",
    "nn": f"""SELECT recording_id, beat, CASE WHEN midi IS NULL THEN 'REST' ELSE {case_list(S.NOTE_NAMES, 'midi % 12')} || (floor(midi / 12.0)::INT - 1) END AS note,
        CASE WHEN midi IS NULL THEN 'REST' ELSE {case_list(S.DEGREE_NAMES, _D)} END AS degree, CASE WHEN midi IS NULL THEN -1.0::DOUBLE ELSE {case_list(S.DEGREE_RATIOS, _D)} END AS ratio
        FROM (SELECT *, list_position([0,2,4,5,7,9,11], (midi - tonic + 120) % 12) - 1 AS d FROM z)""",
    "rr": "SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY beat) AS grp FROM (SELECT *, CASE WHEN note = lag(note) OVER (PARTITION BY recording_id ORDER BY beat) THEN 0 ELSE 1 END AS new FROM nn)",
}


@query(duck("frames", "beats", more={**KEY_SQL, **BEAT_SQL, **_STAGES}, body="SELECT recording_id, min(beat)::INT AS beat, count(*) AS beats, first(note) AS note, first(degree) AS degree, first(ratio) AS ratio FROM rr GROUP BY recording_id, grp"))
def melody_transcription(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    return transcribe(f, T.beats(f))
