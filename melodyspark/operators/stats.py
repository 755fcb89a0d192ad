"""Aggregates over frames and notes of a recording."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.functions.scalars import MAJOR_STEPS, literal_array

#: weight of each pitch class in a major key, from the tonic up (fixed values)
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]


def detect_key(frames: DataFrame, key: str = "recording_id", midi: str = "midi", voiced: str = "voiced") -> DataFrame:
    """The major tonic whose scale holds most voiced frames; the lowest of equals, 0 if nothing is voiced.

    Counts are combined before any row is multiplied: each pitch class then votes for the seven
    tonics whose scale holds it.
    """
    pc = F.pmod(F.rint(midi).cast("int"), F.lit(12))
    counts = frames.groupBy(key, F.when(F.col(voiced), pc).alias("pc")).agg(F.count(F.lit(1)).alias("n"))
    votes = counts.withColumn("tonic", F.explode_outer(F.transform(literal_array(MAJOR_STEPS), lambda s: F.pmod(F.col("pc") - s, F.lit(12)))))
    scores = votes.groupBy(key, "tonic").agg(F.sum("n").alias("score")).withColumn("score", F.when(F.col("tonic").isNotNull(), F.col("score")))
    return scores.groupBy(key).agg(F.coalesce(F.max_by("tonic", F.struct(F.coalesce("score", F.lit(-1)), -F.col("tonic"))), F.lit(0)).alias("tonic"))


def key_by_profile(notes: DataFrame, key: str, bonus: float = 0.25) -> DataFrame:
    """The tonic whose profile correlates best with duration by pitch class; the last note's class gets a bonus."""
    pc = F.pmod("midi", F.lit(12))
    total = notes.withColumn("pc", pc).groupBy(key).agg(
        *[F.sum(F.when(F.col("pc") == k, F.col("end") - F.col("onset")).otherwise(0.0)).alias(f"d{k}") for k in range(12)],
        F.max_by("pc", F.struct("onset", "frame_id")).alias("last"),
    )
    hist = F.array(*[F.col(f"d{k}") for k in range(12)])
    spread = total.select(key, "last", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tonic"), hist.alias("h")).select(key, "last", "tonic", F.posexplode("h").alias("pc", "d"))
    weight = F.element_at(literal_array(MAJOR_PROFILE), F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)) + 1)
    score = F.round(F.coalesce(F.corr("d", weight), F.lit(0.0)) + F.when(F.first("last") == F.col("tonic"), bonus).otherwise(0.0), 9)
    scored = spread.groupBy(key, "tonic").agg(score.alias("score"))
    return scored.groupBy(key).agg(F.max_by("tonic", F.struct("score", -F.col("tonic"))).alias("tonic"))


def tuning_offset(frames: DataFrame, key: str = "recording_id") -> DataFrame:
    """Circular mean of how far voiced pitches lie from whole semitones."""
    a = F.col("midi") * (2 * math.pi)
    return frames.where("voiced").groupBy(key).agg((F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) / (2 * math.pi)).alias("offset"))


def gate_by_percentile(frames: DataFrame, key: str, share: float, floor: float, low: float, high: float, pct: float = 0.95) -> DataFrame:
    """Frames with ``loud``: louder than a share of the recording's own percentile and a floor, pitch in range."""
    p = frames.groupBy(key).agg(F.percentile("rms", pct).alias("p95"))
    loud = (F.col("rms") > F.greatest(F.lit(floor), share * F.col("p95"))) & (F.col("midi") > low) & (F.col("midi") < high)
    return frames.join(p, key).withColumn("loud", loud)


def reading(points: DataFrame, keys: list[str], near: float = 0.30, support: float = 0.40) -> DataFrame:
    """From frames joined to intervals: median, voiced frames, coverage, and shares near the median and near a whole pitch."""
    m = F.when(F.col("voiced"), F.col("midi"))
    w = Window.partitionBy(*keys)
    with_median = points.withColumn("_med", F.median(m).over(w))
    return with_median.groupBy(*keys).agg(
        F.first("_med").alias("median"),
        F.count(m).alias("frames"),
        (F.count(m) / F.count(F.lit(1))).alias("coverage"),
        F.avg((F.abs(m - F.col("_med")) <= near).cast("int")).alias("stable"),
        F.avg((F.abs(m - F.rint("_med")) <= support).cast("int")).alias("support"),
    )


def majority(votes: DataFrame, keys: list[str], value: str, least: int = 2, share: float = 0.6) -> DataFrame:
    """The value with most votes (the lowest of equals) where at least ``least`` and ``share`` of all agree."""
    n = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("b"), F.sum("n").alias("all"))
    return best.where((F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("all"))).select(*keys, (-F.col("b.v")).cast("int").alias(value), F.col("b.n").alias("votes"))


def index_quantile(values: Column, share: float) -> Column:
    """Element floor(share * n) of the sorted values: an index, not an interpolation."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, F.least(F.floor(F.lit(share) * F.size(ordered)).cast("int") + 1, F.size(ordered)))


def two_gains(df: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """Least-squares gains of y on a and b without intercept, and the relative residual, from moments."""
    s = lambda p, q: F.sum(F.col(p) * F.col(q))
    m = df.groupBy(*keys).agg(s(a, a).alias("aa"), s(a, b).alias("ab"), s(b, b).alias("bb"), s(a, y).alias("ay"), s(b, y).alias("by"), s(y, y).alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    m = m.where(F.abs(det) > 1e-9).withColumn("ga", (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det).withColumn("gb", (F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det)
    left = F.col("yy") - F.col("ga") * F.col("ay") - F.col("gb") * F.col("by")
    return m.select(*keys, "ga", "gb", F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("yy")).alias("residual"))
