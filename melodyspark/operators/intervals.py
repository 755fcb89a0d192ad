"""Joins of points and intervals on a key, bucketed so that no recording is compared all against all.

Intervals are put under every bucket of width ``bucket`` that they touch, points under one; the
equi-join on key and bucket is what shuffles, the exact predicate is checked after it. A long
recording spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width)))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, bucket: float, how: str = "inner") -> DataFrame:
    """Points with start <= t < end of the same keys. ``how``: inner, or right to keep intervals without points."""
    p = points.withColumn("_b", F.floor(F.col(t) / bucket))
    spread = intervals.withColumn("_b", F.explode(_buckets(F.col(start), F.col(end), bucket)))
    inside = (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))
    hit = p.join(spread, [*keys, "_b"]).where(inside).drop("_b")
    if how == "inner":
        return hit
    missed = intervals.join(hit.select(*intervals.columns).distinct(), intervals.columns, "left_anti")
    return hit.unionByName(missed, allowMissingColumns=True)


def inset(start: Column, end: Column, head: float = 0.05, tail: float = 0.04, share: float = 0.2) -> tuple[Column, Column]:
    """The interior of a note: a part of it, at most ``head`` and ``tail`` seconds, is left off at its ends."""
    width = end - start
    return start + F.least(F.lit(head), width * share), end - F.least(F.lit(tail), width * share)


def outside(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, bucket: float, id_cols: list[str]) -> DataFrame:
    """Points that lie in no interval."""
    inside = interval_join(points.select(*id_cols, *[k for k in keys if k not in id_cols], t), intervals, keys, t, start, end, bucket)
    return points.join(inside.select(*id_cols).distinct(), id_cols, "left_anti")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], slack: float, bucket: float) -> DataFrame:
    """Intervals (lo, hi) of left that overlap intervals (start, end) of right within ``slack``; each pair once."""
    a = left.withColumn("_b", F.explode(_buckets(F.col("lo") - slack, F.col("hi") + slack, bucket)))
    b = right.withColumn("_b", F.explode(_buckets(F.col("start"), F.col("end"), bucket)))
    met = (F.col("hi") > F.col("start") - slack) & (F.col("lo") < F.col("end") + slack)
    # the first bucket that both touch stands for the pair
    first = F.greatest(F.floor((F.col("lo") - slack) / bucket), F.floor(F.col("start") / bucket))
    return a.join(b, [*keys, "_b"]).where(met & (F.col("_b") == first)).drop("_b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t_left: str, t_right: str, order: str) -> DataFrame:
    """For each left row the time of the nearest right row of its keys, as-of both ways; of two as near, the earlier.

    One sort of both sides by key and time; nothing is multiplied. ``order`` tells left rows apart.
    """
    a = left.select(*keys, F.col(t_left).alias("_t"), F.lit(None).cast("double").alias("_r"), F.col(order).alias("_o"))
    b = right.select(*keys, F.col(t_right).alias("_t"), F.col(t_right).alias("_r"), F.lit(None).cast(left.schema[order].dataType).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_t", F.col("_r").isNull(), "_o")
    both = a.unionByName(b).withColumn("_before", F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_after", F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("_o is not null")
    pick = F.when(F.col("_after").isNull() | (F.col("_t") - F.col("_before") <= F.col("_after") - F.col("_t")), F.col("_before")).otherwise(F.col("_after"))
    return both.select(*keys, F.col("_o").alias(order), F.coalesce(pick, "_before").alias("nearest"))


def lagged_pairs(series: DataFrame, keys: list[str], index: str, x: str, y: str, reach: int) -> DataFrame:
    """x at i against y at i - lag for every lag within ``reach``: keys, lag, x, y."""
    lags = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    a = series.select(*keys, F.col(index).alias("_i"), F.col(x).alias("x")).withColumn("lag", lags).withColumn("_j", F.col("_i") - F.col("lag"))
    b = series.select(*keys, F.col(index).alias("_j"), F.col(y).alias("y"))
    return a.join(b, [*keys, "_j"]).select(*keys, "lag", "x", "y")
