"""Gaps and islands over time-ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str = "grp") -> DataFrame:
    """Number runs of rows from 1: ``starts`` (null counts as true) is true on the first row of each run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int"))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def after_gap(keys: list[str], order: list[str], start: str, end: str, gap: float) -> Column:
    """True where silence of at least ``gap`` lies before a row, measured from the end of the row before."""
    return F.col(start) - F.lag(end).over(Window.partitionBy(*keys).orderBy(*order)) >= gap


def changed(keys: list[str], order: list[str], *values: str) -> Column:
    """True where any value differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = F.lag(F.lit(1)).over(w).isNull()
    for v in values:
        out = out | ~F.lag(v).over(w).eqNullSafe(F.col(v))
    return out


def stretches(notes: DataFrame, gap: float, keys: list[str], order: list[str]) -> DataFrame:
    """Sung stretches split at silences: keys, grp, start, end, notes."""
    grouped = islands(notes, keys, order, after_gap(keys, order, "onset", "end", gap))
    return grouped.groupBy(*keys, "grp").agg(F.min("onset").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("notes"))


def fill_linear(df: DataFrame, keys: list[str], order: str, value: str) -> Column:
    """The value, or a point on the line between the known values around it by row position; null at open ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.row_number().over(w)
    known = F.when(F.col(value).isNotNull(), F.struct(at.alias("i"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    between = before["v"] + (after["v"] - before["v"]) * (at - before["i"]) / (after["i"] - before["i"])
    return F.coalesce(F.col(value), between)
