"""Gates inside a plan: rows that break a rule fail the job and are named, rows that keep it cost no extra pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from melodyspark.operators.edits import apply_edits
from melodyspark.operators.intervals import interval_join


def must(ok: Column, message: Column) -> Column:
    """A condition that is true where ``ok`` is, and fails the job with ``message`` at any other row."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(message))


def guarded(result: DataFrame, rows: DataFrame, ok: Column, message: Column) -> DataFrame:
    """``result``, in one plan with the check that ``ok`` holds for all ``rows``; the check itself adds no rows."""
    broken = rows.where(~must(ok, message))
    nothing = broken.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema.fields])
    return result.unionByName(nothing)


def counted(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with metrics that are gathered while whatever job reads them runs."""
    seen = Observation(name)
    return rows.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen


def apply_strictly(notes: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """``edits.apply_edits`` for located edits, each of which must match exactly one note that still has its pitch: a stale one fails the job by name.

    The check stands beside the edits and not before them: a filter on the way could let Catalyst turn the outer join
    of edits and notes into an inner one, and stale edits would vanish unseen.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    message = F.concat(F.lit("stale edit "), text("edit_id"), F.lit(": "), text("matches"), F.lit(" notes at "), text("onset"), F.lit(" s, pitch expected "), text("old"))
    return guarded(apply_edits(notes, located.select("frame_id", "op", "new", "at", "stale"), key), located, ~F.col("stale"), message)


def leave_out(notes: DataFrame, stretches: DataFrame, keys: list[str], note: str, stretch: str, bucket: float = 5.0) -> DataFrame:
    """Notes outside the left-out stretches: one that begins, or has its middle, inside is dropped.

    Notes: keys, ``note``, onset, end. Stretches: keys, ``stretch``, start, end, reason. A stretch in which no note begins is
    stale: it fails the job and is named. Each note meets only stretches of its bucket.
    """
    points = notes.select(*keys, note, F.explode(F.array(F.struct(F.col("onset").alias("at"), F.lit(True).alias("begins")), F.struct(((F.col("onset") + F.col("end")) / 2).alias("at"), F.lit(False).alias("begins")))).alias("p"))
    points = points.select(*keys, note, F.col("p.at").alias("_at"), F.col("p.begins").alias("_begins"))
    hit = interval_join(points, stretches.select(*keys, stretch, F.col("start").alias("_from"), F.col("end").alias("_to")), keys, "_at", "_from", "_to", bucket)
    kept = notes.join(hit.select(*keys, note).distinct(), [*keys, note], "left_anti")
    used = stretches.join(hit.where("_begins").groupBy(*keys, stretch).agg(F.count(F.lit(1)).alias("_n")), [*keys, stretch], "left")
    message = F.concat(F.lit("stale exclusion "), F.col(stretch).cast("string"), F.lit(": no note begins in "), F.col("start").cast("string"), F.lit(" - "), F.col("end").cast("string"), F.lit(" s"))
    return guarded(kept, used, F.coalesce("_n", F.lit(0)) > 0, message)
