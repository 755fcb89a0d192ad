"""Reviewed corrections: every edit must find exactly the row it was written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def locate(edits: DataFrame, notes: DataFrame, key: str, tolerance: float = 0.006) -> DataFrame:
    """Edits (edit_id, key, onset, old) with the notes they match: edit_id, matches, frame_id, stale.

    An edit is stale unless exactly one note of its recording starts within ``tolerance`` and still
    has the pitch that the edit expects. Onsets are bucketed, so the join is on equal keys.
    """
    width = 2 * tolerance
    e = edits.withColumn("_b", F.explode(F.array(*[F.floor(F.col("onset") / width) + d for d in (-1, 0, 1)])))
    n = notes.select(key, "frame_id", "midi", F.col("onset").alias("_at"), F.floor(F.col("onset") / width).alias("_b"))
    hit = e.join(n, [key, "_b"]).where(F.abs(F.col("_at") - F.col("onset")) < tolerance)
    found = hit.groupBy("edit_id").agg(F.count(F.lit(1)).alias("matches"), F.min("frame_id").alias("frame_id"), F.min("midi").alias("actual"))
    out = edits.join(found, "edit_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("stale", (F.col("matches") != 1) | ~F.col("actual").eqNullSafe(F.col("old")))


def apply_edits(notes: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """Notes after the edits that are not stale: pitch set, split in two, joined with the next, or deleted.

    ``located``: frame_id, op (midi, split, join, delete), new, at. A split gives the second piece
    the new pitch if there is one; a joined note takes the end of the note after it, which goes.
    """
    good = located.where(~F.col("stale")).select("frame_id", "op", "new", "at")
    x = notes.join(good, "frame_id", "left")
    w = Window.partitionBy(key).orderBy("onset", "frame_id")
    x = x.withColumn("_next_end", F.lead("end").over(w)).withColumn("_prev", F.lag("op").over(w))
    # a note that the one before has swallowed is gone
    x = x.where(~F.col("_prev").eqNullSafe(F.lit("join")) & ~F.col("op").eqNullSafe(F.lit("delete")))
    split, joined = F.col("op").eqNullSafe(F.lit("split")), F.col("op").eqNullSafe(F.lit("join")) & F.col("_next_end").isNotNull()
    pitch = F.when(F.col("op") == "midi", F.col("new")).otherwise(F.col("midi"))
    piece = lambda part, a, b, m: F.struct(F.lit(part).alias("part"), a.alias("onset"), b.alias("end"), m.alias("midi"))
    whole = F.array(piece(0, F.col("onset"), F.when(joined, F.col("_next_end")).otherwise(F.col("end")), pitch))
    two = F.array(piece(0, F.col("onset"), F.col("at"), F.col("midi")), piece(1, F.col("at"), F.col("end"), F.coalesce("new", "midi")))
    return x.select(key, "frame_id", F.explode(F.when(split, two).otherwise(whole)).alias("p")).select(key, "frame_id", "p.*")
