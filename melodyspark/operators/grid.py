"""The time shift and transposition at which a chart fits its recording best."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melodyspark.operators.intervals import interval_join


def sliding_medians(t: np.ndarray, midi: np.ndarray, voiced: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows that are not silent, and the medians of their voiced frames. Windows (start <= t < end) move forward only.

    A window is silent with fewer than ``least`` voiced frames (one at least) or than ``share`` of its frames.
    """
    order = np.argsort(t, kind="stable")
    t, midi, voiced = t[order], np.asarray(midi, float)[order], np.asarray(voiced, bool)[order]
    every = np.searchsorted(t, ends) - np.searchsorted(t, starts)
    at, pitch = t[voiced], midi[voiced].tolist()
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    held: list[float] = []
    i = j = 0
    which, out = [], []
    for k, (lo, hi, n) in enumerate(zip(first.tolist(), last.tolist(), every.tolist(), strict=True)):
        while j < hi:
            insort(held, pitch[j])
            j += 1
        while i < lo:
            del held[bisect_left(held, pitch[i])]
            i += 1
        m = len(held)
        if m and m >= least and m >= n * share:
            which.append(k)
            out.append((held[(m - 1) // 2] + held[m // 2]) / 2)
    return np.array(which, int), np.array(out, float)


def best_shift(
    frames: DataFrame, chart: DataFrame, keys: list[str], note: str, bucket: float = 10.0, steps: int = 60, step: float = 0.05,
    lowest: int = -6, highest: int = 5, least: int = 5, share: float = 0.3, tolerance: float = 0.6,
) -> DataFrame:
    """shift, transpose and hits of every chart over ``2 * steps + 1`` shifts and all transpositions.

    Frames: keys, t, midi, voiced; chart: keys, ``note``, start, end, expected. A note is hit where the
    median of its voiced frames is within ``tolerance`` of the expected pitch, octaves aside; it is
    silent with fewer than ``least`` of them or than ``share`` of its frames. No shift wins ties, then
    the first of the grid.

    Frames meet a note once, over all the time its shifts reach; the window of a note then slides over them from
    shift to shift, each frame entering and leaving once, and only hits are counted, so no shuffle grows with the grid.
    """
    far = steps * step + step
    wide = chart.select(*keys, note, "start", "end", "expected", (F.col("start") - far).alias("_a"), (F.col("end") + far).alias("_z"))
    f = frames.select(*keys, "t", F.struct("t", F.col("midi").cast("double").alias("m"), F.coalesce("voiced", F.lit(False)).alias("v")).alias("_f"))
    near = interval_join(f, wide, keys, "t", "_a", "_z", bucket).groupBy(*keys, note, "start", "end", "expected").agg(F.collect_list("_f").alias("_f"))
    near = near.select(*keys, F.col("start").cast("double"), F.col("end").cast("double"), F.col("expected").cast("double"), *[F.col(f"_f.{c}").alias(f"_{c}") for c in "tmv"])
    shifts, moves = np.arange(-steps, steps + 1), np.arange(lowest, highest + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for r in p.to_dict("records"):
                k, middle = sliding_medians(r["_t"], r["_m"], r["_v"], r["start"] + shifts * step, r["end"] + shifts * step, least, share)
                away = np.mod(middle[:, None] - r["expected"] - moves[None, :] + 6, 12) - 6
                at, tr = np.nonzero(np.abs(away) <= tolerance)
                yield pd.DataFrame({**{c: [r[c]] * len(at) for c in keys}, "_k": shifts[k[at]], "_tr": moves[tr]})

    own = ", ".join(f"{c} {chart.schema[c].dataType.simpleString()}" for c in keys)
    score = near.mapInPandas(run, f"{own}, _k int, _tr int").groupBy(*keys, "_k", "_tr").agg(F.count(F.lit(1)).alias("hits"))
    still = ((F.col("_k") == 0) & (F.col("_tr") == 0)).cast("int")
    best = score.groupBy(*keys).agg(F.max(F.struct("hits", still.alias("s"), (-F.col("_k")).alias("nk"), (-F.col("_tr")).alias("nt"))).alias("_b"))
    out = chart.select(*keys).distinct().join(best, keys, "left")
    zero = lambda c, x: F.coalesce(c, F.lit(x))
    return out.select(*keys, zero(-F.col("_b.nk") * step, 0.0).alias("shift"), zero(-F.col("_b.nt"), 0).alias("transpose"), zero(F.col("_b.hits"), 0).alias("hits"))
