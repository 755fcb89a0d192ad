"""Checks, second opinions, votes and differences over charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_by_sisters(votes: DataFrame, keys: list[str], section: str, value: str, least: int = 2, share: float = 0.6) -> DataFrame:
    """The value that other sections hold at the same place, where enough of them agree.

    Votes are counted once for a place and a section's own are subtracted, so a place sung in
    thousands of takes is never joined with itself.
    """
    every = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    own = votes.groupBy(*keys, section, value).agg(F.count(F.lit(1)).alias("o"))
    places = votes.select(*keys, section).distinct()
    left = places.join(every, keys).join(own, [*keys, section, value], "left").withColumn("n", F.col("n") - F.coalesce("o", F.lit(0)))
    best = left.groupBy(*keys, section).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("b"), F.sum("n").alias("all"))
    return best.where((F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("all"))).select(*keys, section, (-F.col("b.v")).cast("int").alias(value))


def sister_expectations(syllables: DataFrame, key: str, section: str, transpositions: DataFrame, least_sections: int = 3, least: int = 2, share: float = 0.6) -> DataFrame:
    """The pitch class that other sections of a song sing at each syllable: ``key``, ``section``, verse, line, q, pc in the section's own key.

    Syllables: ``key``, ``section``, verse, line, q, midi. Sections vote where they have the same line with as many syllables, after
    ``transpositions`` (``key``, ``section``, shift) has brought them to one key; songs of fewer than ``least_sections`` have no expectation.
    """
    own = [key, section, "verse", "line"]
    many = syllables.groupBy(key).agg(F.count_distinct(section).alias("_s")).where(F.col("_s") >= least_sections).select(key)
    sized = syllables.join(many, key).join(syllables.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")), own).join(transpositions, [key, section])
    votes = sized.where("midi is not null").withColumn("pc", F.pmod(F.col("midi") + F.col("shift"), F.lit(12)))
    got = expected_by_sisters(votes.select(key, "line", "_n", "q", section, "pc"), [key, "line", "_n", "q"], section, "pc", least, share)
    out = sized.join(got, [key, section, "line", "_n", "q"])
    return out.select(*own, "q", F.pmod(F.col("pc") - F.col("shift"), F.lit(12)).cast("int").alias("pc"))


def copied_tune(syllables: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Syllables of sections that take their tune from another: ``key``, section, line, q, old, new; new is null where the source has no counterpart.

    Syllables: ``key``, section, line, q, midi. Rules: ``key``, section, source, line, syllables (how many of the line), transpose.
    """
    source = syllables.select(key, F.col("section").alias("source"), "line", "q", F.col("midi").alias("_from"))
    mine = syllables.join(rules, [key, "section", "line"]).where(F.col("q") < F.col("syllables"))
    return mine.join(source, [key, "source", "line", "q"], "left").select(key, "section", "line", "q", F.col("midi").alias("old"), (F.col("_from") + F.col("transpose")).alias("new"))


def diff_versions(old: DataFrame, new: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Rows added, removed or changed between two versions: ids, change, old_* and new_*."""
    a = old.select(*ids, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_a"))
    b = new.select(*ids, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_b"))
    both = a.join(b, ids, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "changed")
    return both.withColumn("change", change).where("change is not null").drop("_a", "_b")


def set_gaps(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys that are missing from ``have`` or extra in it."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("state", F.lit("extra")))


def consensus(notes: DataFrame, readings: DataFrame, key: str, tolerance: float = 0.25, low: int = 45, high: int = 84) -> DataFrame:
    """Pitch corrections that two stable independent readings agree on: key, old, new.

    ``readings``: key, reader, median, frames, coverage, stable, support. A note's readings are
    gathered into one small array (one element a reader), so no reader is joined with another.
    """
    sure = readings.where("coverage >= 0.70 and stable >= 0.80 and support >= 0.80")
    grouped = sure.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("reader", "median", "frames"))).alias("r"), F.count_distinct(F.rint("median")).alias("pitches"))
    pairs = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: (b["reader"] > a["reader"]) & (F.abs(a["median"] - b["median"]) <= tolerance)), lambda b: F.struct((a["frames"] + b["frames"]).alias("n"), a["reader"].alias("x"), b["reader"].alias("y"), ((a["median"] + b["median"]) / 2).alias("m")))))
    # most frames; of equals the first pair by name
    best = F.array_sort(pairs, lambda p, q: F.when(p["n"] != q["n"], F.when(p["n"] > q["n"], -1).otherwise(1)).when(p["x"] != q["x"], F.when(p["x"] < q["x"], -1).otherwise(1)).when(p["y"] < q["y"], -1).when(p["y"] > q["y"], 1).otherwise(0))
    chosen = grouped.where((F.col("pitches") == 1) & (F.size(pairs) > 0)).select(key, F.rint(F.get(best, F.lit(0))["m"]).cast("int").alias("new"))
    moved = F.abs(F.col("new") - F.col("midi"))
    ok = (F.col("new") != F.col("midi")) & F.col("new").between(low, high) & ((moved <= 2) | (moved == 12))
    return notes.join(chosen, key).where(ok).select(key, F.col("midi").alias("old"), "new")


def pitch_flag(midi: Column, median: Column, frames: Column, stable: Column, other: Column) -> Column:
    """What a second opinion says about a note: weak, octave suspect, disagreement, unstable, or null."""
    diff = median - midi
    octave = F.rint(diff / 12) * 12
    suspect = (octave != 0) & (F.abs(diff - octave) <= 0.65) & F.coalesce(F.abs(other - midi - octave) <= 0.65, F.lit(False))
    return F.when(median.isNull() | (frames < 4), "weak-independent-voicing").when(F.abs(diff) > 0.65, F.when(suspect, "octave-fold-suspect").when(stable >= 0.6, "estimators-disagree").otherwise("unstable-pitch"))


def violations(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule: id, rule. All rules are judged in one pass."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(id_col), F.explode(broken).alias("rule"))
