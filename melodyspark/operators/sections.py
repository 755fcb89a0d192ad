"""Sections of a chart: verses found by their anchored words, wordless lead-ins, and singing outside all verses.

Everything is joins and windows over the notes of one block of one recording; notes, silences and verses
meet by interval joins on time buckets, so a long recording spreads over its blocks and buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.functions.scalars import round_to
from melodyspark.operators.intervals import interval_join, outside

#: a verse is located from so many anchored words on, and so large a share of its words (fixed values)
LEAST_ANCHORS, ANCHOR_SHARE = 3, 0.3
#: a boundary may lie so long before the end of one verse's anchors and after the beginning of the next's (fixed values)
EARLY, LATE = 0.3, 1.2
#: silence between stretches, and how long before the first anchor a stretch ends that is a lead-in (fixed values)
STRETCH, LEAD = 1.2, 0.6
#: a wordless stretch is charted with so many notes that cover so large a share of it (fixed values)
LEAST_NOTES, LEAST_SUNG = 6, 0.5
#: closed ends of ranges are moved up by less than any time differs
EPS = 1e-9


def silences(notes: DataFrame, keys: list[str], note: str) -> DataFrame:
    """Gaps between a note and the next of the same keys: keys, gap, mid (the middle of the gap)."""
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy("onset", note))
    n = notes.withColumn("_pe", before).where("_pe is not null")
    return n.select(*keys, (F.col("onset") - F.col("_pe")).alias("gap"), ((F.col("_pe") + F.col("onset")) / 2).alias("mid"))


def widest_silence(gaps: DataFrame, ranges: DataFrame, keys: list[str], ids: list[str], bucket: float = 20.0) -> DataFrame:
    """keys, ids, mid: the middle of the widest gap whose middle lies in lo .. hi of each range; of equal ones the later."""
    room = ranges.where("lo <= hi").select(*keys, *ids, "lo", (F.col("hi") + EPS).alias("_upto"))
    met = interval_join(gaps, room, keys, "mid", "lo", "_upto", bucket)
    return met.groupBy(*keys, *ids).agg(F.max_by("mid", F.struct("gap", "mid")).alias("mid"))


def numbered_stretches(notes: DataFrame, keys: list[str], note: str, gap: Column) -> DataFrame:
    """Notes with ``stretch``, from 1: a new one begins after a silence of at least ``gap``."""
    w = Window.partitionBy(*keys).orderBy("onset", note)
    new = F.coalesce((F.col("onset") - F.lag("end").over(w) >= gap).cast("int"), F.lit(1))
    return notes.withColumn("_new", new).withColumn("stretch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _ends(notes: DataFrame, keys: list[str], note: str) -> DataFrame:
    """First onset and the last note's end of each group."""
    return notes.groupBy(*keys).agg(F.min("onset").alias("a"), F.max_by("end", F.struct("onset", note)).alias("z"))


def located_verses(bnotes: DataFrame, blocks: DataFrame, verses: DataFrame, keys: list[str], note: str) -> DataFrame:
    """keys, verse, state (anchored or override), start, end, a0 (first anchor, null for overrides) of the verses that are found.

    The first verse of a block begins with it and the last ends with it, unless an override says otherwise; between two,
    the boundary is the next one's override, or the middle of the widest silence around its first anchor.
    """
    state = F.when(F.col("absent"), "absent").when(F.col("o_start").isNotNull(), "override")
    state = state.when(F.col("anchored") >= F.greatest(F.lit(float(LEAST_ANCHORS)), ANCHOR_SHARE * F.col("tokens")), "anchored").otherwise("absent")
    found = verses.withColumn("state", state).where("state <> 'absent'")
    by_state = lambda s, c, name: F.when(F.col("state") == s, F.col(c)).alias(name)
    found = found.select(*keys, "verse", "state", by_state("anchored", "anchor_start", "a0"), by_state("anchored", "anchor_end", "a1"), by_state("override", "o_start", "os"), by_state("override", "o_end", "oe"))
    v = Window.partitionBy(*keys).orderBy("verse")
    found = found.join(blocks.select(*keys, F.col("start").alias("_bs"), F.col("end").alias("_be")), keys)
    found = found.withColumn("_next", F.lead("verse").over(v)).withColumn("_na", F.lead("a0").over(v)).withColumn("_nos", F.lead("os").over(v))
    found = found.withColumn("lo", F.coalesce("a1", "oe", "_na") - EARLY).withColumn("hi", F.col("_na") + LATE)
    mid = widest_silence(silences(bnotes, keys, note), found.where("_na is not null"), keys, ["verse"])
    found = found.join(mid, [*keys, "verse"], "left")
    snapped = round_to(F.coalesce(F.col("mid"), (F.col("lo") + F.col("_na")) / 2), 2)
    found = found.withColumn("_bound", F.when(F.col("_next").isNotNull(), F.coalesce("_nos", snapped)))
    end = F.when(F.col("_next").isNull(), F.coalesce("oe", "_be")).otherwise(F.col("_bound"))
    return found.select(*keys, "verse", "state", F.coalesce(F.lag("_bound").over(v), "os", "_bs").alias("start"), end.alias("end"), "a0")


def lead_ins(bnotes: DataFrame, located: DataFrame, keys: list[str], note: str) -> DataFrame:
    """keys, verse, split: where a verse begins after a stretch of singing that ends well before its first anchored word."""
    ids = [*keys, "verse"]
    own = interval_join(bnotes, located.where("a0 is not null").select(*ids, "a0", F.col("start").alias("_s"), F.col("end").alias("_e")), keys, "onset", "_s", "_e", 20.0)
    ends = _ends(numbered_stretches(own, ids, note, F.lit(STRETCH)), [*ids, "a0", "stretch"], note).where(F.col("z") < F.col("a0") - LEAD)
    last = ends.groupBy(*ids, "a0").agg(F.max_by("z", "stretch").alias("z"))
    ranges = last.select(*ids, "a0", (F.col("z") - 0.1).alias("lo"), (F.col("a0") + 0.1).alias("hi"))
    mid = widest_silence(silences(own, ids, note), ranges, ids, [])
    return ranges.join(mid, ids, "left").select(*ids, round_to(F.coalesce(F.col("mid"), F.col("a0") - 0.3), 2).alias("split"))


def find_sections(notes: DataFrame, blocks: DataFrame, verses: DataFrame, keys: list[str], note: str) -> DataFrame:
    """keys, block, section, kind, start, end, located, notes, excluded of all sections of every recording.

    Notes: keys, ``note``, onset, end. Blocks: keys, block, start, end, part_gap (null but for blocks without verses, whose
    parts lie between silences of that length). Verses: keys, block, verse (from 0), tokens, anchored (how many of them),
    anchor_start, anchor_end, o_start, o_end (an override, or null), absent. Verses that are not located are left out.
    A wordless section of few notes, or mostly silence, is excluded: stray sounds, not a sung hook.
    """
    b = [*keys, "block"]
    span = blocks.select(*b, "part_gap", F.col("start").alias("_from"), F.col("end").alias("_to"))
    bnotes = interval_join(notes.select(*keys, note, "onset", "end"), span, keys, "onset", "_from", "_to", 60.0).drop("_from", "_to")
    scripted = bnotes.where("part_gap is null").drop("part_gap")
    found = located_verses(scripted, blocks, verses, b, note)
    split = lead_ins(scripted, found, b, note)
    name = F.concat(F.col("block").cast("string"), F.lit("-"), (F.col("verse") + 1).cast("string"))
    sung = found.join(split, [*b, "verse"], "left")
    verse = sung.select(*b, name.alias("section"), F.lit("sung").alias("kind"), F.coalesce("split", "start").alias("start"), "end", F.col("state").alias("located"))
    lead = sung.where("split is not null").select(*b, F.concat(name, F.lit("-lead")).alias("section"), F.lit("wordless").alias("kind"), "start", F.col("split").alias("end"), F.lit("before the first word").alias("located"))
    loose = outside(scripted, found.select(*b, F.col("start").alias("_s"), F.col("end").alias("_e")), b, "onset", "_s", "_e", 20.0, [*b, note])
    parts = bnotes.where("part_gap is not null")
    apart = numbered_stretches(loose, b, note, F.lit(STRETCH)).withColumn("_sign", F.lit("-x")).drop("part_gap")
    apart = apart.unionByName(numbered_stretches(parts, b, note, F.col("part_gap")).withColumn("_sign", F.lit("-")).drop("part_gap"))
    rest = _ends(apart, [*b, "_sign", "stretch"], note)
    rest = rest.select(*b, F.concat(F.col("block").cast("string"), "_sign", F.col("stretch").cast("string")).alias("section"), F.lit("unscripted").alias("kind"), round_to(F.col("a") - 0.05, 2).alias("start"), round_to(F.col("z") + 0.05, 2).alias("end"), F.lit("outside the verses").alias("located"))
    every = verse.unionByName(lead).unionByName(rest)
    inside = interval_join(notes.select(*keys, note, F.col("onset"), F.col("end").alias("_z")), every.select(*b, "section", F.col("start").alias("_s"), F.col("end").alias("_e")), keys, "onset", "_s", "_e", 20.0)
    held = inside.groupBy(*b, "section").agg(F.count(F.lit(1)).alias("notes"), F.sum(F.col("_z") - F.col("onset")).alias("_sung"), (F.max_by("_z", F.struct("onset", note)) - F.min("onset")).alias("_span"))
    out = every.join(held, [*b, "section"], "left").withColumn("notes", F.coalesce("notes", F.lit(0)))
    stray = (F.col("kind") == "wordless") & ((F.col("notes") < LEAST_NOTES) | (F.col("_sung") < LEAST_SUNG * F.col("_span")))
    return out.select(*b, "section", "kind", "start", "end", "located", "notes", F.coalesce(stray, F.lit(False)).alias("excluded"))


def weak_anchors(tokens: DataFrame, keys: list[str], order: str, slack: float = 0.5, length: float = 0.15) -> DataFrame:
    """Tokens (keys, ``order``, start, end, anchor, s_start, s_end of their section) with the times of those outside it made up.

    A token without a time, with an interpolated one, or with one more than ``slack`` outside its section is no evidence: it
    lies between its nearest neighbours inside, in proportion to its place among them, and its anchor is "interpolated".
    """
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.row_number().over(w)
    good = F.col("start").isNotNull() & F.col("start").between(F.col("s_start") - slack, F.col("s_end") + slack) & ~F.coalesce(F.col("anchor").isin("interpolated", "none"), F.lit(False))
    x = tokens.withColumn("_k", at).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_in", F.coalesce(good, F.lit(False)))
    here = F.when(F.col("_in"), F.struct(F.col("_k").alias("k"), "start", "end"))
    x = x.withColumn("_b", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_a", F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    lo, hi = F.coalesce("_b.end", "s_start"), F.coalesce("_a.start", "s_end")
    kb, ka = F.coalesce("_b.k", F.lit(0)), F.coalesce("_a.k", F.col("_n") + 1)
    made = lo + (hi - lo) * (F.col("_k") - kb) / (ka - kb)
    pick = lambda own, new: F.when(F.col("_in"), F.col(own)).otherwise(new)
    return x.select(*[c for c in tokens.columns if c not in ("start", "end", "anchor")], pick("start", made).alias("start"), pick("end", made + length).alias("end"), pick("anchor", F.lit("interpolated")).alias("anchor"))
