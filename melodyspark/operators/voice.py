"""Voice, loudness and note rules over windows of a recording, with the documented defaults.

Rows of a recording are sorted once per key; a recording is bounded by its length in time. Frames have
keys, t and, where named, midi, voiced and rms; notes have keys, onset, end and midi.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.operators.intervals import interval_join
from melodyspark.operators.islands import changed, islands


def voiced_sections(frames: DataFrame, keys: list[str], order: list[str], gap: float = 0.10, least: float = 0.18, merge: float = 1.5, half: float = 0.01) -> DataFrame:
    """Acoustic sections: keys, section, start, end, spans.

    Voiced frames up to ``gap`` apart are a span, half a frame is added at its ends; spans of at least ``least``
    seconds that lie less than ``merge`` apart are a section.
    """
    w = Window.partitionBy(*keys)
    runs = islands(frames.where("voiced"), keys, order, F.col("t") - F.lag("t").over(w.orderBy(*order)) > gap, "g")
    spans = runs.groupBy(*keys, "g").agg((F.min("t") - half).alias("a"), (F.max("t") + half).alias("z")).where(F.col("z") - F.col("a") >= least)
    parts = islands(spans, keys, ["a"], F.col("a") - F.lag("z").over(w.orderBy("a")) >= merge, "section")
    return parts.groupBy(*keys, "section").agg(F.min("a").alias("start"), F.max("z").alias("end"), F.count(F.lit(1)).alias("spans"))


def voiced_runs(frames: DataFrame, keys: list[str], order: list[str], hole: int = 4, least: int = 6) -> DataFrame:
    """Voiced runs over holes of up to ``hole`` frames, ``least`` frames long or more: keys, first, last (from 1), voiced.

    A hole is bridged only where ``hole`` frames follow its last frame.
    """
    whole = Window.partitionBy(*keys)
    f = frames.withColumn("i", F.row_number().over(whole.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(whole)).where("voiced")
    step = F.col("i") - F.lag("i").over(whole.orderBy("i"))
    apart = (step > hole + 1) | ((step > 1) & (F.col("i") + (hole - 2) >= F.col("n")))
    runs = islands(f, keys, ["i"], apart).groupBy(*keys, "grp").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("voiced"))
    return runs.where(F.col("last") - F.col("first") + 1 >= least).select(*keys, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "voiced")


def octave_slips(frames: DataFrame, keys: list[str], order: list[str], near: int = 59, within: float = 7.5) -> DataFrame:
    """Voiced frames with ``fixed``: midi moved by octaves to ``within`` of the median of the frames ``near`` it, all of original values."""
    whole = Window.partitionBy(*keys)
    f = frames.withColumn("i", F.row_number().over(whole.orderBy(*order))).where("voiced")
    f = f.withColumn("mid", F.percentile("midi", 0.5).over(whole.orderBy("i").rangeBetween(-near, near)))
    off = F.col("midi") - F.col("mid")
    moved = F.col("midi") - F.signum(off) * 12 * F.ceil((F.abs(off) - within) / 12)
    return f.withColumn("fixed", F.when(F.abs(off) > within, moved).otherwise(F.col("midi"))).drop("i", "mid")


def colour_change(bands: DataFrame, cuts: DataFrame, keys: list[str], guard: float = 0.015, side: float = 0.06, least: int = 3, bucket: float = 1.0) -> DataFrame:
    """cuts (keys, at) with colour: one less the correlation of the mean band vectors on both sides, 0 with under ``least`` of them on one."""
    reach = guard + side
    room = cuts.select(*keys, "at").distinct().withColumn("_a", F.col("at") - reach).withColumn("_z", F.col("at") + reach + 1e-9)
    near = interval_join(bands.select(*keys, "t", "bands"), room, keys, "t", "_a", "_z", bucket)
    before, after = (F.col("t") >= F.col("at") - guard - side) & (F.col("t") < F.col("at") - guard), (F.col("t") > F.col("at") + guard) & (F.col("t") <= F.col("at") + guard + side)
    near = near.withColumn("_side", F.when(before, 0).when(after, 1)).where("_side is not null").select(*keys, "at", "_side", F.posexplode("bands").alias("_i", "_x"))
    mean = lambda k: F.avg(F.when(F.col("_side") == k, F.col("_x").cast("double"))).alias(f"_m{k}")
    count = lambda k: F.count_if(F.col("_side") == k).alias(f"_n{k}")
    bins = near.groupBy(*keys, "at", "_i").agg(mean(0), mean(1), count(0), count(1))
    colour = bins.groupBy(*keys, "at").agg(F.corr("_m0", "_m1").alias("_r"), F.min("_n0").alias("_n0"), F.min("_n1").alias("_n1"))
    enough = (F.col("_n0") >= least) & (F.col("_n1") >= least)
    out = cuts.join(colour, [*keys, "at"], "left").withColumn("colour", F.when(enough, 1 - F.col("_r")).otherwise(0.0))
    return out.withColumn("colour", F.coalesce("colour", F.lit(0.0))).drop("_r", "_n0", "_n1")


def attack_edge(frames: DataFrame, cuts: DataFrame, keys: list[str], near: float = 0.05, reach: float = 0.20, bucket: float = 2.0) -> DataFrame:
    """cuts (keys, at and more) with edge: the least rms within ``near`` against the quieter of both sides' peaks up to ``reach``.

    Cuts without frames in the middle or on a side are left out; edge is null where a side is silent.
    """
    room = cuts.withColumn("_a", F.col("at") - reach).withColumn("_z", F.col("at") + reach + 1e-9)
    hit = interval_join(frames.select(*keys, "t", "rms"), room, keys, "t", "_a", "_z", bucket)
    pick = lambda agg, c, name: agg(F.when(c, F.col("rms"))).alias(name)
    t, at = F.col("t"), F.col("at")
    inside = hit.where((t >= at - reach) & (t <= at + reach))
    e = inside.groupBy(*cuts.columns).agg(pick(F.min, (t >= at - near) & (t <= at + near), "_low"), pick(F.max, t < at - near, "_l"), pick(F.max, t > at + near, "_h"))
    whole = e.where("_low is not null and _l is not null and _h is not null")
    return whole.withColumn("edge", F.try_divide(F.col("_low"), F.least("_l", "_h"))).drop("_low", "_l", "_h")


def merge_held(notes: DataFrame, keys: list[str], order: list[str], pitch: str = "midi", gap: float = 0.06, owned: str | None = None) -> DataFrame:
    """Notes of one pitch that touch become one: keys, grp, onset, end, pitch, median (weighted by duration), pieces.

    With ``owned``, a true column for notes that have a syllable, only a note without one joins, and only a note that has one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    apart = changed(keys, order, pitch) | (F.col("onset") - F.lag("end").over(w) > gap)
    if owned is None:
        g = islands(notes, keys, order, apart)
    else:
        runs = islands(notes, keys, order, apart | F.col(owned), "_run")
        head = F.first(owned).over(Window.partitionBy(*keys, "_run").orderBy(*order))
        runs = runs.withColumn("_head", head).withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) == 1)
        g = islands(runs, keys, order, F.col("_first") | ~F.col("_head"))
    d = F.col("end") - F.col("onset")
    return g.groupBy(*keys, "grp").agg(F.min("onset").alias("onset"), F.max("end").alias("end"), F.first(pitch).alias(pitch), F.count(F.lit(1)).alias("pieces"), F.try_divide(F.sum(F.col("median") * d), F.sum(d)).alias("median"))


def first_voice(frames: DataFrame, keys: list[str], order: list[str], span: int = 30, share: float = 0.8, lead: float = 0.15) -> DataFrame:
    """keys, first_voice: ``lead`` before the first frame whose centred mean of ``voiced`` over ``span`` frames exceeds ``share``; zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(span // 2), span - span // 2 - 1)
    run = F.sum(F.col("voiced").cast("int")).over(w) / F.lit(float(span))
    return frames.withColumn("_run", run).where(F.col("_run") > share).groupBy(*keys).agg((F.min("t") - lead).alias("first_voice"))


def quick_part(sections: DataFrame, keys: list[str], order: str, length: Column, span: float = 12.0, lead: float = 4.0, late: float = 6.0, breath: float = 0.6) -> DataFrame:
    """keys, sections, start, end: the first sections (keys, ``order``, a, z) until their singing spans ``span`` seconds.

    A part that begins after ``late`` gets ``lead`` seconds before it; it ends 1.4 s after its last note where a
    silence of ``breath`` follows, else just before the next note. ``length`` is the recording's.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    s = sections.withColumn("a0", F.first("a").over(w)).withColumn("pz", F.lag("z").over(w)).withColumn("na", F.lead("a").over(w))
    q = s.where(F.col("pz").isNull() | (F.col("pz") - F.col("a0") < span)).groupBy(*keys, "a0").agg(F.max("z").alias("z"), F.count(F.lit(1)).alias("sections"), F.max_by("na", order).alias("na"))
    nxt = F.coalesce("na", length)
    end = F.when(nxt - F.col("z") >= breath, F.least(F.col("z") + 1.4, nxt - 0.05)).otherwise(F.greatest(F.col("z"), nxt - 0.02))
    return q.select(*keys, "sections", F.when(F.col("a0") > late, F.col("a0") - lead).otherwise(0.0).alias("start"), end.alias("end"))


def note_pairs(events: DataFrame, keys: list[str], clock_keys: list[str], order: str) -> DataFrame:
    """On events (``is_on`` and velocity above 0) with the off event that follows for the same ``keys``: all columns, start and dur.

    The clock is the running sum of ``delta`` over ``clock_keys``. An on event that meets another on event of its keys has no end and is left out.
    """
    on = F.col("is_on") & (F.col("velocity") > 0)
    e = events.withColumn("start", F.sum("delta").over(Window.partitionBy(*clock_keys).orderBy(order))).withColumn("_on", on)
    w = Window.partitionBy(*keys).orderBy(order)
    p = e.withColumn("_off", F.lead("start").over(w)).withColumn("_next", F.lead("_on").over(w)).where(F.col("_on") & ~F.col("_next"))
    return p.withColumn("dur", F.col("_off") - F.col("start")).drop("_on", "_off", "_next")


def fill_times(words: DataFrame, keys: list[str], order: str, length: float = 0.15) -> DataFrame:
    """Words with start, end and anchor: a word without a time lies between the end of the last known word and the start of the next.

    It stands half a step in; where one side has none it keeps no time. anchor: known, interpolated or none.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col("start").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("start").alias("s"), F.col("end").alias("e")))
    x = words.withColumn("_i", F.row_number().over(w))
    x = x.withColumn("_b", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # what follows is read backwards: a frame that ends with the key is worked out anew for every row
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_a", F.last(known, ignorenulls=True).over(back))
    at = F.col("_b.e") + (F.col("_a.s") - F.col("_b.e")) * (F.col("_i") - F.col("_b.i") - 0.5) / (F.col("_a.i") - F.col("_b.i"))
    anchor = F.when(F.col("start").isNotNull(), "known").when(at.isNotNull(), "interpolated").otherwise("none")
    out = x.withColumn("anchor", anchor).withColumn("_at", at)
    out = out.withColumn("end", F.when(F.col("anchor") == "interpolated", F.col("_at") + length).otherwise(F.col("end")))
    return out.withColumn("start", F.coalesce("start", "_at")).drop("_i", "_b", "_a", "_at")


def chart_match(frames: DataFrame, spans: DataFrame, keys: list[str], note: str, least: int = 5, share: float = 0.3, tolerance: float = 0.6, bucket: float = 10.0) -> DataFrame:
    """Per chart: notes, exact, octave (right but for the octave), silent, and the median error, octaves aside.

    Spans: keys, ``note``, start, end, expected. A span is silent with no frames, or under ``least`` or ``share`` of them voiced.
    """
    joined = interval_join(frames.select(*keys, "t", "midi", "voiced"), spans, keys, "t", "start", "end", bucket, how="right")
    m = joined.groupBy(*keys, note, "expected").agg(F.count("t").alias("_n"), F.count_if("voiced").alias("_v"), F.median(F.when(F.col("voiced"), F.col("midi"))).alias("_med"))
    m = m.withColumn("_d", F.when((F.col("_n") > 0) & (F.col("_v") >= share * F.col("_n")) & (F.col("_v") >= least), F.col("_med") - F.col("expected"))).withColumn("_o", F.abs(S.octave_blind(F.col("_d"))))
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.abs("_d") <= tolerance).alias("exact"), F.count_if(F.col("_o") <= tolerance).alias("octave"), F.count_if(F.col("_d").isNull()).alias("silent"), F.median("_o").alias("med_err"))


def sliding_loudness(chunks: DataFrame, keys: list[str], rate: int, window: float = 0.025, hop: float = 0.005) -> DataFrame:
    """keys, hop, t, rms over a chunked signal (keys, chunk from 0, samples; all chunks but the last of one size).

    Each chunk takes the samples it lacks from the next one, so windows that cross chunks are whole; rows are
    bounded by the chunk size.
    """
    win, step = int(rate * window), int(rate * hop)
    w = Window.partitionBy(*keys).orderBy("chunk")
    size = F.max(F.size("samples")).over(Window.partitionBy(*keys))
    c = chunks.withColumn("_size", size).withColumn("_all", F.sum(F.size("samples")).over(Window.partitionBy(*keys)))
    halo = F.slice(F.coalesce(F.lead("samples").over(w), F.array().cast("array<double>")), 1, win)
    c = c.withColumn("_x", F.concat(F.col("samples").cast("array<double>"), halo.cast("array<double>")))
    at = F.col("chunk") * F.col("_size")
    first, last = F.ceil(at / step).cast("long"), F.least(F.ceil((at + F.col("_size")) / step), F.floor((F.col("_all") - win) / step)).cast("long") - 1
    x = c.where(first <= last).withColumn("hop", F.explode(F.sequence(first, last))).withColumn("_at", F.col("chunk") * F.col("_size"))
    part = F.slice("_x", (F.col("hop") * step - F.col("_at") + 1).cast("int"), win)
    total = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v * v)
    return x.select(*keys, "hop", ((F.col("hop") * step + win / 2) / rate).alias("t"), F.sqrt(total / win).alias("rms"))
