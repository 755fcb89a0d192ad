"""Audits of charts against words, voices and files, with the documented defaults. All take keys as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.operators.intervals import interval_join, nearest


def anchor_shift(words: DataFrame, notes: DataFrame, keys: list[str], word: str, near: float = 1.0, least: int = 3) -> DataFrame:
    """keys, used, shift: the median distance of words (keys, ``word``, start) to their nearest note onset within ``near`` seconds, 0 for fewer than ``least``."""
    found = nearest(words, notes, keys, "start", "onset", word)
    d = words.join(found, [*keys, word]).withColumn("_d", F.col("nearest") - F.col("start")).where(F.abs("_d") <= near)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("used"), F.when(F.count(F.lit(1)) >= least, F.median("_d")).otherwise(0.0).alias("shift"))


def shifted(words: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Words with the shift of their keys added to start and end."""
    s = F.coalesce("shift", F.lit(0.0))
    return words.join(shifts.select(*keys, "shift"), keys, "left").withColumn("start", F.col("start") + s).withColumn("end", F.col("end") + s).drop("shift")


def nearest_attack(notes: DataFrame, attacks: DataFrame, keys: list[str], note: str, within: float = 0.30, late: float = 0.1) -> DataFrame:
    """``note``, delta, late: the attack (keys, at) nearest to each note's onset within ``within`` seconds, of equals the earlier."""
    n = notes.select(*keys, note, "onset", (F.col("onset") - within - 0.01).alias("_a"), (F.col("onset") + within + 0.01).alias("_z"))
    d = interval_join(attacks.select(*keys, "at"), n, keys, "at", "_a", "_z", 2.0).withColumn("delta", F.col("at") - F.col("onset")).where(F.abs("delta") <= within)
    best = d.groupBy(note).agg(F.min_by("delta", F.struct(F.abs("delta"), F.col("at"))).alias("delta"))
    return best.withColumn("late", F.abs("delta") > late)


def review_flag(frames: Column, voiced: Column, agreement: Column, least: int = 4, share: float = 0.45, agree: float = 0.65) -> Column:
    """Why a note needs a review: too little independent voice, or a voice that disagrees; null for none."""
    weak = (frames < least) | (voiced < share)
    return F.when(weak, "insufficient-independent-voice").when(agreement < agree, "independent-pitch-disagreement")


def candidate_pitch(flag: Column, median: Column, support: Column, sure: float = 0.8) -> Column:
    """The pitch a disagreeing voice proposes, where ``sure`` of its frames are near their median."""
    return F.when((flag == "independent-pitch-disagreement") & (support >= sure), F.rint(median).cast("int"))


def section_quality(notes: DataFrame, keys: list[str], order: list[str], flagged: Column, sung: Column | None = None, gap: float = 0.3, leap: int = 9, most_flagged: float = 0.35, most_leaps: float = 0.15, least_labelled: float = 0.6) -> DataFrame:
    """keys, flagged, median_step, leaps, labelled (shares to two places) and quality: pitch-unreliable, lyrics-sparse (of sung sections) or null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(F.lead("onset").over(w) - F.col("end") < gap, F.abs(F.lead("midi").over(w) - F.col("midi")))
    q = notes.withColumn("_step", step).withColumn("_sung", F.lit(True) if sung is None else sung).groupBy(*keys).agg(
        S.round_to(F.avg(flagged.cast("int")), 2).alias("flagged"), F.coalesce(F.median("_step"), F.lit(0.0)).alias("median_step"),
        S.round_to(F.count_if(F.col("_step") >= leap) / F.greatest(F.lit(1), F.count("_step")), 2).alias("leaps"),
        S.round_to(F.avg((F.col("lyric") != "").cast("int")), 2).alias("labelled"), F.bool_or("_sung").alias("_sung"),
    )
    poor = (F.col("flagged") >= most_flagged) | (F.col("leaps") >= most_leaps)
    return q.withColumn("quality", F.when(poor, "pitch-unreliable").when(F.col("_sung") & (F.col("labelled") < least_labelled), "lyrics-sparse")).drop("_sung")


def status_counts(words: DataFrame, keys: list[str], status: str, statuses: list[str], least: int = 3, share: float = 0.3) -> DataFrame:
    """keys, a count of each status (a word of ``a+b`` counts for both) and absent: fewer heard words than ``least`` and ``share`` of all statuses."""
    s = words.select(*keys, F.explode(F.split(status, "\\+")).alias("_s"))
    n = s.groupBy(*keys).agg(*[F.count_if(F.col("_s") == v).alias(v.replace("-", "_")) for v in statuses], F.count(F.lit(1)).alias("_n"))
    return n.withColumn("absent", F.col("heard") < F.greatest(F.lit(float(least)), share * F.col("_n"))).drop("_n")


def lane_window(notes: DataFrame, keys: list[str], tonic: int = 60) -> DataFrame:
    """keys, semitones, low, high: a part's range and the lanes shown for it, at least one wide."""
    m = notes.groupBy(*keys).agg(F.min("midi").alias("_lo"), F.max("midi").alias("_hi"))
    m = m.withColumn("_w0", S.lane(F.col("_lo") - tonic)).withColumn("_w1", S.lane(F.col("_hi") - tonic))
    pad = F.greatest(F.lit(0.0), 1 - (F.col("_w1") - F.col("_w0"))) / 2
    return m.select(*keys, (F.col("_hi") - F.col("_lo")).cast("int").alias("semitones"), (F.col("_w0") - pad).alias("low"), (F.col("_w1") + pad).alias("high"))


def first_seen(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, values: the distinct values of a key in the order in which they first appear."""
    f = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return f.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_l")).select(*keys, F.transform("_l", lambda x: x[value]).alias("values"))


def top_line(events: DataFrame, keys: list[str], event: str) -> DataFrame:
    """The highest event of each attack (keys): keys, ``event``, midi; of equals the larger."""
    return events.groupBy(*keys).agg(F.max_by(event, F.struct("midi", event)).alias(event), F.max("midi").alias("midi"))


def missing_openings(notes: DataFrame, words: DataFrame, keys: list[str], margin: float = 0.6, least: int = 8) -> DataFrame:
    """keys, early, start, end: what to transcribe again, where ``least`` notes begin more than ``margin`` before the first word."""
    w = words.groupBy(*keys).agg(F.min("start").alias("end"))
    early = notes.select(*keys, "onset").join(w, keys).where(F.col("onset") < F.col("end") - margin)
    return early.groupBy(*keys, "end").agg(F.count(F.lit(1)).alias("early"), F.min("onset").alias("start")).where(F.col("early") >= least).select(*keys, "early", "start", "end")


def discrepant_lengths(assets: DataFrame, keys: list[str], most: float = 0.2) -> DataFrame:
    """keys, discrepant: whether the lengths (length, one row a role) of a recording's assets differ by more than ``most``."""
    return assets.groupBy(*keys).agg((F.max("length") - F.min("length") > most).alias("discrepant"))


def last_audible(frames: DataFrame, keys: list[str], share: float = 0.003, tail: float = 0.5) -> DataFrame:
    """keys, last_audible: ``tail`` after the last frame louder than ``share`` of the peak."""
    peak = frames.groupBy(*keys).agg(F.max("rms").alias("_peak"))
    return frames.join(peak, keys).where(F.col("rms") > share * F.col("_peak")).groupBy(*keys).agg((F.max("t") + tail).alias("last_audible"))


def widest_silences(notes: DataFrame, keys: list[str], order: list[str], ranges: DataFrame | None = None, number: Column | None = None) -> DataFrame:
    """The middle of the widest silence in each range, the later of equals: keys, range_no, boundary.

    ``ranges``: keys, range_no, start, end; or ``number`` gives the range of a silence from its middle, ``mid``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    gaps = notes.withColumn("_prev", F.lag("end").over(w)).where("_prev is not null").select(*keys, (F.col("onset") - F.col("_prev")).alias("_gap"), ((F.col("_prev") + F.col("onset")) / 2).alias("mid"))
    at = gaps.withColumn("range_no", number) if number is not None else interval_join(gaps, ranges, keys, "mid", "start", "end", 20.0)
    return at.groupBy(*keys, "range_no").agg(F.max_by("mid", F.struct("_gap", "mid")).alias("boundary"))


def song_summary(notes: DataFrame, words: DataFrame, keys: list[str], counts: dict[str, Column], cut: DataFrame) -> DataFrame:
    """keys, notes, a count for each condition, and the words (keys, t) at or after the recording's cut (keys, cut)."""
    c = notes.groupBy(*keys).agg(F.count(F.lit(1)).alias("notes"), *[F.count_if(x).alias(name) for name, x in counts.items()])
    after = words.select(*keys, "t").join(cut, keys).groupBy(*keys).agg(F.count_if(F.col("t") >= F.col("cut")).alias("words_after_cut"))
    return c.join(after, keys)
