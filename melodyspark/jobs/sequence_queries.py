"""Queries of sequence matching and of rules that look back on their own decisions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.functions import text as X
from melodyspark.jobs.registry import query
from melodyspark.jobs.sql import duck, r
from melodyspark.operators import charting as C
from melodyspark.operators import islands as L
from melodyspark.operators import lyrics as Y
from melodyspark.operators import quality as Z
from melodyspark.operators import sequences as Q
from melodyspark.operators import signal as G
from melodyspark.operators import stats as A
from melodyspark.operators import voice as V
from melodyspark.operators.intervals import interval_join
from melodyspark.sources import tables as T

ORDER = ["onset", "frame_id"]
SHIFTS = range(-14, 15)


def step_grams(tunes: DataFrame, key: str, section: str, notes: str, q: int = 2) -> DataFrame:
    """key, section, gram, times: runs of ``q`` pitch steps of every tune, which no transposition changes."""
    steps = F.transform(F.sequence(F.lit(1), F.size(notes) - 1), lambda i: F.get(F.col(notes), i) - F.get(F.col(notes), i - 1))
    s = tunes.where(F.size(notes) > q).select(key, F.col(section).alias("section"), steps.alias("_s"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_s") - q + 1), lambda i: F.array_join(F.slice(F.col("_s"), i, F.lit(q)).cast("array<string>"), " "))
    return s.select(key, "section", F.explode(grams).alias("gram")).groupBy(key, "section", "gram").agg(F.count(F.lit(1)).alias("times"))


def sister_bounds(tunes: DataFrame, key: str, section: str, notes: str, q: int = 2) -> DataFrame:
    """key, section, sister, least: how many edits lie at least between two sections of a song, whatever the transposition.

    An edited note changes two steps next to each other at most, and so q + 1 runs of q steps; tunes that share few runs are
    far apart. Sections meet only inside their song.
    """
    g = step_grams(tunes, key, section, notes, q)
    other = g.select(key, F.col("section").alias("sister"), "gram", F.col("times").alias("_t"))
    shared = g.join(other, [key, "gram"]).groupBy(key, "section", "sister").agg(F.sum(F.least("times", "_t")).alias("shared"))
    n = tunes.select(key, F.col(section).alias("section"), F.size(notes).alias("n"))
    pairs = n.join(n.select(key, F.col("section").alias("sister"), F.col("n").alias("m")), key).where(F.col("section") != F.col("sister"))
    missing = F.greatest(F.col("n") - q, F.col("m") - q, F.lit(0)) - F.coalesce("shared", F.lit(0))
    least = F.greatest(F.abs(F.col("n") - F.col("m")), F.ceil(missing / F.lit(q + 1))).cast("int")
    return pairs.join(shared, [key, "section", "sister"], "left").select(key, "section", "sister", "n", least.alias("least"))


def _edits(pairs: DataFrame, tunes: DataFrame, key: str, section: str, notes: str) -> DataFrame:
    """``pairs`` with d (edits, shift): the least edit distance over all transpositions. Pitches become characters, so the distance is Spark's own."""
    text = lambda shift: F.array_join(F.transform(notes, lambda m: F.char(m + F.lit(20 + shift))), "")
    a = tunes.select(key, F.col(section).alias("section"), *[text(s).alias(f"s{s + 14}") for s in SHIFTS])
    b = tunes.select(key, F.col(section).alias("sister"), text(0).alias("t"))
    tries = F.array_min(F.array(*[F.struct(F.levenshtein(F.col(f"s{s + 14}"), F.col("t")).alias("edits"), F.lit(s).alias("shift")) for s in SHIFTS]))
    return pairs.join(a, [key, "section"]).join(b, [key, "sister"]).select(*pairs.columns, tries.alias("d"))


def tune_candidates(tunes: DataFrame, key: str, section: str, notes: str) -> DataFrame:
    """The pairs whose bound does not exceed the distance of the section's most promising sister, which is measured first."""
    bounds = sister_bounds(tunes, key, section, notes)
    first = bounds.groupBy(key, "section").agg(F.min(F.struct("least", "sister")).alias("f")).select(key, "section", F.col("f.sister").alias("sister"))
    reach = _edits(first, tunes, key, section, notes).select(key, "section", F.col("d.edits").alias("reach"))
    return bounds.join(reach, [key, "section"]).where(F.col("least") <= F.col("reach"))


def tune_distance(tunes: DataFrame, key: str, section: str, notes: str) -> DataFrame:
    """The nearest sister section of every section: sister, edits, shift, over all transpositions.

    Sections meet only inside their song, and only candidates that the count of shared pitch steps leaves are measured.
    """
    pairs = _edits(tune_candidates(tunes, key, section, notes).select(key, "section", "sister", "n"), tunes, key, section, notes)
    best = pairs.groupBy(key, "section", "n").agg(F.min(F.struct("d", "sister")).alias("b"))
    return best.select(key, "section", F.col("b.sister").alias("sister"), F.col("b.d.edits").alias("edits"), F.col("b.d.shift").alias("shift"), (F.col("b.d.edits") / F.col("n") > 0.12).alias("lead"))



@query(duck("secnotes", more={"tn": "SELECT recording_id, section, list(midi ORDER BY onset, frame_id) AS ms, count(*) AS n FROM secnotes GROUP BY ALL", "d": "SELECT a.recording_id, a.section, b.section AS sister, a.n, s::INT AS shift, levenshtein(array_to_string(list_transform(a.ms, lambda m: chr((m + 20 + s)::INT)), ''), array_to_string(list_transform(b.ms, lambda m: chr((m + 20)::INT)), '')) AS edits FROM tn a JOIN tn b ON a.recording_id = b.recording_id AND a.section <> b.section, range(-14, 15) u(s)"},
    body="SELECT recording_id, section, sister, edits::INT AS edits, shift, edits / n::DOUBLE > 0.12::DOUBLE AS lead FROM d QUALIFY row_number() OVER (PARTITION BY recording_id, section ORDER BY edits, shift, sister) = 1"))
def h1_tune_distance(spark: SparkSession, sf: str) -> DataFrame:
    n = T.with_section(T.notes(spark, sf))
    tunes = n.groupBy("recording_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("onset", "frame_id", "midi"))), lambda x: x["midi"]).alias("ms"))
    return tune_distance(tunes, "recording_id", "section", "ms")


@query(duck("secnotes", body="SELECT recording_id, section, line, count(*) FILTER (WHERE lyric = '') AS no_word, count(*) FILTER (WHERE frame_id % 8 = 0) AS shared, count(*) FILTER (WHERE abs(median - midi) > 0.4::DOUBLE) AS off_tune, string_agg(CASE WHEN lyric = '' THEN '~' ELSE lyric END, ' ' ORDER BY onset, frame_id) AS text FROM secnotes GROUP BY ALL HAVING count(*) FILTER (WHERE lyric = '') + count(*) FILTER (WHERE frame_id % 8 = 0) + count(*) FILTER (WHERE abs(median - midi) > 0.4::DOUBLE) > 0"))
def h2_line_leads(spark: SparkSession, sf: str) -> DataFrame:
    word = F.when(F.col("lyric") == "", "~").otherwise(F.col("lyric"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("onset", "frame_id", word.alias("w")))), lambda x: x["w"]), " ")
    g = T.with_section(T.notes(spark, sf)).groupBy("recording_id", "section", "line").agg(F.count_if(F.col("lyric") == "").alias("no_word"), F.count_if(F.col("frame_id") % 8 == 0).alias("shared"), F.count_if(F.abs(F.col("median") - F.col("midi")) > 0.4).alias("off_tune"), text.alias("text"))
    return g.where("no_word + shared + off_tune > 0")


@query()
def h2_leads_of_placed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Leads of every line whose words were placed on its notes: shared and dropped words, notes without one, notes off their pitch."""
    n = T.with_section(T.notes(spark, sf)).select("recording_id", "section", "line", "frame_id", "onset", "end", "midi", "median", "lyric")
    placed = C.place_units(n.drop("line", "lyric", "median"), _units(n), ["recording_id", "section"], "frame_id", "unit")
    line = n.select(F.col("frame_id").alias("unit"), "line")
    words = placed.join(line, "unit").groupBy("recording_id", "section", "line").agg(F.count_if("shared").alias("shared"), F.count_if(F.col("frame_id").isNull()).alias("dropped"))
    owned = placed.where("frame_id is not null").select("frame_id", F.lit(True).alias("owned")).distinct()
    off = F.count_if(F.abs(F.col("median") - F.col("midi")) > 0.4).alias("off_tune")
    notes = n.join(owned, "frame_id", "left").groupBy("recording_id", "section", "line").agg(F.count_if(F.col("owned").isNull()).alias("no_word"), off)
    return notes.join(words, ["recording_id", "section", "line"]).where("no_word + shared + dropped + off_tune > 0")


@query()
def h3_transcript_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Monotone alignment of each turn's tokens to those of the turn before, at the price of their relation."""
    t = T.table(spark, sf, "conversations").where("text is not null").withColumn("tokens", X.tokens(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = t.select("conv_id", "turn", F.lag("tokens").over(w).alias("ref"), F.col("tokens").alias("heard")).where("ref is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, k, ref, heard in zip(pdf["conv_id"], pdf["turn"], pdf["ref"], pdf["heard"], strict=True):
                found = Q.align(list(ref), list(heard), lambda a, b: Y.PRICE[Y.relation(a, b)])
                kinds = [Y.relation(ref[i], heard[j]) for i, j in found if i >= 0 and j >= 0]
                out.append((c, k, kinds.count("exact"), kinds.count("homophone"), len(kinds), len(found)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "exact", "homophone", "paired", "steps"])

    return words.mapInPandas(run, "conv_id long, turn long, exact long, homophone long, paired long, steps long")


@query()
def h6_ordered_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Word times that contradict the order of the words lose their time; the words stay."""
    n = T.notes(spark, sf).withColumn("start", F.col("onset") + F.when(F.col("frame_id") % 6 == 0, -15.0).otherwise(0.0)).withColumn("w", F.when(F.col("lyric") == "", 1).otherwise(2))
    fn = lambda p: pd.DataFrame({"frame_id": p["frame_id"], "kept": Q.ordered_anchors(p["start"].to_numpy(), p["w"].to_numpy())})
    return Q.by_key(n.select("recording_id", "frame_id", "onset", "start", "w"), ["recording_id"], ORDER, fn, "frame_id long, kept boolean")


@query()
def h9_choose_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Each note's expected onset, a tenth of a second early, takes a measured attack of its section in order, or none."""
    n = T.with_section(T.notes(spark, sf)).select("recording_id", "section", "frame_id", "onset", "rms")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        at = p["onset"].to_numpy()
        got = C.choose_cuts(at - 0.1, at, p["rms"].to_numpy())
        return pd.DataFrame({"frame_id": p["frame_id"], "cut": [float(at[g]) if g >= 0 else None for g in got]})

    return Q.by_key(n, ["recording_id", "section"], ORDER, fn, "frame_id long, cut double")


@query()
def h9_split_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as one held note with the words of its notes: cut where its quiet frames show an attack."""
    n = T.with_section(T.notes(spark, sf)).select("recording_id", "line", "frame_id", "onset", "end", "rms", "median", "lyric")

    def fn(rows: pa.Table, bounds: np.ndarray) -> dict:
        onset, end, rms, median = (Q.array_of(rows, c) for c in ("onset", "end", "rms", "median"))
        known, colour = np.where(pc.not_equal(rows["lyric"], "").to_numpy(), onset, np.nan), median % 1
        found = [C.split_note(float(onset[a]), float(end[z - 1]), known[a:z], onset[a:z], rms[a:z], colour[a:z]) for a, z in itertools.pairwise(bounds.tolist())]
        which = pa.array(np.repeat(bounds[:-1], [len(x) for x in found]))
        pieces = [x for own in found for x in own]
        start, stop, units = pa.array([x[0] for x in pieces], "double"), pa.array([x[1] for x in pieces], "double"), pa.array([len(x[2]) for x in pieces], "int64")
        return {"recording_id": rows["recording_id"].take(which), "line": rows["line"].take(which), "onset": start, "end": stop, "units": units}

    return Q.by_runs(n, ["recording_id", "line"], ORDER, fn, "recording_id long, line int, onset double, end double, units long")


@query()
def h10_pitch_states(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest path of whole pitches through each voiced run's frames, less the recording's tuning, short runs absorbed.

    Frames are sparse here, so every silence of a second ends a run, however long it is."""
    f = _tuned_runs(spark, sf)
    fn = lambda p: pd.DataFrame({"frame_id": p["frame_id"], "midi": Q.absorb_short(Q.pitch_states(p["midi"].to_numpy(), p["voiced"].to_numpy()), 3)})
    return Q.by_key(f, ["recording_id", "run"], ["t", "frame_id"], fn, "frame_id long, midi int")


def _tuned_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of voiced runs (recording_id, run): holes of four frames are bridged, midi is less the tuning."""
    f = T.frames(spark, sf).select("recording_id", "frame_id", "t", "midi", "voiced", "rms")
    runs = V.voiced_runs(f, ["recording_id"], ["t", "frame_id"]).select("recording_id", F.col("first").alias("run"), "first", (F.col("last") + 1).alias("upto"))
    numbered = f.withColumn("i", F.row_number().over(T.by_time()))
    inside = interval_join(numbered, runs, ["recording_id"], "i", "first", "upto", 200.0)
    tuning = A.tuning_offset(f).select("recording_id", F.col("offset"))
    return inside.join(tuning, "recording_id").select("recording_id", "run", "frame_id", "t", (F.col("midi") - F.col("offset")).alias("midi"), "voiced", "rms")


@query()
def h11_absorb_glides(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with the short slides before them; the notes' times are divided by ten, as the data's are that much longer."""
    short = lambda c: (F.col(c) / 10).alias(c)
    f = T.frames(spark, sf).select("recording_id", short("t"), "midi", "voiced")
    n = T.notes(spark, sf).select("recording_id", "frame_id", short("onset"), short("end"), "midi")
    return C.without_glides(n, f, ["recording_id"], "frame_id")


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's vectors as the chunks of one signal."""
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return T.table(spark, sf, "embeddings").select("label", number.alias("chunk"), F.col("embedding").alias("samples"))


@query()
def h13_autocorrelation_pitch(spark: SparkSession, sf: str) -> DataFrame:
    """Pitch of each label's vectors as one signal at 4 kHz: frames of 256 samples every 64."""
    return G.autocorrelation_track(_signal(spark, sf), ["label"], rate=4000, window=256, hop=64)


@query()
def h14_difference_pitch(spark: SparkSession, sf: str) -> DataFrame:
    """Pitch of each label's vectors as one signal at 4 kHz: frames of 256 samples every 64."""
    return G.difference_track(_signal(spark, sf), ["label"], rate=4000, window=256, hop=64)


@query()
def h15_band_energies(spark: SparkSession, sf: str) -> DataFrame:
    """Band energies of each label's vectors as one signal at 16 kHz."""
    return G.band_track(_signal(spark, sf), ["label"])


@query()
def t2_spaced_dips(spark: SparkSession, sf: str) -> DataFrame:
    """The quietest frames first, none within five seconds of one already taken."""
    f = T.frames(spark, sf).select("recording_id", "frame_id", "t", "rms")
    fn = lambda p: p[["frame_id"]][Q.spaced(p["rms"].to_numpy(), p["t"].to_numpy(), 5.0)]
    return Q.by_key(f, ["recording_id"], ["t", "frame_id"], fn, "frame_id long")


@query()
def w13_octave_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Isolated octave errors, neighbours up to 1.5 s away; notes further apart never meet, so stretches are keys."""
    n = L.islands(T.notes(spark, sf).select("recording_id", "frame_id", "onset", "midi"), ["recording_id"], ORDER, F.col("onset") - F.lag("onset").over(Window.partitionBy("recording_id").orderBy(*ORDER)) >= 1.5)

    def fn(rows: pa.Table, bounds: np.ndarray) -> dict:
        midi = Q.octave_repairs(Q.array_of(rows, "midi"), Q.array_of(rows, "onset"), first=bounds[:-1])
        return {"frame_id": rows["frame_id"], "midi": pa.array(midi, "int32")}

    return Q.by_runs(n, ["recording_id", "grp"], ORDER, fn, "frame_id long, midi int")


@query()
def w17_w18_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Sung lines; every other line starts where the words' reference has a line start."""
    n = T.with_section(T.notes(spark, sf)).withColumn("starts", F.col("line") % 2 == 0).withColumn("line", F.when(F.col("lyric") == "", -1).otherwise(F.col("line")))
    fn = lambda p: pd.DataFrame({"frame_id": p["frame_id"], "phrase": Q.phrases(*(p[c].to_numpy() for c in ("section", "line", "starts", "onset", "end")))})
    return Q.by_key(n.select("recording_id", "frame_id", "section", "line", "starts", "onset", "end"), ["recording_id"], ORDER, fn, "frame_id long, phrase int")


@query()
def w19_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of at most 26 s of every recording, from 0 to its last note's end."""

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        found = Q.pieces(p["onset"].to_numpy(), p["end"].to_numpy(), 0.0, float(p["end"].max()))
        return pd.DataFrame([(int(p["recording_id"].iloc[0]), a, z) for a, z in found], columns=["recording_id", "start", "end"])

    return Q.by_key(T.notes(spark, sf).select("recording_id", "frame_id", "onset", "end"), ["recording_id"], ORDER, fn, "recording_id long, start double, end double")


@query(duck("notes", more={"p": 'SELECT *, lag("end") OVER w AS pe, lag(midi // 3) OVER w AS pm, lag(onset) OVER w AS po FROM notes WINDOW w AS (PARTITION BY recording_id ORDER BY onset, frame_id)', "b": 'SELECT frame_id, recording_id, onset, po, "end" FROM p WHERE pm = midi // 3 AND onset - pe <= 1.0',
    "d": "SELECT b.frame_id, f.t AS quiet_at, row_number() OVER (PARTITION BY b.frame_id ORDER BY abs(f.t - onset), f.t) AS k FROM b JOIN frames f ON f.recording_id = b.recording_id AND f.rms <= 0.40::DOUBLE AND abs(f.t - onset) BETWEEN 0.025::DOUBLE AND 1.0 AND f.t - po >= 0.12::DOUBLE AND b.\"end\" - f.t >= 0.12::DOUBLE"}, body="SELECT frame_id, round_even(quiet_at * 100, 0) / 100 AS t FROM d WHERE k = 1"))
def w25_quiet_attacks(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that repeat a pitch take the nearest quiet frame as their attack; bounds as the data's frame rate asks."""
    f = T.frames(spark, sf)
    w = Window.partitionBy("recording_id").orderBy(*ORDER)
    n = T.notes_of(f).withColumn("band", F.floor(F.col("midi") / 3))
    b = n.withColumn("pe", F.lag("end").over(w)).withColumn("pm", F.lag("band").over(w)).withColumn("po", F.lag("onset").over(w)).where((F.col("pm") == F.col("band")) & (F.col("onset") - F.col("pe") <= 1.0))
    b = b.select("recording_id", "frame_id", "onset", "po", "end", (F.col("onset") - 1.1).alias("lo"), (F.col("onset") + 1.1).alias("hi"))
    quiet = f.where("rms <= 0.40").select("recording_id", F.col("t").alias("at"))
    away = F.abs(F.col("at") - F.col("onset"))
    d = interval_join(quiet, b, ["recording_id"], "at", "lo", "hi", 3.0).where(away.between(0.025, 1.0) & (F.col("at") - F.col("po") >= 0.12) & (F.col("end") - F.col("at") >= 0.12))
    return d.groupBy("frame_id").agg(S.round_to(F.min_by("at", F.struct(away, F.col("at"))), 2).alias("t"))


@query()
def w25_attack_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Attacks moved by the documented rule. Pitches are folded to three and every note has a word, as the data's notes lie far apart;
    loudness is read every 10 ms around each frame, with a dip at each ninth reading."""
    f = T.frames(spark, sf)
    n = T.with_section(T.notes_of(f)).select("recording_id", "frame_id", "section", "onset", "end", (60 + F.col("midi") % 3).alias("midi"), F.concat(F.lit("la"), F.col("lyric")).alias("lyric"))
    k = F.col("k")
    dip = F.when((F.col("frame_id") * 7 + k) % 9 == 0, 0.1).otherwise(1.0)
    e = f.withColumn("k", F.explode(F.sequence(F.lit(-20), F.lit(19)))).select("recording_id", (F.col("t") + k * 0.01).alias("t"), (F.col("rms") * dip).alias("rms"))
    return C.attack_moves(n, e, ["recording_id"], "frame_id")


@query(duck("secnotes", more={"q": "SELECT recording_id, section, line % 4 AS line, (row_number() OVER (PARTITION BY recording_id, section, line ORDER BY onset, frame_id) - 1)::INT AS q, midi FROM secnotes"}, body="SELECT a.recording_id, a.section, a.line::INT AS line, a.q, a.midi AS old, (b.midi + 2)::INT AS new FROM q a LEFT JOIN q b ON a.recording_id = b.recording_id AND b.section = a.section - 1 AND a.line = b.line AND a.q = b.q"))
def j18_copy_tune(spark: SparkSession, sf: str) -> DataFrame:
    """Every section takes the tune of the one before, line by line and syllable by syllable, two semitones up; missing counterparts have none."""
    q = F.row_number().over(Window.partitionBy("recording_id", "section", "line").orderBy(*ORDER)) - 1
    n = T.with_section(T.notes(spark, sf)).withColumn("q", q).select("recording_id", "section", (F.col("line") % 4).alias("line"), "q", "midi")
    rules = n.groupBy("recording_id", "section", "line").agg(F.count(F.lit(1)).alias("syllables")).select("recording_id", "section", (F.col("section") - 1).alias("source"), "line", "syllables", F.lit(2).alias("transpose"))
    return Z.copied_tune(n, rules, "recording_id")


@query(duck("words", more={"j": "SELECT *, lower(regexp_replace(word || coalesce(lead(word) OVER w, '') || coalesce(lead(word, 2) OVER w, ''), '[^A-Za-z]', '', 'g')) AS acc FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY pos)"}, body="SELECT recording_id, pos FROM j WHERE starts_with(acc, 'ofthe') OR starts_with(acc, 'dela') OR starts_with(acc, 'inund')"))
def h12_known_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Places where one of three fragments begins within three words; the whole rule is h12_drop_known_phrases."""
    w = Window.partitionBy("recording_id").orderBy("pos")
    acc = F.lower(F.regexp_replace(F.concat("word", F.coalesce(F.lead("word").over(w), F.lit("")), F.coalesce(F.lead("word", 2).over(w), F.lit(""))), "[^A-Za-z]", ""))
    j = T.words(spark, sf).select("recording_id", "pos", acc.alias("acc"))
    return j.where(F.col("acc").startswith("ofthe") | F.col("acc").startswith("dela") | F.col("acc").startswith("inund")).select("recording_id", "pos")


@query()
def h12_drop_known_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Words outside the known phrases: the documented list and three fragments that the data has."""
    from melodyspark.operators import phrases as P

    known = spark.createDataFrame([(p,) for p in (*P.KNOWN, "ofthe", "dela", "inund")], "phrase string")
    return P.drop_known(T.words(spark, sf).select("recording_id", "pos", "word"), known, ["recording_id"], "pos", "word")


@query(duck("notes", more={"h": "SELECT recording_id, frame_id, onset, lyric, rms AS p FROM notes WHERE lyric <> ''", "o": "SELECT recording_id, frame_id AS other, onset + 0.5::DOUBLE AS at, lyric AS variant, rms AS q FROM notes WHERE lyric <> ''"}, body="SELECT h.frame_id, o.other, variant = lyric AS same FROM h JOIN o ON h.recording_id = o.recording_id AND abs(o.at - h.onset) < 1.2::DOUBLE AND least(p, q) >= 0.4::DOUBLE"))
def j12_pass_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Sure words (p of .4 or more) of the hinted pass with those of the unprompted pass within 1.2 s, which heard every word half a second late."""
    n = T.notes(spark, sf).where("lyric != ''")
    h = n.select("recording_id", "frame_id", "onset", "lyric", F.col("rms").alias("p"), (F.col("onset") - 1.3).alias("lo"), (F.col("onset") + 1.3).alias("hi"))
    o = n.select("recording_id", F.col("frame_id").alias("other"), (F.col("onset") + 0.5).alias("at"), F.col("lyric").alias("variant"), F.col("rms").alias("q"))
    d = interval_join(o, h, ["recording_id"], "at", "lo", "hi", 3.0).where((F.abs(F.col("at") - F.col("onset")) < 1.2) & (F.least("p", "q") >= 0.4))
    return d.select("frame_id", "other", (F.col("variant") == F.col("lyric")).alias("same"))


@query()
def h4_h5_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Reference words against a hinted and an unprompted pass that each miss, change or add some: counts of each status by block."""
    pos = F.col("pos")
    w = T.words(spark, sf).select("recording_id", F.floor(pos / 24).cast("int").alias("block"), pos.alias("pos"), X.latin_key(F.col("word")).alias("word"), "start", "p", "segment")
    row = F.struct("pos", "word", "start", "p", "segment")
    blocks = w.groupBy("recording_id", "block").agg(F.array_sort(F.collect_list(row)).alias("w"))
    kinds = ("heard", "reference-spelling", "sung-variant", "not-heard", "extra-sung")

    def heard(own: list, drop: int, late: float) -> Y.Heard:
        """All words but each ``drop``th; each eleventh is another word, each thirteenth is followed by one more."""
        said = []
        for x in own:
            k, t = x["pos"], x["start"] + late
            if k % drop:
                said.append(("zonk" if k % 11 == 0 else x["word"], t, x["p"]))
            if k % 13 == 0:
                said.append(("quux", t + 0.2, 0.9))
        text, start, p = zip(*said, strict=True) if said else ((), (), ())
        return Y.Heard(list(text), np.array(start, float), np.array(start, float) + 0.15, np.array(p, float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec, block, own in zip(pdf["recording_id"], pdf["block"], pdf["w"], strict=True):
                line = np.array([x["segment"] for x in own])
                found = Y.reconcile([x["word"] for x in own], line, line // 4, {"hinted": heard(own, 7, 0.0), "plain": heard(own, 5, 0.1)})
                status = [x.status for x in found]
                out.append((rec, block, *(status.count(k) for k in kinds), sum(x.anchor == "interpolated" for x in found), sum(x.anchor == "none" for x in found)))
            yield pd.DataFrame(out, columns=["recording_id", "block", *[k.replace("-", "_") for k in kinds], "interpolated", "without_time"])

    return blocks.mapInPandas(run, "recording_id long, block int, " + ", ".join(f"{k.replace('-', '_')} long" for k in kinds) + ", interpolated long, without_time long")


@query()
def h7_units_to_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The note that carries each lyric unit of a section: words a tenth of a second late, those without a text weak and without a time."""
    n = T.with_section(T.notes(spark, sf)).select("recording_id", "section", "frame_id", "onset", "end", "midi", "line", "lyric")
    return C.place_units(n.drop("line", "lyric"), _units(n), ["recording_id", "section"], "frame_id", "unit")


def _units(n: DataFrame) -> DataFrame:
    """Lyric units of notes: recording_id, section, unit, start, end, weak, line_start, in the order of their notes."""
    w = Window.partitionBy("recording_id", "section").orderBy(*ORDER)
    sure = F.col("lyric") != ""
    at = F.when(sure, F.col("onset") + 0.1)
    return n.select("recording_id", "section", F.col("frame_id").alias("unit"), F.row_number().over(w).alias("_order"), at.alias("start"), (at + 0.2).alias("end"), (~sure).alias("weak"), F.coalesce(F.col("line") != F.lag("line").over(w), F.lit(True)).alias("line_start"))


@query()
def h17_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """The atom table of every voiced run: a run of a pitch is cut at its loudness dips; times divided by ten, as the data's are that much longer."""
    f = _tuned_runs(spark, sf).withColumn("t", F.col("t") / 10)

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        t, midi, voiced, rms = (p[c].to_numpy() for c in ("t", "midi", "voiced", "rms"))
        path = Q.absorb_short(Q.pitch_states(midi, voiced), 2)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        rows = []
        for a, b in zip(edge, edge[1:], strict=False):
            end = float(t[b - 1]) + 0.01
            at, depth = Q.dips(t, rms, float(t[a]), end)
            rows += Q.cut_run(t[a:b], midi[a:b], voiced[a:b], int(path[a]), float(t[a]), end, t[at], depth)
        out = pd.DataFrame(rows, columns=["onset", "end", "midi", "median", "glide", "depth"])
        out.insert(0, "recording_id", p["recording_id"].iloc[0])
        return out

    return Q.by_key(f, ["recording_id", "run"], ["t", "frame_id"], fn, "recording_id long, onset double, end double, midi int, median double, glide double, depth double")


@query()
def t7_reattacks(spark: SparkSession, sf: str) -> DataFrame:
    """Frames where a held sound is struck again, for each voiced run's loudness as one held pitch; three frames a piece here."""
    return Q.by_key(_tuned_runs(spark, sf), ["recording_id", "run"], ["t", "frame_id"], lambda p: p[["frame_id"]].iloc[Q.reattacks(p["rms"].to_numpy(), least=3)], "frame_id long")


_STR = {"g": 'SELECT *, CASE WHEN onset - lag("end") OVER w < 1.2::DOUBLE THEN 0 ELSE 1 END AS new FROM notes WINDOW w AS (PARTITION BY recording_id ORDER BY onset, frame_id)', "h": "SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY onset, frame_id) AS grp FROM g", "st": 'SELECT recording_id, grp, min(onset) AS a, max("end") AS z FROM h GROUP BY ALL', "x": "SELECT *, lead(a) OVER (PARTITION BY recording_id ORDER BY grp) - z AS gap FROM st"}


@query(duck("notes", more={**_STR, "e": "SELECT recording_id, min(z) FILTER (WHERE z >= 15 AND gap >= 4) AS first_end, arg_max(z, {'g': gap, 'z': -z}) FILTER (WHERE z BETWEEN 24 AND 45 AND gap IS NOT NULL) AS widest FROM x GROUP BY 1"}, body="SELECT recording_id, round_even(coalesce(CASE WHEN first_end <= 45 THEN first_end END, widest) * 100, 0) / 100 AS excerpt_end FROM e"))
def w24_excerpt_end(spark: SparkSession, sf: str) -> DataFrame:
    """Where an excerpt ends: the first stretch of 15 s or later before a long silence, else the widest gap from 24 to 45 s."""
    from melodyspark.operators.islands import stretches

    st = stretches(T.notes(spark, sf), 1.2, ["recording_id"], ORDER)
    x = st.withColumn("gap", F.lead("start").over(Window.partitionBy("recording_id").orderBy("grp")) - F.col("end"))
    z = F.col("end")
    e = x.groupBy("recording_id").agg(F.min(F.when((z >= 15) & (F.col("gap") >= 4), z)).alias("first"), F.max(F.when(z.between(24, 45) & F.col("gap").isNotNull(), F.struct(F.col("gap"), (-z).alias("n")))).alias("w"))
    return e.select("recording_id", S.round_to(F.coalesce(F.when(F.col("first") <= 45, F.col("first")), -F.col("w.n")), 2).alias("excerpt_end"))


_LOC = {"blk": "SELECT recording_id, section, count(*) AS n, count(*) FILTER (WHERE frame_id % 4 <> 3) AS heard, min(onset) FILTER (WHERE frame_id % 4 <> 3) AS a, max(\"end\") FILTER (WHERE frame_id % 4 <> 3) AS z FROM secnotes GROUP BY ALL", "ok": "SELECT *, lag(z) OVER (PARTITION BY recording_id ORDER BY section) AS pz FROM blk WHERE heard >= greatest(3, 0.3::DOUBLE * n)",
    "gp": 'SELECT recording_id, pe, onset, (pe + onset) / 2 AS mid FROM (SELECT *, lag("end") OVER (PARTITION BY recording_id ORDER BY onset, frame_id) AS pe FROM notes) WHERE pe IS NOT NULL', "pk": "SELECT o.recording_id, o.section, arg_max(mid, {'g': onset - pe, 'm': mid}) AS mid FROM ok o JOIN gp g ON g.recording_id = o.recording_id AND mid >= pz AND mid <= a GROUP BY ALL"}


@query(duck("secnotes", more=_LOC, body="SELECT o.recording_id, o.section, o.heard, round_even(coalesce(p.mid, a) * 1e3, 0) / 1e3 AS start, round_even(z * 1e3, 0) / 1e3 AS \"end\" FROM ok o LEFT JOIN pk p ON p.recording_id = o.recording_id AND p.section = o.section"))
def h16_locate_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by their anchored words: absent ones are left out, a boundary sits in the widest silence before the first anchor."""
    n = T.with_section(T.notes(spark, sf))
    sure = lambda c: F.when(F.col("frame_id") % 4 != 3, F.col(c))
    blocks = n.groupBy("recording_id", "section").agg(F.count(F.lit(1)).alias("n"), F.count(sure("onset")).alias("heard"), F.min(sure("onset")).alias("a"), F.max(sure("end")).alias("z"))
    ok = blocks.where(F.col("heard") >= F.greatest(F.lit(3.0), 0.3 * F.col("n"))).withColumn("pz", F.lag("z").over(Window.partitionBy("recording_id").orderBy("section")))
    prev = F.lag("end").over(Window.partitionBy("recording_id").orderBy(*ORDER))
    gaps = n.withColumn("pe", prev).where("pe is not null").select("recording_id", (F.col("onset") - F.col("pe")).alias("gap"), ((F.col("pe") + F.col("onset")) / 2).alias("mid"))
    # the range is closed: its end is moved up by less than any time differs
    room = ok.where("pz is not null and pz <= a").select("recording_id", "section", "pz", (F.col("a") + 1e-9).alias("upto"))
    pick = interval_join(gaps, room, ["recording_id"], "mid", "pz", "upto", 20.0).groupBy("recording_id", "section").agg(F.max_by("mid", F.struct("gap", "mid")).alias("mid"))
    out = ok.join(pick, ["recording_id", "section"], "left")
    return out.select("recording_id", "section", "heard", S.round_to(F.coalesce("mid", "a"), 3).alias("start"), S.round_to(F.col("z"), 3).alias("end"))


_K = "recording_id, block"
#: blocks of a minute, each fifth without verses; verses are sections of 20 s, some overridden, some absent; three notes in four are anchored words
_H16 = {
    "blk": "SELECT DISTINCT recording_id, floor(onset / 60)::INT AS block, floor(onset / 60) * 60.0::DOUBLE AS bs, floor(onset / 60) * 60.0::DOUBLE + 60 AS be, CASE WHEN (recording_id + floor(onset / 60)::INT) % 5 = 0 THEN 0.9::DOUBLE END AS part_gap FROM notes",
    "bn": 'SELECT n.recording_id, frame_id, onset, "end", block, part_gap FROM notes n JOIN blk b ON n.recording_id = b.recording_id AND onset >= bs AND onset < be',
    "vs": """SELECT recording_id, section // 3 AS block, section % 3 AS verse, count(*) AS tokens, count(*) FILTER (WHERE frame_id % 4 <> 3) AS anchored, min(onset) FILTER (WHERE frame_id % 4 <> 3) + (section % 2) * 4 AS s0,
        max("end") FILTER (WHERE frame_id % 4 <> 3) + (section % 2) * 4 AS s1, CASE WHEN (recording_id + section) % 7 = 0 THEN section * 20.0::DOUBLE + 1 END AS os, CASE WHEN (recording_id + section) % 7 = 0 THEN section * 20.0::DOUBLE + 19 END AS oe, (recording_id + section) % 11 = 0 AS absent FROM secnotes GROUP BY recording_id, section""",
    "fd": "SELECT v.*, bs, be, CASE WHEN os IS NULL THEN s0 END AS a0, CASE WHEN os IS NULL THEN s1 END AS a1 FROM vs v JOIN blk USING (recording_id, block) WHERE NOT absent AND part_gap IS NULL AND (os IS NOT NULL OR anchored >= greatest(3, 0.3::DOUBLE * tokens))",
    "nx": f"SELECT *, lead(verse) OVER w AS nv, lead(a0) OVER w AS na, lead(os) OVER w AS nos, coalesce(a1, oe, lead(a0) OVER w) - 0.3::DOUBLE AS lo FROM fd WINDOW w AS (PARTITION BY {_K} ORDER BY verse)",
    "gp": f'SELECT {_K}, onset - pe AS gap, (pe + onset) / 2 AS mid FROM (SELECT *, lag("end") OVER (PARTITION BY {_K} ORDER BY onset, frame_id) AS pe FROM bn WHERE part_gap IS NULL) WHERE pe IS NOT NULL',
    "md": f"SELECT n.recording_id, n.block, verse, arg_max(mid, {{'g': gap, 'm': mid}}) AS mid FROM nx n JOIN gp g ON g.recording_id = n.recording_id AND g.block = n.block AND mid >= lo AND mid <= na + 1.2::DOUBLE GROUP BY ALL",
    "bd": f"SELECT n.*, CASE WHEN nv IS NOT NULL THEN coalesce(nos, {r('coalesce(mid, (lo + na) / 2)', 2)}) END AS bound FROM nx n LEFT JOIN md USING ({_K}, verse)",
    "lc": f'SELECT {_K}, verse, CASE WHEN os IS NULL THEN \'anchored\' ELSE \'override\' END AS located, a0, coalesce(lag(bound) OVER w, os, bs) AS start, CASE WHEN nv IS NULL THEN coalesce(oe, be) ELSE bound END AS "end" FROM bd WINDOW w AS (PARTITION BY {_K} ORDER BY verse)',
    "ow": f'SELECT b.recording_id, b.block, verse, a0, frame_id, onset, b."end", lag(b."end") OVER w AS pe FROM bn b JOIN lc l ON l.recording_id = b.recording_id AND l.block = b.block AND a0 IS NOT NULL AND onset >= l.start AND onset < l."end" WINDOW w AS (PARTITION BY b.recording_id, b.block, verse ORDER BY onset, frame_id)',
    "os1": f"SELECT *, sum((pe IS NULL OR onset - pe >= 1.2::DOUBLE)::INT) OVER (PARTITION BY {_K}, verse ORDER BY onset, frame_id) AS st FROM ow",
    "ld": f'SELECT {_K}, verse, a0, arg_max(z, st) AS z FROM (SELECT {_K}, verse, a0, st, arg_max("end", {{\'o\': onset, \'f\': frame_id}}) AS z FROM os1 GROUP BY ALL) WHERE z < a0 - 0.6::DOUBLE GROUP BY ALL',
    "lm": "SELECT l.recording_id, l.block, l.verse, arg_max((pe + onset) / 2, {'g': onset - pe, 'm': (pe + onset) / 2}) AS mid FROM ld l JOIN ow o ON o.recording_id = l.recording_id AND o.block = l.block AND o.verse = l.verse AND (pe + onset) / 2 >= z - 0.1::DOUBLE AND (pe + onset) / 2 <= l.a0 + 0.1::DOUBLE GROUP BY ALL",
    "sp": f"SELECT {_K}, verse, {r('coalesce(mid, a0 - 0.3::DOUBLE)', 2)} AS split FROM ld LEFT JOIN lm USING ({_K}, verse)",
    "ap": f"""SELECT {_K}, frame_id, onset, "end", '-x' AS sign, 1.2::DOUBLE AS g FROM bn b WHERE part_gap IS NULL AND NOT EXISTS (SELECT 1 FROM lc l WHERE l.recording_id = b.recording_id AND l.block = b.block AND b.onset >= l.start AND b.onset < l."end")
        UNION ALL SELECT {_K}, frame_id, onset, "end", '-', part_gap FROM bn WHERE part_gap IS NOT NULL""",
    "as1": f'SELECT *, CASE WHEN onset - lag("end") OVER w >= g THEN 1 WHEN lag("end") OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ap WINDOW w AS (PARTITION BY {_K}, sign ORDER BY onset, frame_id)',
    "as2": f"SELECT *, sum(new) OVER (PARTITION BY {_K}, sign ORDER BY onset, frame_id) AS st FROM as1",
    "ev": f"""SELECT {_K}, block || '-' || (verse + 1) AS section, 'sung' AS kind, coalesce(split, start) AS start, "end", located FROM lc LEFT JOIN sp USING ({_K}, verse)
        UNION ALL SELECT {_K}, block || '-' || (verse + 1) || '-lead', 'wordless', start, split, 'before the first word' FROM lc JOIN sp USING ({_K}, verse)
        UNION ALL SELECT {_K}, block || sign || st, 'unscripted', {r('min(onset) - 0.05::DOUBLE', 2)}, {r("arg_max(\"end\", {'o': onset, 'f': frame_id}) + 0.05::DOUBLE", 2)}, 'outside the verses' FROM as2 GROUP BY {_K}, sign, st""",
    "hd": """SELECT e.recording_id, section, count(*) AS notes, sum(n."end" - onset) AS sung, arg_max(n."end", {'o': onset, 'f': frame_id}) - min(onset) AS span FROM ev e JOIN notes n ON n.recording_id = e.recording_id AND onset >= e.start AND onset < e."end" GROUP BY ALL""",
}


@query(duck("secnotes", more=_H16, body=f"SELECT e.recording_id, e.section, kind, {r('start', 2)} AS start, {r('\"end\"', 2)} AS \"end\", located, coalesce(notes, 0) AS notes, kind = 'wordless' AND (coalesce(notes, 0) < 6 OR coalesce(sung < 0.5::DOUBLE * span, false)) AS excluded FROM ev e LEFT JOIN hd h ON h.recording_id = e.recording_id AND h.section = e.section"))
def h16_all_sections(spark: SparkSession, sf: str) -> DataFrame:
    """All sections of all recordings by the whole rule: verses, lead-ins, parts of blocks without verses, and singing outside them."""
    from melodyspark.operators import sections as B

    n = T.with_section(T.notes(spark, sf))
    block = F.floor(F.col("onset") / 60).cast("int")
    blocks = n.select("recording_id", block.alias("block")).distinct()
    blocks = blocks.select("recording_id", "block", (F.col("block") * 60.0).alias("start"), (F.col("block") * 60.0 + 60).alias("end"), F.when((F.col("recording_id") + F.col("block")) % 5 == 0, 0.9).alias("part_gap"))
    sure = lambda c: F.when(F.col("frame_id") % 4 != 3, F.col(c))
    v = n.groupBy("recording_id", "section").agg(F.count(F.lit(1)).alias("tokens"), F.count(sure("onset")).alias("anchored"), F.min(sure("onset")).alias("s0"), F.max(sure("end")).alias("s1"))
    late, over = (F.col("section") % 2) * 4, (F.col("recording_id") + F.col("section")) % 7 == 0
    v = v.select(
        "recording_id", F.expr("cast(section div 3 as int)").alias("block"), (F.col("section") % 3).alias("verse"), "tokens", "anchored", (F.col("s0") + late).alias("anchor_start"), (F.col("s1") + late).alias("anchor_end"),
        F.when(over, F.col("section") * 20.0 + 1).alias("o_start"), F.when(over, F.col("section") * 20.0 + 19).alias("o_end"), ((F.col("recording_id") + F.col("section")) % 11 == 0).alias("absent"),
    )
    v = v.join(blocks.where("part_gap is null").select("recording_id", "block"), ["recording_id", "block"])
    out = B.find_sections(n, blocks, v, ["recording_id"], "frame_id")
    return out.select("recording_id", "section", "kind", S.round_to(F.col("start"), 2).alias("start"), S.round_to(F.col("end"), 2).alias("end"), "located", "notes", "excluded")


@query()
def j13_a15_sister_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """The pitch class that other sections sing at each syllable, in the section's own key; lines of five seconds."""
    q = F.row_number().over(Window.partitionBy("recording_id", "section", "line").orderBy(*ORDER)) - 1
    n = T.with_section(T.notes(spark, sf)).withColumn("q", q).select("recording_id", "section", F.lit(0).alias("verse"), (F.col("line") % 4).alias("line"), "q", "midi")
    return Z.sister_expectations(n, "recording_id", "section", to_one_key(n, "recording_id", "section"))


def to_one_key(syllables: DataFrame, key: str, section: str) -> DataFrame:
    """key, section, shift: the transposition that brings each section's tune nearest to that of the longest (of equals the first)."""
    order = F.struct("verse", "line", "q", "midi")
    tunes = syllables.where("midi is not null").groupBy(key, section).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["midi"]).alias("_ms"))
    longest = tunes.groupBy(key).agg(F.max(F.struct(F.size("_ms").alias("n"), (-F.col(section)).alias("s"), F.col("_ms").alias("ms"))).alias("_r"))
    text = lambda notes, shift: F.array_join(F.transform(notes, lambda m: F.char(m + F.lit(20 + shift))), "")
    both = tunes.join(longest, key)
    tries = F.array_min(F.array(*[F.struct(F.levenshtein(text(F.col("_ms"), k), text(F.col("_r.ms"), 0)).alias("edits"), F.lit(k).alias("shift")) for k in SHIFTS]))
    return both.select(key, section, F.when(F.col(section) == -F.col("_r.s"), 0).otherwise(tries["shift"]).alias("shift"))


@query()
def w24_excerpt_end_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Where each recording's excerpt ends: interlude, another register or wordless singing, else the widest gap."""
    n = T.notes(spark, sf).select("recording_id", "frame_id", "onset", "end", "midi", "lyric")

    def fn(p: pd.DataFrame) -> pd.DataFrame:
        sung = p["lyric"] != ""
        end = Q.excerpt_end(*(p[c].to_numpy() for c in ("onset", "end", "midi")), p["onset"][sung].to_numpy(), p["end"][sung].to_numpy())
        return pd.DataFrame({"recording_id": [int(p["recording_id"].iloc[0])], "excerpt_end": [end]})

    return Q.by_key(n, ["recording_id"], ORDER, fn, "recording_id long, excerpt_end double")


@query(duck("notes", body="SELECT recording_id, frame_id, (row_number() OVER (PARTITION BY recording_id ORDER BY onset, \"end\", frame_id) - 1)::INT AS position FROM notes"))
def t4_events_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """All events of a recording in order of time, with their positions; recordings are never sorted among each other."""
    w = Window.partitionBy("recording_id").orderBy("onset", "end", "frame_id")
    return T.notes(spark, sf).select("recording_id", "frame_id", (F.row_number().over(w) - 1).alias("position"))
