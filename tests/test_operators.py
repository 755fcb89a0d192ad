"""Operators on small hand-made tables, and helpers against brute force."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from melodyspark.jobs.sequence_queries import to_one_key
from melodyspark.operators import charting, edits, intervals, islands, quality, scoring, sequences, stats
from melodyspark.streaming import live


def test_interval_join_is_half_open_and_keeps_empty_intervals(spark):
    p = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 9.99), (1, 10.0), (2, 5.0)], "k long, t double")
    i = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 1.0, 1.5), (2, "c", 6.0, 7.0)], "k long, n string, s double, e double")
    got = intervals.interval_join(p, i, ["k"], "t", "s", "e", 2.0, how="right").select("n", "t").collect()
    assert sorted((r["n"], r["t"]) for r in got if r["t"] is not None) == [("a", 0.0), ("a", 1.0), ("a", 9.99), ("b", 1.0)]
    assert [r["n"] for r in got if r["t"] is None] == ["c"]


def test_nearest_takes_the_earlier_of_equals(spark):
    a = spark.createDataFrame([(1, 2.0, 1), (1, 9.0, 2), (1, 0.0, 3)], "k long, t double, i long")
    b = spark.createDataFrame([(1, 1.0), (1, 3.0)], "k long, r double")
    got = intervals.nearest(a, b, ["k"], "t", "r", "i").collect()
    assert {r["i"]: r["nearest"] for r in got} == {1: 1.0, 2: 3.0, 3: 1.0}


def test_overlap_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 50.0)], "k long, lo double, hi double")
    b = spark.createDataFrame([(1, 1.0, 30.0), (1, 50.1, 51.0), (1, 60.0, 61.0)], "k long, start double, end double")
    assert sorted(r["start"] for r in intervals.overlap_join(a, b, ["k"], 0.2, 5.0).collect()) == [1.0, 50.1]


def test_islands_and_fill(spark):
    n = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.1, 2.0), (1, 3, 3.2, 4.0)], "k long, frame_id long, onset double, end double")
    got = islands.stretches(n, 1.2, ["k"], ["onset"]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["notes"]) for r in got] == [(0.0, 2.0, 2), (3.2, 4.0, 1)]
    v = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 3, None), (1, 4, 8.0), (1, 5, None)], "k long, i long, v double")
    out = v.select("i", islands.fill_linear(v, ["k"], "i", "v").alias("f")).orderBy("i").collect()
    assert [r["f"] for r in out] == [None, 4.0, 6.0, 8.0, None]


def test_key_of_silence_and_ties(spark):
    f = spark.createDataFrame([(1, 60.0, False), (2, 60.0, True)], "recording_id long, midi double, voiced boolean")
    assert {r["recording_id"]: r["tonic"] for r in stats.detect_key(f).collect()} == {1: 0, 2: 0}


def test_consensus(spark):
    n = spark.createDataFrame([("fix", 60), ("octave", 60), ("leap", 60), ("conflict", 60), ("weak", 60)], "id string, midi int")
    rows = []
    for name, a, b, cover in (("fix", 62.0, 62.1, 0.9), ("octave", 72.0, 72.1, 0.9), ("leap", 65.0, 65.1, 0.9), ("conflict", 62.0, 64.0, 0.9), ("weak", 62.0, 62.1, 0.5)):
        rows += [(name, "a", a, 9, cover, 0.9, 0.9), (name, "b", b, 9, cover, 0.9, 0.9)]
    r = spark.createDataFrame(rows, "id string, reader string, median double, frames int, coverage double, stable double, support double")
    assert {x["id"]: x["new"] for x in quality.consensus(n, r, "id").collect()} == {"fix": 62, "octave": 72}


def test_edits(spark):
    n = spark.createDataFrame([(1, 1, 0.0, 1.0, 60), (1, 2, 1.0, 2.0, 62), (1, 3, 2.0, 3.0, 64), (1, 4, 3.0, 4.0, 65)], "k long, frame_id long, onset double, end double, midi int")
    e = spark.createDataFrame([(1, 1, 0.001, 60, "split", 61, 0.5), (2, 1, 1.0, 62, "join", None, None), (3, 1, 3.0, 60, "midi", 70, None), (4, 1, 9.0, 60, "midi", 70, None)], "edit_id long, k long, onset double, old int, op string, new int, at double")
    found = edits.locate(e, n, "k")
    assert {r["edit_id"]: r["stale"] for r in found.collect()} == {1: False, 2: False, 3: True, 4: True}
    out = edits.apply_edits(n, found, "k").orderBy("onset").collect()
    assert [(r["onset"], r["end"], r["midi"]) for r in out] == [(0.0, 0.5, 60), (0.5, 1.0, 61), (1.0, 3.0, 62), (3.0, 4.0, 65)]


def test_alignment_is_cheapest():
    cost = lambda a, b: float(a != b)
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = ([str(x) for x in rng.integers(0, 3, rng.integers(1, 6))] for _ in range(2))
        got = sequences.align(a, b, cost)
        price = sum(0.8 if i < 0 or j < 0 else cost(a[i], b[j]) for i, j in got)

        def least(i, j, a=a, b=b):
            if i == len(a) or j == len(b):
                return 0.8 * (len(a) - i + len(b) - j)
            return min(cost(a[i], b[j]) + least(i + 1, j + 1), 0.8 + least(i + 1, j), 0.8 + least(i, j + 1))

        assert abs(price - least(0, 0)) < 1e-9
        assert [i for i, _ in got if i >= 0] == list(range(len(a))) and [j for _, j in got if j >= 0] == list(range(len(b)))


def test_ordered_anchors_against_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(30):
        t, w = rng.integers(0, 5, 7).astype(float), rng.integers(1, 3, 7)
        best = max(sum(w[list(s)]) for k in range(8) for s in itertools.combinations(range(7), k) if all(t[a] <= t[b] for a, b in itertools.pairwise(s)))
        keep = sequences.ordered_anchors(t, w)
        assert sum(w[keep]) == best and (np.diff(t[keep]) >= 0).all()


def test_paths_phrases_pieces():
    midi = np.array([60.1, 60.0, 59.9, 65.0, 60.0, 64.1, 64.0, 63.9, 64.0])
    assert sequences.pitch_states(midi, np.ones(9, bool)).tolist() == [60] * 5 + [64] * 4
    assert sequences.absorb_short(np.array([60, 60, 61, 64, 64]), 2).tolist() == [60, 60, 64, 64, 64]
    t = np.arange(14.0)
    none = np.zeros(14, bool)
    assert sequences.phrases(np.zeros(14, int), np.full(14, -1), none, t, t + 0.9).max() == 2
    assert sequences.spaced(np.array([3.0, 1.0, 2.0]), np.array([0.0, 1.0, 1.5]), 1.0).tolist() == [True, True, False]


def test_short_runs_join_the_next_one():
    assert sequences.absorb_short(np.array([60, 61, 62, 63, 63, 63]), 2).tolist() == [61, 61, 63, 63, 63, 63]
    assert sequences.absorb_short(np.array([60, 60, 61, 61, 62]), 2).tolist() == [60, 60, 61, 61, 61]
    assert sequences.absorb_short(np.array([60]), 2).tolist() == [60]


def test_octave_errors():
    t = np.arange(3) * 1.0
    fix = lambda midi, at=t: sequences.octave_repairs(np.array(midi), np.asarray(at)).tolist()
    assert fix([60, 61, 72, 60, 62], np.arange(5.0)) == [60, 61, 60, 60, 62]
    # ends are repaired too, the first of two goes up, and the worst neighbour counts
    assert fix([72, 60, 62]) == [60, 60, 62] and fix([60, 62, 50]) == [60, 62, 62]
    assert fix([60, 72, 62]) == [72, 72, 74] and fix([60, 72, 70]) == [72, 72, 70]
    # neighbours 1.5 s away or more are none
    assert fix([60, 72, 62], [0, 1.5, 3.0]) == [60, 72, 62]


def test_octave_errors_of_many_stretches_in_one_stream(spark):
    """Stretches one after another take what each takes alone, and the query makes no pandas frame for each."""
    from melodyspark.jobs import catalogue

    rng = np.random.default_rng(2)
    parts = [(60 + rng.choice([0, 1, 12, -12, 9, 24], n), np.cumsum(rng.choice([0.3, 1.4, 1.5], n))) for n in rng.integers(1, 12, 60)]
    first = np.cumsum([0] + [len(m) for m, _ in parts])[:-1]
    got = sequences.octave_repairs(*(np.concatenate([p[k] for p in parts]) for k in range(2)), first=first)
    assert got.tolist() == np.concatenate([sequences.octave_repairs(*p) for p in parts]).tolist()
    assert "InPandas" not in catalogue.QUERIES["w13_octave_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_phrases_start_where_lines_do():
    t = np.arange(8.0)
    num = lambda line, starts, gap=0.1: sequences.phrases(np.zeros(8, int), np.array(line), np.array(starts, bool), t, t + 1 - gap).tolist()
    assert num([0] * 4 + [1] * 4, [0] * 4 + [1] * 4) == [1] * 4 + [2] * 4
    # another line that is not a line start goes on
    assert num([0] * 4 + [1] * 4, [0] * 8) == [1] * 8
    # a breath counts after six notes of a line, and at once in wordless singing
    assert num([0] * 8, [0] * 8, 0.5) == [1] * 6 + [2] * 2
    assert num([-1] * 8, [0] * 8, 0.5) == list(range(1, 9))


def test_pieces_cut_at_silences_or_at_26_seconds():
    onset = np.array([0.0, 10.0, 20.0, 40.0, 60.0])
    end = np.array([9.0, 18.0, 39.0, 59.5, 70.0])
    # the widest silence is at 18-20; the next 26 s hold one at 39-40; the last one at 59.5-60
    assert sequences.pieces(onset, end, 0.0, 70.0) == [(0.0, 19.0), (19.0, 39.5), (39.5, 59.75), (59.75, 70.0)]
    assert sequences.pieces(np.array([0.0]), np.array([60.0]), 0.0, 60.0) == [(0.0, 26.0), (26.0, 52.0), (52.0, 60.0)]
    # a silence within six seconds of the last cut is none
    assert sequences.pieces(np.array([0.0, 6.0]), np.array([5.0, 30.0]), 0.0, 30.0) == [(0.0, 26.0), (26.0, 30.0)]


def test_dips_atoms_and_reattacks():
    t = np.arange(200) * 0.005
    rms = np.ones(200) - 0.75 * np.exp(-(((t - 0.3) / 0.02) ** 2)) - 0.2 * np.exp(-(((t - 0.7) / 0.02) ** 2))
    at, depth = sequences.dips(t, rms, 0.0, 1.0)
    assert t[at].round(2).tolist() == [0.3, 0.7] and depth[0] < 0.4 < 0.7 < depth[1] < 0.9
    rows = sequences.cut_run(t, np.full(200, 60.2), np.ones(200, bool), 60, 0.0, 1.0, t[at], depth)
    assert [(round(a, 2), round(b, 2), p) for a, b, p, *_ in rows] == [(0.0, 0.3, 60), (0.3, 0.7, 60), (0.7, 1.0, 60)] and rows[0][5] is None
    # dips within .15 s of a clearer one, or within .10 s of an end, do not cut
    rows = sequences.cut_run(t, np.full(200, 60.2), np.ones(200, bool), 60, 0.0, 1.0, np.array([0.05, 0.3, 0.4, 0.95]), np.array([0.1, 0.2, 0.5, 0.1]))
    assert [round(a, 2) for a, *_ in rows] == [0.0, 0.3]
    loud = np.ones(80)
    loud[38:43] = 0.1
    assert sequences.reattacks(loud) == [39] and sequences.reattacks(loud[:36]) == [] and sequences.reattacks(np.ones(80)) == []


def test_streaming_steps_do_not_depend_on_batches():
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.random(60) / 10)
    rows = pd.DataFrame({"frame_id": range(60), "t": t, "midi": rng.integers(50, 80, 60).astype(float), "voiced": rng.random(60) < 0.8, "hit": rng.random(60) < 0.7, "expected": 60.0, "phrase": (t // 1).astype(int), "step": (t // 1).astype(int), "run": (t // 1.5).astype(int)})
    for step in (live.combo_step, live.confirm_step, live.register_step, lambda now, x: live.setup_step(now, x, least=0.1, tolerance=12.0)):
        whole, made = step({}, rows)
        state, parts = {}, []
        for i in range(0, 60, 7):
            state, some = step(state, rows[i : i + 7])
            parts += some
        assert str(state) == str(whole)
        if step is not live.combo_step:
            assert parts == made


def _samples(*rows, **same):
    return pd.DataFrame([dict(zip(("t", "midi", "voiced"), r, strict=True)) for r in rows]).assign(frame_id=range(len(rows)), **same)


def test_a_new_run_begins_anew():
    rows = pd.DataFrame({"t": [0.0, 1.0, 2.0, 0.5, 3.0, 1.5], "hit": [True, True, True, True, False, True], "run": [1, 1, 1, 2, 1, 2]})
    state, made = live.combo_step({}, rows)
    # the late sample of the first run is ignored
    assert made == [(1, 3, 3, 3), (2, 2, 2, 2)] and state["run"] == 2


def test_jumps_are_confirmed():
    # the first pitch at once; a glitch is held; a jump that lasts 25 ms counts; a gap holds; silence clears
    rows = _samples((0.0, 60.0, True), (0.010, 72.0, True), (0.030, 72.0, True), (0.036, 72.0, True), (0.1, 0.0, False), (0.2, 72.0, True), (0.5, 0.0, False))
    assert [p for _, p in live.confirm_step({}, rows)[1]] == [60.0, 60.0, 60.0, 72.0, 72.0, 72.0, None]
    assert live.confirm_quiet({"pitch": 60.0}) == ({"pitch": 60.0}, [(None, None)]) and live.confirm_quiet({"pitch": float("nan")})[1] == []


def test_the_register_changes_between_phrases():
    def octaves(rows, phrase):
        return [o for _, o in live.register_step({}, _samples(*rows, expected=52.0).assign(phrase=phrase))[1]]

    up = [(0.01, 64.0, True), (0.04, 64.0, True), (0.10, 64.0, True)]
    assert octaves(up, 1) == [0, 0, 1]
    # 80 ms of evidence, silence and other pitches interrupt it
    assert octaves([(0.01, 64.0, True), (0.02, 0.0, False), (0.32, 64.0, True)], 1) == [0, 0, 0]
    assert octaves([(0.01, 64.0, True), (0.05, 66.0, True), (0.12, 64.0, True)], 1) == [0, 0, 0]
    # a phrase that began right keeps its register, the next one may change
    rows = [(0.0, 52.0, True), (0.1, 64.0, True), (0.3, 64.0, True), (0.4, 64.0, True), (0.5, 64.0, True)]
    assert octaves(rows, [1, 1, 1, 2, 2]) == [0, 0, 0, 0, 1]


def test_voice_setup():
    match = lambda t: [(x, 60.3, True) for x in t]
    steps = lambda rows: [m[0] for m in live.setup_step({}, _samples(*rows, expected=60.0, step=4))[1]]
    assert steps(match([0.0, 0.1, 0.2, 0.3, 0.4])) == [4]
    assert steps(match([0.0, 0.1, 0.2])) == [] and steps(match([0.0, 0.1, 0.25, 0.35])) == []
    # another octave is no match, and neither is a pitch class that is off
    assert steps([(x / 20, 72.0, True) for x in range(20)]) == [] and steps([(x / 20, 63.0, True) for x in range(20)]) == []


def test_excerpt_ends():
    onset = np.arange(60) * 1.0
    end = onset + 0.7
    midi = np.full(60, 60)
    cut = lambda end=end, midi=midi, words=onset, onset=onset: sequences.excerpt_end(onset, end, midi, words, words + 0.5)
    gone = onset.copy()
    gone[20:] += 2.5
    assert cut(onset=gone, end=gone + 0.7, words=gone) == 19.7
    high = midi.copy()
    high[30:] = 67
    parted = onset.copy()
    parted[30:] += 0.5
    assert cut(onset=parted, end=parted + 0.7, midi=high, words=parted) == 29.7
    assert cut(onset=parted, end=parted + 0.7, words=parted[:30]) == 29.7
    # nothing of the kind: before the widest gap from 24 to 45 s
    wide = onset.copy()
    wide[28:] += 0.3
    wide[40:] += 0.6
    assert cut(onset=wide, end=wide + 0.7, words=wide) == round(39.3 + 0.7, 1) or abs(cut(onset=wide, end=wide + 0.7, words=wide) - 40.0) < 1e-9
    assert cut(end=onset + 0.99) == 59.99


def test_attacks_move_to_strong_dips(spark):
    t = np.arange(0, 2.0, 0.005)
    dip = lambda at, depth: 1 - depth * np.exp(-(((t - at) / 0.012) ** 2))
    move = lambda rms, boundary=1.0: sequences.attack_move(0.0, boundary, 2.0, t, rms)
    assert move(dip(1.06, 0.8)) == 1.06 and move(dip(0.95, 0.8)) == 0.95
    assert move(np.ones(len(t))) is None and move(dip(1.06, 0.5)) is None and move(dip(1.12, 0.8)) is None and move(dip(1.01, 0.8)) is None
    # the boundary is as clear an attack itself
    assert move(dip(1.06, 0.8) * dip(1.0, 0.75)) is None
    n = spark.createDataFrame([(1, 1, 0, 0.0, 1.0, 60, "a"), (1, 2, 0, 1.0, 2.0, 60, "b"), (2, 1, 0, 0.0, 1.0, 60, "a"), (2, 2, 0, 1.0, 2.0, 61, "b")], "rec int, note int, section int, onset double, end double, midi int, lyric string")
    e = spark.createDataFrame([(k, float(a), float(b)) for k in (1, 2) for a, b in zip(t, dip(1.06, 0.8), strict=True)], "rec int, t double, rms double")
    assert [tuple(r) for r in charting.attack_moves(n, e, ["rec"], "note").collect()] == [(1, 2, 1.06)]


def test_sister_votes(spark):
    verses = {"a": [62, 64, 66], "b": [62, 64, 66], "c": [64, 66, 68], "d": [62, 62, 66]}
    names = {x: k for k, x in enumerate(verses)}
    rows = [("s", names[v], 0, 0, q, m) for v, notes in verses.items() for q, m in enumerate(notes)] + [("two", k, 0, 0, 0, 62 + 2 * k) for k in range(2)]
    n = spark.createDataFrame(rows, "song string, section int, verse int, line int, q int, midi int")
    got = {}
    for r in quality.sister_expectations(n, "song", "section", to_one_key(n, "song", "section")).collect():
        got.setdefault((r["song"], r["section"]), {})[r["q"]] = r["pc"]
    assert got["s", names["d"]] == {0: 2, 1: 4, 2: 6} and got["s", names["c"]] == {0: 4, 1: 6, 2: 8} and not [k for k in got if k[0] == "two"]


def test_copied_tune(spark):
    n = spark.createDataFrame([(1, s, line, q, 60 + 10 * s + q) for s in (0, 1) for line in (0, 1) for q in range(3 - s * line)] + [(1, 1, 1, 3, 50)], "rec int, section int, line int, q int, midi int")
    rules = spark.createDataFrame([(1, 1, 0, 0, 2, -1), (1, 1, 0, 1, 9, 0)], "rec int, section int, source int, line int, syllables int, transpose int")
    got = sorted((r["line"], r["q"], r["new"]) for r in quality.copied_tune(n, rules, "rec").collect())
    assert got == [(0, 0, 59), (0, 1, 60), (1, 0, 60), (1, 1, 61), (1, 3, None)]



def test_attack_moves_keeps_readings_flat(spark):
    """Loudness reaches the workers as flat numbers, not as objects for each reading, and pairs without a dip give no row."""
    t = [k * 0.01 for k in range(200)]
    rms = [0.1 if abs(k - 106) <= 1 else 1.0 for k in range(200)]
    e = spark.createDataFrame([(r, x, 1.0 if r == 2 else v) for r in (1, 2) for x, v in zip(t, rms, strict=True)], "rec int, t double, rms double")
    n = spark.createDataFrame([(r, k, 0, float(k), k + 1.0, 60, "la") for r in (1, 2) for k in (0, 1)], "rec int, note int, section int, onset double, end double, midi int, lyric string")
    out = charting.attack_moves(n, e, ["rec"], "note")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1.06)]
