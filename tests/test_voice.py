"""Window rules at their documented bounds, signals, and lyrics."""

import numpy as np
import pytest
from difflib import SequenceMatcher
from pyspark.sql import functions as F

from melodyspark.functions import text as X
from melodyspark.operators import lyrics as Y
from melodyspark.operators import signal as G
from melodyspark.operators import voice as V


def frames(spark, rows, fields="k int, t double, midi double, voiced boolean, rms double"):
    return spark.createDataFrame(rows, fields).repartition(2)


def test_voiced_sections(spark):
    sections = lambda t: [(round(r["start"], 2), round(r["end"], 2), r["spans"]) for r in V.voiced_sections(frames(spark, [(1, x / 100, 60.0, True, 0.1) for x in t] + [(1, 0.35, 60.0, False, 0.1)]), ["k"], ["t"]).orderBy("section").collect()]
    # a gap of .11 parts spans, of .09 does not; one of .17 s is too short to count
    assert sections([0, 9, 18, 29, 38, 47, 60, 69, 75]) == [(-0.01, 0.48, 2)] and sections([0, 9, 18, 29, 38, 44]) == [(-0.01, 0.19, 1)]
    # spans up to 1.5 s apart are a section
    assert len(sections([0, 9, 18, 169, 178, 187])) == 1 and len(sections([0, 9, 18, 171, 180, 189])) == 2


def brute_runs(voiced, hole=4, least=6):
    out, i, n = [], 0, len(voiced)
    while i < n:
        if not voiced[i]:
            i += 1
            continue
        j = i
        while j < n and (voiced[j] or (j + hole < n and any(voiced[j : j + hole + 1]))):
            j += 1
        while not voiced[j - 1]:
            j -= 1
        if j - i >= least:
            out.append((i + 1, j, sum(voiced[i:j])))
        i = j
    return out


def test_voiced_runs(spark):
    rng = np.random.default_rng(5)
    cases = [(rng.random(n) < p).tolist() for n in (5, 9, 30, 60) for p in (0.3, 0.5, 0.8)] + [[True] * 6 + [False] * 3 + [True], [True] * 6 + [False] * 4 + [True] * 5]
    f = frames(spark, [(k, float(i), 60.0, bool(v), 0.1) for k, c in enumerate(cases) for i, v in enumerate(c)])
    got = {}
    for r in V.voiced_runs(f, ["k"], ["t"]).collect():
        got.setdefault(r["k"], []).append((r["first"], r["last"], r["voiced"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: x for k, c in enumerate(cases) if (x := brute_runs(c))}


def test_octave_slips(spark):
    midi = [60.0] * 70 + [73.0, 52.4, 67.5, 67.6, 84.1] + [60.0] * 70
    got = [r["fixed"] for r in V.octave_slips(frames(spark, [(1, float(i), m, True, 0.1) for i, m in enumerate(midi)]), ["k"], ["t"]).orderBy("t").collect()]
    assert [round(x, 1) for x in got[70:75]] == [61.0, 64.4, 67.5, 55.6, 60.1]


def test_attack_edge(spark):
    f = frames(spark, [(1, t, 60.0, True, r) for t, r in [(0.79, 9.0), (0.8, 1.0), (0.9, 0.5), (0.95, 0.3), (1.0, 0.2), (1.05, 0.4), (1.1, 0.8), (1.2, 0.6), (1.21, 9.0)]])
    cuts = spark.createDataFrame([(1, 1.0), (1, 50.0)], "k int, at double")
    assert [round(r["edge"], 6) for r in V.attack_edge(f, cuts, ["k"]).collect()] == [0.25]


def test_merge_held(spark):
    rows = [(1, 0.0, 0.5, 60, 60.0, True), (1, 0.55, 1.0, 60, 61.0, False), (1, 1.07, 1.5, 60, 60.0, False), (1, 1.5, 2.0, 62, 62.0, False), (1, 2.0, 2.5, 62, 62.0, False), (1, 2.5, 3.0, 62, 62.0, True), (1, 3.0, 3.2, 62, 62.0, False)]
    n = spark.createDataFrame(rows, "k int, onset double, end double, midi int, median double, owned boolean")
    got = lambda **p: [(r["onset"], r["end"], r["pieces"]) for r in V.merge_held(n, ["k"], ["onset"], **p).orderBy("onset").collect()]
    assert got() == [(0.0, 1.0, 2), (1.07, 1.5, 1), (1.5, 3.2, 4)]
    # only a note without a syllable joins, and only one that has one
    assert got(owned="owned") == [(0.0, 1.0, 2), (1.07, 1.5, 1), (1.5, 2.0, 1), (2.0, 2.5, 1), (2.5, 3.2, 2)]


def test_first_voice_and_quick_part(spark):
    f = frames(spark, [(1, i / 10, 60.0, i >= 20, 0.1) for i in range(80)])
    # 25 of 30 frames: the window -15 .. +14 around frame 30
    assert round(V.first_voice(f, ["k"], ["t"]).first()["first_voice"], 2) == round(3.0 - 0.15, 2)
    s = spark.createDataFrame([(1, 0, 7.0, 12.0), (1, 1, 13.0, 19.5), (1, 2, 20.2, 30.0), (2, 0, 1.0, 20.0)], "k int, section int, a double, z double")
    got = {r["k"]: (r["sections"], round(r["start"], 2), round(r["end"], 2)) for r in V.quick_part(s, ["k"], "section", F.lit(40.0)).collect()}
    assert got == {1: (2, 3.0, 20.15), 2: (1, 0.0, 21.4)}


def test_note_pairs(spark):
    rows = [(0, 0, 60, True, 64, 0), (1, 0, 60, True, 0, 4), (2, 0, 62, True, 64, 0), (3, 0, 62, False, 0, 2), (4, 0, 62, True, 64, 1), (5, 1, 62, False, 0, 1)]
    e = spark.createDataFrame(rows, "seq int, channel int, pitch int, is_on boolean, velocity int, delta int").withColumn("track", F.lit(0))
    got = sorted((r["seq"], r["start"], r["dur"]) for r in V.note_pairs(e, ["track", "channel", "pitch"], ["track"], "seq").collect())
    assert got == [(0, 0, 4), (2, 4, 2)]


def test_fill_times(spark):
    w = spark.createDataFrame([(1, 0, None, None), (1, 1, 1.0, 1.2), (1, 2, None, None), (1, 3, None, None), (1, 4, 4.2, 4.4), (1, 5, None, None)], "k int, pos int, start double, end double")
    got = [(r["anchor"], None if r["start"] is None else round(r["start"], 3), None if r["end"] is None else round(r["end"], 3)) for r in V.fill_times(w, ["k"], "pos").orderBy("pos").collect()]
    assert got == [("none", None, None), ("known", 1.0, 1.2), ("interpolated", 1.7, 1.85), ("interpolated", 2.7, 2.85), ("known", 4.2, 4.4), ("none", None, None)]


def test_chart_match(spark):
    f = frames(spark, [(1, i / 10, m, v, 0.1) for i, (m, v) in enumerate([(60.5, True)] * 5 + [(72.0, True)] * 5 + [(60.0, True)] * 4 + [(60.0, False)] * 6 + [(60.0, True)] * 5 + [(60.0, False)] * 12)])
    spans = spark.createDataFrame([(1, 0, 0.0, 0.45, 60), (1, 1, 0.5, 0.95, 60), (1, 2, 1.0, 1.95, 60), (1, 3, 2.0, 3.65, 60), (1, 4, 9.0, 9.5, 60)], "k int, note int, start double, end double, expected int")
    r = V.chart_match(f, spans, ["k"], "note").first()
    # the third has four voiced frames, the fourth 5 of 17, the fifth none
    assert (r["notes"], r["exact"], r["octave"], r["silent"]) == (5, 1, 2, 3)


def test_colour_change(spark):
    rng = np.random.default_rng(6)
    t = np.arange(60) * 0.005
    x = np.where(t[:, None] < 0.15, rng.random((1, 8)), rng.random((1, 8))) + 0.01 * rng.random((60, 8))
    b = spark.createDataFrame([(1, float(a), v.tolist()) for a, v in zip(t, x, strict=True)], "k int, t double, bands array<double>")
    cuts = [0.1512, 0.0503, 0.001]
    got = {r["at"]: r["colour"] for r in V.colour_change(b, spark.createDataFrame([(1, c) for c in cuts], "k int, at double"), ["k"]).collect()}
    for c in cuts:
        left, right = x[(t >= c - 0.075) & (t < c - 0.015)], x[(t > c + 0.015) & (t <= c + 0.075)]
        want = 0.0 if min(len(left), len(right)) < 3 else 1 - np.corrcoef(left.mean(0), right.mean(0))[0, 1]
        assert abs(got[c] - want) < 1e-9


@pytest.mark.parametrize("size", [700, 3000, 20_000])
def test_tracks_do_not_depend_on_chunks(spark, size):
    rate, n = 16000, 16_300
    tone = np.sin(2 * np.pi * 440 * 2 ** ((64.3 - 69) / 12) * np.arange(n) / rate) * 0.5
    c = spark.createDataFrame([("a", k, tone[i : i + size].tolist()) for k, i in enumerate(range(0, n, size))], "k string, chunk int, samples array<double>").repartition(2)
    got = G.difference_track(c, ["k"]).orderBy("frame").toPandas()
    assert got["frame"].tolist() == list(range((n - 1024) // 320)) and (abs(got["midi"] - 64.3) < 0.05).all() and (got["confidence"] > 0.99).all()
    other = G.autocorrelation_track(c, ["k"], rate=rate, window=2048, hop=160).orderBy("frame").toPandas()
    assert len(other) == (n - 2048) // 160 and (abs(other["midi"] - 64.3) < 0.1).all()
    bands = G.band_track(c, ["k"]).toPandas()
    assert len(bands) == (n - 1024) // 80 and len(bands["bands"].iloc[0]) == 40
    loud = V.sliding_loudness(c, ["k"], rate).orderBy("hop").toPandas()
    want = [np.sqrt(np.mean(tone[i * 80 : i * 80 + 400] ** 2)) for i in range((n - 400) // 80)]
    assert loud["hop"].tolist() == list(range(len(want))) and np.allclose(loud["rms"], want)


def test_estimators_against_plain_loops():
    rng = np.random.default_rng(7)
    x = np.sin(2 * np.pi * 200 * np.arange(1024) / 16000)[None, :] + 0.3 * rng.standard_normal((4, 1024))
    y = x - x.mean(1, keepdims=True)
    midi, confidence = G.difference_pitch(x, 16000)
    for k in range(4):
        diff = [sum((y[k, i] - y[k, i + lag]) ** 2 for i in range(1024 - lag)) for lag in range(1, 214)]
        curve = np.r_[1.0, np.array(diff) * np.arange(1, 214) / np.cumsum(diff)]
        lo, hi = 14, 213
        lag = next((i for i in range(lo, hi) if curve[i] < 0.15), lo + int(np.argmin(curve[lo:hi])))
        while lag < hi - 1 and curve[lag + 1] < curve[lag]:
            lag += 1
        assert abs(confidence[k] - (1 - curve[lag])) < 1e-6 and abs(midi[k] - (69 + 12 * np.log2(16000 / lag / 440))) < 0.7
    auto, best = G.autocorrelation_pitch(x, 16000)
    for k in range(4):
        w = x[k] * np.hanning(1024)
        ac = np.array([w[: 1024 - lag] @ w[lag:] for lag in range(1024)])
        ac /= ac[0] + 1e-12
        lo, hi = 16, 152
        lag = next(i for i in range(lo, hi) if ac[i] >= 0.8 * ac[lo:hi].max())
        while lag + 1 < hi and ac[lag + 1] > ac[lag]:
            lag += 1
        assert abs(best[k] - ac[lo:hi].max()) < 1e-6 and abs(auto[k] - (69 + 12 * np.log2(16000 / lag / 440))) < 0.7


def test_relations(spark):
    words = ["beep", "peep", "dikubas", "dikupas", "payung", "peyang", "do", "doo", "oi", "hoi", "star", "moon", "stars", "starry", "", "don't", "dont", "小", "晓", "大"]
    sounds = {"小": "xiao", "晓": "xiao", "大": "da"}
    for a in words:
        for b in words:
            got = Y.relation(a, b, sounds)
            assert got == Y.relation(b, a, sounds)
            x, y = Y.latin_key(a), Y.latin_key(b)
            if a.isascii() and b.isascii() and x != y and got == "different" and x and y and max(len(x), len(y)) >= 4:
                assert SequenceMatcher(None, x, y).ratio() < 0.8
    assert Y.relation("小", "晓", sounds) == "homophone" and Y.relation("小", "大", sounds) == "different" and Y.relation("小", "晓") == "different"
    assert Y.relation("payung", "peyang") == "homophone" and Y.relation("Don't", "dont") == "exact" and Y.relation("star", "moon") == "different"


def heard(*rows):
    text, start, p = zip(*[(*r, *(0.9,)[: 3 - len(r)]) for r in rows], strict=True)
    return Y.Heard(list(text), np.array(start, float), np.array(start, float) + 0.2, np.array(p, float))


def test_reconciliation():
    ref = ["la", "star", "moon", "sky", "sun", "sea"]
    zero = np.zeros(6, int)
    hinted = heard(("la", 0.0), ("star", 1.0), ("sky", 3.0), ("tree", 4.0), ("quux", 4.5), ("sea", 5.0))
    plain = heard(("la", 0.1), ("sky", 3.1), ("tree", 4.1), ("quux", 4.6), ("sea", 5.1))
    got = Y.reconcile(ref, zero, zero, {"hinted": hinted, "plain": plain})
    assert [(x.text, x.status) for x in got] == [("la", "heard"), ("star", "reference-spelling"), ("moon", "not-heard"), ("sky", "heard"), ("tree", "extra-sung"), ("quux", "sung-variant"), ("sea", "heard")]
    assert got[2].anchor == "interpolated" and abs(got[2].start - (1.2 + (got[3].start - 1.2) * 0.25)) < 1e-9
    # an unsure variant, one 1.2 s apart, and a word outside its verse's window do not count
    unsure = Y.reconcile(["sun"], zero[:1], zero[:1], {"hinted": heard(("tree", 4.0, 0.39)), "plain": heard(("tree", 4.1))})
    apart = Y.reconcile(["sun"], zero[:1], zero[:1], {"hinted": heard(("tree", 4.0)), "plain": heard(("tree", 5.2))})
    outside = Y.reconcile(["sun"], zero[:1], zero[:1], {"hinted": heard(("sun", 4.0)), "plain": heard(("sun", 4.1))}, {0: (0.0, 3.4)})
    assert [x[0].status for x in (unsure, apart, outside)] == ["not-heard"] * 3 and outside[0].anchor == "none"


def test_chain_against_all_choices():
    rng = np.random.default_rng(9)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        line, verse = np.sort(rng.integers(0, 3, n)), np.zeros(n, int)
        verse[line > 1] = 1
        options = [[(float(rng.uniform(0, 12)), float(rng.choice([0.7, 1.0, 1.2]))) for _ in range(rng.integers(0, 3))] for _ in range(n)]

        def best(i, last):
            if i == n:
                return 0.0
            out = best(i + 1, last)
            for t, g in options[i]:
                if last is not None:
                    j, s = last
                    room = 2.5 * (i - j) + (0.5 if line[i] == line[j] else 3.0) if verse[i] == verse[j] else np.inf
                    if t < s - 0.25 or t - s > room:
                        continue
                out = max(out, g + best(i + 1, (i, t)))
            return out

        pick = Y.chain(options, line, verse)
        assert abs(sum(options[i][k][1] for i, k in enumerate(pick) if k >= 0) - best(0, None)) < 1e-9


def test_rejoin(spark):
    w = spark.createDataFrame([(1, 0, "Tw", 0.0, 0.2), (1, 1, "inkle", 0.21, 0.5), (1, 2, "pst", 0.5, 0.6), (1, 3, " oh", 0.6, 0.8), (1, 4, "hm", 0.8, 0.9), (1, 5, "la", 0.93, 1.0)], "k int, pos int, word string, start double, end double")
    assert [r["word"] for r in X.rejoin(w, ["k"], "pos").orderBy("pos").collect()] == ["Twinkle", "pst", " oh", "hm", "la"]


def test_times_are_filled_in_one_pass_over_a_recording(spark):
    """No window reads on to its key's end for every row; words at the ends and in the middle take the times they should."""
    rows = [(1, i, None if i in (0, 2, 3, 6) else float(i), None if i in (0, 2, 3, 6) else i + 0.5) for i in range(7)]
    out = V.fill_times(spark.createDataFrame(rows, "rec int, pos int, start double, end double"), ["rec"], "pos")
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["pos"]: (r["start"], r["anchor"]) for r in out.collect()}
    assert got[0] == got[6] == (None, "none") and got[1] == (1.0, "known")
    assert got[2] == (1.5 + 2.5 * 0.5 / 3, "interpolated") and got[3] == (1.5 + 2.5 * 1.5 / 3, "interpolated")
