"""Audit rules at their documented bounds."""

from pyspark.sql import functions as F

from melodyspark.operators import audit as U


def test_anchor_shift(spark):
    n = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 1.0), ("b", 2.0)], "k string, onset double")
    w = spark.createDataFrame([("a", 1, 0.7, 0.9), ("a", 2, 2.6, 2.8), ("a", 3, 4.9, 5.0), ("a", 4, 7.0, 7.1), ("b", 5, 0.5, 0.6), ("b", 6, 1.5, 1.6)], "k string, word int, start double, end double")
    s = U.anchor_shift(w, n, ["k"], "word")
    assert {r["k"]: (r["used"], round(r["shift"], 6)) for r in s.collect()} == {"a": (3, 0.3), "b": (2, 0.0)}
    assert [round(r["start"], 6) for r in U.shifted(w, s, ["k"]).orderBy("word").collect()] == [1.0, 2.9, 5.2, 7.3, 0.5, 1.5]


def test_nearest_attack(spark):
    n = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 9.0)], "k string, note int, onset double")
    at = spark.createDataFrame([("a", 0.9), ("a", 1.1), ("a", 2.25), ("a", 8.69)], "k string, at double")
    assert sorted((r["note"], round(r["delta"], 6), r["late"]) for r in U.nearest_attack(n, at, ["k"], "note").collect()) == [(1, -0.1, False), (2, 0.25, True)]


def test_review_flags(spark):
    rows = [(3, 1.0, 1.0, 60.2, 0.9), (4, 0.44, 1.0, 60.2, 0.9), (4, 0.45, 0.65, 60.2, 0.9), (4, 0.45, 0.64, 60.6, 0.8), (4, 0.45, 0.64, 60.6, 0.79)]
    df = spark.createDataFrame(rows, "frames int, voiced double, agreement double, median double, support double")
    flag = U.review_flag(F.col("frames"), F.col("voiced"), F.col("agreement"))
    got = [tuple(r) for r in df.select(flag, U.candidate_pitch(flag, F.col("median"), F.col("support"))).collect()]
    weak, off = "insufficient-independent-voice", "independent-pitch-disagreement"
    assert got == [(weak, None), (weak, None), (None, None), (off, 61), (off, None)]


def test_section_quality(spark):
    rows = [("leaps", i, i * 1.0, i + 0.9, 60 + 9 * (i % 2), "la", True) for i in range(6)] + [("plain", i, i * 1.0, i + 0.9, 60 + i, "la" if i < 2 else "", True) for i in range(6)] + [("hum", i, i * 1.0, i + 0.9, 60, "", False) for i in range(3)]
    n = spark.createDataFrame(rows, "k string, i int, onset double, end double, midi int, lyric string, sung boolean")
    got = {r["k"]: (r["quality"], r["median_step"]) for r in U.section_quality(n, ["k"], ["onset"], F.lit(False), F.col("sung")).collect()}
    assert got == {"leaps": ("pitch-unreliable", 9.0), "plain": ("lyrics-sparse", 1.0), "hum": (None, 0.0)}


def test_files_and_openings(spark):
    f = spark.createDataFrame([("a", 0.0, 1.0), ("a", 5.0, 0.0031), ("a", 6.0, 0.003)], "k string, t double, rms double")
    assert U.last_audible(f, ["k"]).first()["last_audible"] == 5.5
    assets = spark.createDataFrame([("a", 10.0), ("a", 10.25), ("b", 10.0), ("b", 10.125)], "k string, length double")
    assert {r["k"]: r["discrepant"] for r in U.discrepant_lengths(assets, ["k"]).collect()} == {"a": True, "b": False}
    n = spark.createDataFrame([(k, float(i)) for k, m in (("a", 8), ("b", 7)) for i in range(m)], "k string, onset double")
    w = spark.createDataFrame([("a", 7.625), ("a", 9.0), ("b", 8.0)], "k string, start double")
    assert [tuple(r) for r in U.missing_openings(n, w, ["k"]).collect()] == [("a", 8, 0.0, 7.625)]


def test_widest_silences(spark):
    n = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 3.0), ("a", 4.0, 5.0), ("a", 9.0, 9.5)], "k string, onset double, end double")
    ranges = spark.createDataFrame([("a", 1, 0.0, 4.0), ("a", 2, 4.0, 8.0)], "k string, range_no int, start double, end double")
    assert sorted((r["range_no"], r["boundary"]) for r in U.widest_silences(n, ["k"], ["onset"], ranges).collect()) == [(1, 3.5), (2, 7.0)]
