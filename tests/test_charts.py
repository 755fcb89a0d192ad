"""The composed jobs hold what their operators give."""

from pyspark.sql import functions as F

from melodyspark.jobs import catalogue, charts
from melodyspark.operators import voice as V
from melodyspark.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_chart_build(spark):
    docs = {r["key"]: r for r in catalogue.QUERIES["chart_build"](spark, SF).collect()}
    notes = {}
    for r in T.notes(spark, SF).orderBy("onset", "frame_id").collect():
        notes.setdefault(str(r["recording_id"]), []).append(r)
    assert set(docs) == set(notes)
    for key, own in notes.items():
        d = docs[key]
        assert [n["t"] for n in d["notes"]] == [r["onset"] for r in own] and [n["i"] for n in d["notes"]] == list(range(len(own)))
        assert d["labelled"] == sum(n["lyric"] != "" for n in d["notes"]) and 1 <= d["phrases"] <= len(own)
        assert sorted((s["first"], s["last"]) for s in d["sections"])[0][0] == 0 and max(s["last"] for s in d["sections"]) == len(own) - 1


def test_catalogue_audit(spark):
    got = {r["recording_id"]: r for r in catalogue.QUERIES["catalogue_audit"](spark, SF).collect()}
    n = T.notes(spark, SF)
    spans = n.select("recording_id", F.col("frame_id").alias("note"), F.col("onset").alias("start"), "end", F.col("midi").alias("expected"))
    for r in V.chart_match(T.frames(spark, SF), spans, ["recording_id"], "note", least=1).collect():
        assert (got[r["recording_id"]]["notes"], got[r["recording_id"]]["exact"], got[r["recording_id"]]["silent"]) == (r["notes"], r["exact"], r["silent"])
    for r in n.groupBy("recording_id").agg(F.count_if(F.col("lyric") == "").alias("u")).collect():
        assert got[r["recording_id"]]["unlabelled"] == r["u"]


def test_repeated_ids_get_a_letter(spark):
    n = spark.createDataFrame([(1, 0, 0, True, k, 1.0, 1.5, 60) for k in (1, 2)], "recording_id long, section int, line int, line_start boolean, note long, onset double, end double, midi int")
    u = spark.createDataFrame([(1, 0, 7, 1, "la", 1.0, 1.2, False, True)], "recording_id long, section int, unit long, _order int, text string, start double, end double, weak boolean, line_start boolean")
    assert sorted(r["id"] for r in charts.chart(n, u).collect()) == ["1-0-00100", "1-0-00100b"]
