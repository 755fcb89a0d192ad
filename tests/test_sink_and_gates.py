"""Runs that repeat, change and break, and gates that fail with the rows that broke them."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from melodyspark.operators import edits as E
from melodyspark.operators import gates
from melodyspark.sources import schemas, sink
from melodyspark.sources.files import chart_documents
from melodyspark.sources.scratch import new_folder

NOTES = "recording_id string, frame_id long, section int, i int, onset double, end double, midi int, lyric string"


def notes(spark, change=0, songs=("01", "2", "b")):
    rows = [(s, 10 * n + k, k // 2, k, float(k), k + 0.5, 60 + k + (change if s == "2" else 0), "la") for n, s in enumerate(songs) for k in range(4)]
    return spark.createDataFrame(rows, NOTES)


def inputs(n, version="v1", settings="s"):
    return sink.content_hash(n, "recording_id", ["frame_id", "onset", "end", "midi", "lyric"]).withColumn("version", F.lit(version)).withColumn("settings", F.lit(settings))


def run(n, folder, broken=False, **state):
    def build(todo):
        docs = chart_documents(n.join(todo.select(F.col("key").alias("recording_id")), "recording_id"), "recording_id")
        if broken:
            docs = docs.where(gates.must(F.col("key") != "2", F.lit("no room")))
        return docs

    return sink.run_incremental(inputs(n, **state), build, folder)


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/charts/key=*/*.json")}


def test_only_what_changed_is_written_and_a_broken_run_changes_nothing(spark):
    folder = new_folder(spark, "sink-test")
    a, b = notes(spark), notes(spark, change=5)
    read = lambda: {r["key"]: [n["midi"] for n in r["notes"]] for r in sink.charts(spark, folder, schemas.CHART).collect()}
    runs = lambda: {r["key"]: r["run"] for r in sink.manifest(spark, folder).collect()}
    assert read() == {} and runs() == {}
    with pytest.raises(Exception, match="no room"):
        run(a, folder, broken=True)
    assert read() == {} and runs() == {}
    assert run(a, folder) == 1 and runs() == {"01": 1, "2": 1, "b": 1} and read()["2"] == [60, 61, 62, 63]
    first = files(folder)
    assert len(first) == 3 and run(a, folder) is None and files(folder) == first
    with pytest.raises(Exception, match="no room"):
        run(b, folder, broken=True)
    assert files(folder) == first and runs()["2"] == 1
    assert run(b, folder) == 2 and runs() == {"01": 1, "2": 2, "b": 1}
    assert read()["2"] == [65, 66, 67, 68] and {f for f in files(folder) if "key=2" not in f} == {f for f in first if "key=2" not in f}
    assert all(first[f] == t for f, t in files(folder).items() if "key=2" not in f)
    # back to the earlier content: the newest manifest row decides, not any row
    assert run(a, folder) == 3 and read()["2"] == [60, 61, 62, 63]
    assert run(a, folder, settings="other") == 4 and set(runs().values()) == {4} and run(a, folder, settings="other", version="v2") == 5
    # a song that goes stays; a new one is added
    assert run(notes(spark, songs=("b", "c")), folder, settings="other", version="v2") == 6
    assert set(read()) == {"01", "2", "b", "c"} and runs()["01"] == 5


def test_a_song_without_a_document_gets_an_empty_one(spark):
    folder = new_folder(spark, "sink-test")
    n = notes(spark)
    sink.run_incremental(inputs(n), lambda todo: chart_documents(n.where("recording_id = 'b'"), "recording_id"), folder)
    assert {r["key"]: r["notes"] is None for r in sink.charts(spark, folder, schemas.CHART).collect()} == {"01": True, "2": True, "b": False}


def test_stale_edits_fail_by_name_and_good_ones_pass(spark):
    n = notes(spark)
    edit = lambda *rows: spark.createDataFrame(rows, "edit_id long, recording_id string, onset double, old int, op string, new int, at double")
    good = edit((1, "2", 1.002, 61, "midi", 70, None), (2, "b", 3.0, 63, "delete", None, None))
    located, seen = gates.counted(E.locate(good, n, "recording_id"), "edits", good=F.count_if(~F.col("stale")), stale=F.count_if("stale"))
    out = gates.apply_strictly(n, located, "recording_id").collect()
    assert len(out) == 11 and {r["midi"] for r in out if r["frame_id"] == 11} == {70} and seen.get["good"] == 2 and seen.get["stale"] == 0
    for bad, why in ((edit((7, "2", 1.2, 61, "midi", 70, None)), "stale edit 7: 0 notes"), (edit((8, "2", 1.0, 60, "midi", 70, None)), "stale edit 8: 1 notes at 1.0 s, pitch expected 60")):
        with pytest.raises(Exception, match=why):
            gates.apply_strictly(n, E.locate(bad, n, "recording_id"), "recording_id").collect()


def test_stale_exclusions_fail_by_name(spark):
    n = notes(spark)
    cut = lambda *rows: spark.createDataFrame(rows, "recording_id string, ex string, start double, end double, reason string")
    left = gates.leave_out(n, cut(("2", "x", 0.9, 1.3, "shout"), ("2", "y", 1.1, 2.3, "shout")), ["recording_id"], "frame_id", "ex").collect()
    assert sorted(r["frame_id"] for r in left if r["recording_id"] == "2") == [10, 13] and len(left) == 10
    for start in (1.1, 50.0):
        with pytest.raises(Exception, match="stale exclusion z: no note begins in"):
            gates.leave_out(n, cut(("2", "z", start, start + 0.3, "shout")), ["recording_id"], "frame_id", "ex").collect()
    assert gates.leave_out(n, cut().limit(0), ["recording_id"], "frame_id", "ex").count() == 12
