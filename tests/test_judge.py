"""Notes judged live, batch by batch: late and repeated samples, runs, transposition and notes that sound together."""

import pytest
from pyspark.sql import functions as F

from melodyspark.operators import scoring
from melodyspark.sources.scratch import new_folder
from melodyspark.streaming import judge as J
from melodyspark.streaming import live as L

SAMPLES = "recording_id long, run long, frame_id long, at double, midi double, voiced boolean"
#: a stream's first watermark is the time 0, so samples begin later
EPOCH = 1_000_000
NOTES = [(1, 1, 0.0, 1.0, 60), (1, 2, 2.0, 3.0, 62), (1, 3, 4.0, 5.0, 64), (1, 4, 4.0, 5.0, 66), (1, 5, 6.0, 6.5, 60), (2, 1, 0.0, 1.0, 50)]


def frames(run, first, start, stop, midi, recording=1, voiced=True):
    n = round((stop - start) / 0.1)
    return [(recording, run, first + k, start + k * 0.1, float(midi), voiced) for k in range(n)]


def judged(spark, batches):
    """Each list of samples is one batch of the stream; the allowance is a second."""
    folder = new_folder(spark, "samples")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(f"{folder}/{k:02d}")
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(folder)
    live = stream.withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long") + EPOCH)).withWatermark("ts", "1 second")
    notes = spark.createDataFrame(NOTES, "recording_id long, note long, t double, end double, midi int")
    met = J.on_notes(live, notes.withColumn("shift", F.when(F.col("recording_id") == 2, 5).otherwise(0)), 2.0, F.col("shift"))
    met = met.withColumn("a", F.col("at")).withColumn("b", F.col("at") + 0.1).withColumn("due", (F.col("end") * 1000).cast("long") + EPOCH)
    return L.drain(J.judged_notes(met, idle_ms=2000), "judged-test")


@pytest.fixture(scope="module")
def result(spark):
    later = [(1, 0, 900, 20.0, 60.0, True), (1, 1, 901, 20.0, 60.0, True)]
    batches = [
        frames(0, 0, 0, 1, 60.2) + frames(1, 100, 0, 1, 60.5),
        frames(0, 0, 0, 1, 70) + frames(0, 20, 2, 3, 62.8) + frames(0, 40, 4, 5, 65.3) + frames(0, 60, 6, 6.5, 60, voiced=False),
        frames(0, 200, 0, 1, 55.3, recording=2),
        later,
        frames(0, 300, 0.05, 0.95, 60) + frames(1, 400, 2, 3, 62),
        [(1, 0, 902, 40.0, 60.0, True)],
    ]
    return judged(spark, batches).collect()


def test_each_note_once_by_the_batch_rule(result):
    got = {(r["recording_id"], r["run"], r["note"]): (r["grade"], r["combo"]) for r in result}
    assert len(got) == len(result)
    assert got == {(1, 0, 1): ("perfect", 1), (1, 1, 1): ("great", 1), (1, 0, 2): ("good", 0), (1, 0, 4): ("good", 0), (1, 0, 5): ("miss", 0), (2, 0, 1): ("perfect", 1)}


def test_the_numbers_are_those_of_the_rule(result):
    one = next(r for r in result if (r["recording_id"], r["run"], r["note"]) == (1, 0, 1))
    samples = [(k * 0.1, k * 0.1 + 0.1, 100 * (60.2 - 60)) for k in range(10)]
    assert (one["median"], one["late"], one["cover"], one["grade"]) == pytest.approx(scoring.judge_note(0, 1, samples)) and one["points"] == 1.0


def test_notes_nobody_heard_are_misses(spark, result):
    rows = spark.createDataFrame([r.asDict() for r in result if r["recording_id"] == 1 and r["run"] == 0], J.JUDGED)
    notes = spark.createDataFrame(NOTES, "recording_id long, note long, t double, end double, midi int").where("recording_id = 1")
    got = {r["note"]: r["grade"] for r in J.with_missed(rows, notes, F.lit(6.0)).collect()}
    assert got == {1: "perfect", 2: "good", 3: "miss", 4: "good", 5: "miss"}
