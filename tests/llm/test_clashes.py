"""Every stage of the pipeline on tables with columns named as the operators name their own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["_gone", "_gone1", "_gone2", "_s", "row", "key", "k1", "k2", "own", "keep", "digest", "cid", "label", "hits", "text_", "score", "n", "_key", "_part", "source_", "copies"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", "s", 0), (901, "", None, None, 0), (902, "One two", "en", "s", 7), (902, "One two", "en", "s", 7), (903, "one TWO", "en", "s", 7)], d.schema)
    d = d.unionByName(odd)
    for n in NAMES:
        d = d.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    return d.cache()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_with_clashing_columns(spark, docs, name, stage):
    plain = [c for c in docs.columns if c not in NAMES]
    got = stage(spark, docs, SF)
    want = stage(spark, docs.select(plain), SF)
    assert set(docs.columns) <= set(got.columns)
    key = lambda df: sorted(map(str, df.select([c for c in plain if c in df.columns]).collect()))
    assert key(got) == key(want)
    assert got.where(F.col("_gone1") != F.concat(F.lit("_gone1"), F.col("doc_id").cast("string"))).isEmpty()
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_the_pipeline_cleans_up_behind_itself(spark, docs, tmp_path):
    """Only the last stage's rows and what the mixing wrote are left; the result still reads, nulls and repeated rows included."""
    import os

    from melodyspark.llm import scratch

    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = set(os.listdir(scratch.shared_dir(spark)))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(scratch.shared_dir(spark))) - before}
    assert "stage-decontamination" in left and not left & {"stage-toxicity", "stage-exact_dedup", "stage-near_dedup", "grams", "signatures", "digests", "windows"}
    rows = out.collect()
    assert len({(r["doc_id"], r["text"]) for r in rows}) > 50 and set(docs.columns) <= set(out.columns)
    # of the two null texts and the empty one, the largest doc_id stays; it has no tokens and no say in the mixture
    assert {r["doc_id"] for r in rows if not r["text"]} <= {901}
