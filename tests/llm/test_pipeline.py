"""The pipeline's stages against brute force on the smallest tables, and the llm queries against DuckDB."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from melodyspark.llm import queries as registered
from melodyspark.llm import toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registered.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(registered.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(words, windows):
    hit = set()
    for k in {len(w) for w in windows}:
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).collect(), docs.schema)
        assert after.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        had = {r["doc_id"]: r["text"] for r in before.collect()}
        assert all(had[i] == t for i, t in kept[name].items())
        if name == "toxicity":
            scores = toxicity.toxicity_report(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(kept[name]) == {r["doc_id"] for r in scores.where(F.col("score") < 0.5).collect()}
        if name == "exact_dedup":
            last = {}
            for i, t in had.items():
                key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
                last[key] = max(i, last.get(key, i))
            assert set(kept[name]) == set(last.values())
        if name == "near_dedup":
            sets = {i: shingles(t) for i, t in had.items()}
            root = {i: i for i in had}

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            ids = sorted(had)
            for k, a in enumerate(ids):
                for b in ids[k + 1 :]:
                    both = len(sets[a] & sets[b])
                    if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
            assert set(kept[name]) == {i for i in ids if find(i) == i}
        if name == "decontamination":
            items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + min(13, len(w))]) for w in items if w for i in range(max(1, len(w) - 12))}
            assert set(kept[name]) == {i for i, t in had.items() if not contaminated(normal(t), windows)}
        before = after
    mixed = corpus_pipeline.mix_sources(spark, before, SF)
    assert {"doc_id", "text", "epoch", "block_key"} <= set(mixed.columns)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r["text"]) for r in mixed.select("text").collect()) <= sum(map(words, kept["decontamination"].values()))
