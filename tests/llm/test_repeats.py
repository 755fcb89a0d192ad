"""Rows that repeat an id, clashing columns, and both sides of every bound."""

import random
import re

import pytest
from pyspark.sql import functions as F

from melodyspark.llm import decontaminate, exact_dedup, line_dedup, mixing, ngram_join, substring_dedup, warc

rnd = random.Random(12)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
prose = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [(i, sets(t)) for i, t in rows]
    for k, (i, a) in enumerate(own):
        for j, b in own[k + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_repeated_ids_join_their_links(spark):
    a, b = prose(60), prose(60)
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " tail"), (4, prose(60)), (4, prose(50)), (5, "")]
    for partitions in (1, 3):
        got = ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} and len(got) == len(rows)


@pytest.mark.parametrize("params", [{}, {"max_frequent": 0, "hub_rounds": 0}])
def test_near_copies_equal_brute_force(spark, params):
    rows, base = [], [prose(n) for n in (6, 7, 30, 80, 200)]
    for i in range(160):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w)))
    got = ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **params).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)


def test_hub_texts_are_copied_to_several_tasks(spark):
    base = prose(80)
    texts = spark.createDataFrame([(i, i * 7, f"{base} w{i}") for i in range(60)], "doc_id long, k long, text string")
    pairs = texts.where("doc_id > 0").select(F.lit(0).cast("long").alias("a"), F.col("k").alias("b"))
    for most, bound in ((5, 10), (5, 0), (1000, 10**6)):
        assert ngram_join.verify(texts, pairs, 5, max_broadcast=bound, most=most).count() == 59


def test_exact_dedup_keeps_one_row_a_text(spark):
    rows = [(1, "A", 1), (1, "B", 2), (2, "b", 3), (3, "c", 4), (3, "c", 5), (3, "C", 6), (None, "d", 7), (None, "D", 8), (None, None, 9), (4, "", 10), (5, "e", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    report = exact_dedup.duplicate_groups(docs).collect()
    assert len(report) == len(rows) and sum(r["kept"] for r in report) == 6
    for bound in (0, 10**6):
        kept = exact_dedup.exact_dedup(docs, max_broadcast=bound)
        assert kept.columns == docs.columns
        got = {(r["text"] or "").lower(): r["doc_id"] for r in kept.collect()}
        assert kept.count() == 6 and got == {"a": 1, "b": 2, "c": 3, "d": None, "": 4, "e": 5}


def test_revisits_that_repeat_a_record_id(spark):
    rows = [
        (1, "response", "http://a.org/", 10, "t1", 1, None, "p1"), (1, "response", "http://a.org/", 10, "t2", 1, None, "p2"), (1, "response", "http://b.org/", 5, "t3", 1, None, "p3"),
        (3, "revisit", "http://a.org/", 20, "t1", None, None, None), (3, "revisit", "http://a.org/", 9, "t1", None, None, None), (3, "revisit", "http://b.org/", 30, "t3", None, None, None), (None, "revisit", "http://b.org/", 30, "t3", None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, t long, etag string, last_modified long, headers map<string,string>, payload_sha256 string")
    for n in (1, 1000):
        got = warc.resolve_revisits(df.repartition(2), bucket_rows=n).collect()
        assert len(got) == 4
        assert sorted((r["status"], r["canonical"], r["payload_sha256"]) for r in got if r["canonical"].startswith("b.org")) == [("resolved", "b.org", "p3")] * 2
        assert sorted(r["status"] for r in got if r["canonical"] == "a.org")[0] == "no-response"


def test_mix_stays_within_its_budget(spark):
    rows = [(i % 7 if i % 3 else None, prose(rnd.randint(0, 12)), f"s{i % 4}", i, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, origin string, epoch int, block_key string").repartition(3)
    words = lambda t: len((t or "").split())
    for params in ({}, {"max_broadcast": 0}, {"budget": 400}, {"budget": 5000, "max_repeats": 50.0}):
        got = mixing.mix(docs, source_col="origin", block_docs=10, **params)
        assert got.columns == [*docs.columns, "mix_epoch", "mix_block_key", "place_key"]
        got = got.collect()
        budget = params.get("budget", sum(words(r[1]) for r in rows))
        assert sum(words(r["text"]) for r in got) <= budget
        plan = mixing.plan_mix(docs, source_col="origin", block_docs=10, **params).collect()
        assert len(plan) == len(rows) and sum(r["copies"] for r in plan) == len(got)
        assert sum(r["copies"] * r["n_tokens"] for r in plan) >= 0.8 * budget
        times = {}
        for r in got:
            times.setdefault((r["epoch"], r["text"]), []).append(r["mix_epoch"])
        assert all(sorted(x) == list(range(1, len(x) + 1)) for x in times.values())


@pytest.mark.parametrize("bound", [0, 2_000_000])
def test_lines_and_substrings_on_both_sides(spark, bound):
    line = ["a shared line of the two documents", "another shared line follows it"]
    docs = spark.createDataFrame([(1, "\n".join(line)), (2, "\n".join(["own", *line])), (3, None), (None, "x"), (4, "own")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, max_broadcast=bound).collect()}
    assert got == {1: 0, 2: 2, 3: 0, None: 0, 4: 0}
    shared = prose(50)
    docs = spark.createDataFrame([(i, f"{prose(40)} {shared} {prose(10)}") for i in range(5)] + [(9, prose(100)), (10, None)], "doc_id long, text string")
    for hot in (1, 4096):
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs, max_broadcast=bound, hot=hot).collect()}
        assert got == {**dict.fromkeys(range(5), 50), 9: 0, 10: 0}


def test_blocks_of_the_benchmark_leave_columns_alone(spark):
    text = prose(40)
    docs = spark.createDataFrame([(1, text, 7, "a"), (2, prose(30), 8, "b")], "doc_id long, text string, key int, row string")
    bench = spark.createDataFrame([(k, " ".join(text.split()[k : k + 14])) for k in range(20)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench, max_bytes=500)
    assert left.columns == docs.columns and [tuple(r)[2:] for r in left.collect()] == [(8, "b")]


def test_intermediate_tables_can_be_deleted(spark):
    from pathlib import Path

    from melodyspark.llm import scratch

    made = scratch.materialize(spark.range(3), "three")
    path = Path(scratch._written[spark.sparkContext.applicationId][-1])
    assert made.count() == 3 and path.exists()
    scratch.forget(spark)
    assert not path.exists()
