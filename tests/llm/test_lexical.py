"""Ranked search against scores of all documents, and block boundaries against every cut."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from melodyspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(n, i, Counter(terms(t))) for n, (i, t) in enumerate(docs)]
    counted = [x for x in counted if x[2]]
    n_docs, total = len(counted), sum(sum(c.values()) for _, _, c in counted)
    df = Counter(t for _, _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for n, i, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i, n))
        out += [(item, rank, x[2], -x[0]) for rank, x in enumerate(sorted(found, key=lambda x: x[:2] + ((x[2],) if x[2] is not None else (0,)))[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    return sorted((tuple(r) for r in lexical.ranked_search(d, q, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"shard_docs": 37, "run": 1, "widest": 5, "cost": 0.5}, {"shard_docs": 200, "max_bytes": 800}])
def test_as_all_scores(spark, how):
    rnd = random.Random(6)
    vocabulary = ["the", "of", "É", "字", *(f"w{i}" for i in range(80))]
    weights = [1 / (r + 1) for r in range(len(vocabulary))]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 60)))) for i in range(400)]
    docs += [(400 + i, docs[i][1].upper()) for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 30)))) for i in range(25)]
    got = found(spark, docs, items, **how)
    assert got == brute(docs, items) and len(got) > 200


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "-- !"), (4, "One two"), (None, "one two"), (5, "one ONE one"), (6, "x " * 50_000 + "one"), (7, "two")]
    items = [(1, "one two"), (2, None), (3, "--"), (4, "absent"), (None, "two two one")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_rows_that_repeat_an_id_are_found_each(spark):
    assert [(r[1], r[2]) for r in found(spark, [(1, "one"), (1, "one"), (2, "two"), (3, "three"), (4, "four")], [(9, "one")])] == [(1, 1), (2, 1)]


def cost_of(score, ends, cost):
    starts = [0, *ends[:-1]]
    return sum(max(score[s:e]) * (e - s) - sum(score[s:e]) + cost * max(score) for s, e in zip(starts, ends, strict=True))


@pytest.mark.parametrize("run,widest", [(1, 64), (1, 3), (2, 3)])
def test_blocks_are_the_cheapest_cut(run, widest):
    rnd = random.Random(run * 10 + widest)
    lists = [[rnd.randrange(1, 100) for _ in range(rnd.randrange(1, 11))] for _ in range(60)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ends = lexical.choose_blocks(first, np.array([s for x in lists for s in x]), run, widest, 1.5)
    for i, x in enumerate(lists):
        got = [int(e - first[i]) for e in ends if first[i] < e <= first[i + 1]]
        places = range(run, len(x), run)
        cuts = [[*c, len(x)] for n in range(len(places) + 1) for c in itertools.combinations(places, n)]
        allowed = [c for c in cuts if all(-(-(e - s) // run) <= widest for s, e in zip([0, *c[:-1]], c, strict=True))]
        assert got[-1] == len(x) and got in allowed
        assert cost_of(x, got, 1.5) == pytest.approx(min(cost_of(x, c, 1.5) for c in allowed))
