"""Toxicity scores rank held-out rows of label 1 above those of label 0."""

import random
import zlib

import pytest

from melodyspark.llm import toxicity

ORDINARY = [a + b for a in "bdfgklmnprst" for b in ("ado", "emi", "ilu", "onar", "usek")]
MARKS = ["zorgle", "fliptuk", "vexmoor"]


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def ranking(rows):
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def scores(spark, docs, labels):
    got = toxicity.toxicity_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    return {r["doc_id"]: r["score"] for r in got}


def test_label_1_told_by_what_it_lacks(spark):
    # only ordinary texts have the marks: no single n-gram speaks for label 1
    rnd = random.Random(5)
    labels = [(i, int(rnd.random() < 0.3)) for i in range(300)]
    docs = [(i, " ".join(rnd.sample(ORDINARY, 25) + ([] if y else rnd.choices(MARKS, k=2)))) for i, y in labels]
    got = scores(spark, docs, labels)
    assert ranking([(got[i], y) for i, y in labels if fold(i) == 0]) > 0.95


def test_label_1_in_one_fold_only(spark):
    rnd = random.Random(6)
    labels = [(i, int(i % 2 == 1 and fold(i) in (0, 4))) for i in range(120)]
    docs = [(i, " ".join(rnd.sample(ORDINARY, 20) + [MARKS[0]] * y)) for i, y in labels]
    got = scores(spark, docs, labels)
    assert ranking([(got[i], y) for i, y in labels if fold(i) == 0]) > 0.95


@pytest.mark.parametrize("pos", [[3, 0, 0, 0], [0, 1, 0, 0], [1, 0, 0, 1]])
def test_the_curve_never_falls(pos):
    bins = [{"bin": 100 * k - 150, "pos": p, "neg": n} for k, (p, n) in enumerate(zip(pos, [0, 2, 3, 4], strict=True))]
    assert toxicity._curve(bins)[0] > 0
