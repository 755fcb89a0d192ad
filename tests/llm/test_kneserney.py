"""The sharded Kneser-Ney tables against a small model in plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from melodyspark.llm import kneserney, quality, toxicity

rnd = random.Random(8)
WORDS = ["".join(rnd.choice("abcdeé字 ") for _ in range(rnd.randint(1, 6))) for _ in range(30)]
TEXTS = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 25))) for _ in range(60)] + ["", None, " \n\t", "Zebra\x0b\x0cZEBRA", "a", "\u0000x\U0001f600"]


def padded(text, order, lower=False):
    t = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text or "")
    out = " " * (order - 1)
    for c in t:
        c = " " if c in " \t\n\r\v\f" else c
        if not (c == " " and out[-1:] == " "):
            out += c
    return [out[i : i + order] for i in range(len(out) - order + 1)]


class Plain:
    """Probabilities by recursion, straight from the definition."""

    def __init__(self, texts, order, below=None, shared=0):
        raw = Counter(g for t in texts for g in padded(t, order))
        self.levels, self.below, self.shared = {order: raw}, below, shared
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.symbols = len(self.levels[1]) + 1
        self.d = {k: self.discounts(c) for k, c in self.levels.items()}

    @staticmethod
    def discounts(c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return [0.5] * 3
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]

    def p(self, g):
        if not g:
            return 1 / self.symbols
        if self.below and len(g) <= self.shared:
            return self.below.p(g)
        c, d = self.levels[len(g)], self.d[len(g)]
        same = [v for x, v in c.items() if x[:-1] == g[:-1]]
        if not same:
            return self.p(g[1:])
        cut = lambda v: d[min(v, 3) - 1]
        return (max(c[g] - cut(c[g]), 0) if c[g] else 0) / sum(same) + sum(map(cut, same)) / sum(same) * self.p(g[1:])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, None if i % 5 == 4 else i % 2) for i, t in enumerate(TEXTS)], "id long, text string, label int").repartition(3)


def test_counts(rows):
    got = {r["g"]: (r["n"], r["c0"], r["c1"]) for r in kneserney.gram_counts(rows, 2, 3).collect()}
    want = [Counter(g for i, t in enumerate(TEXTS) for g in padded(t, 3) if keep(i)) for keep in (lambda i: True, lambda i: i % 5 != 4 and i % 2 == 0, lambda i: i % 5 != 4 and i % 2 == 1)]
    assert got == {g: tuple(c[g] for c in want) for g in want[0]}


def test_many_kinds_of_characters(spark):
    texts = ["".join(map(chr, range(0x4E00, 0x4E00 + 9000))), "".join(map(chr, range(0x5000, 0x5000 + 3000))), "abcabc"]
    df = spark.createDataFrame([(t, 0) for t in texts], "text string, label int").coalesce(1)
    got = {r["g"]: r["c0"] for r in kneserney.gram_counts(df, 1, 5).collect()}
    assert got == Counter(g for t in texts for g in padded(t, 5))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_one_model(rows, order):
    counts = kneserney.gram_counts(rows, 2, order)
    got = {r["g"]: r["q_c0"] for r in kneserney.estimate(counts, ["c0"], order=order).collect()}
    plain = Plain([t for i, t in enumerate(TEXTS) if i % 5 != 4 and i % 2 == 0], order)
    assert set(got) == {g for t in TEXTS for g in padded(t, order)}
    assert all(abs(q - plain.p(g)) < 1e-9 for g, q in got.items())
    # over all known characters and the unknown one the probabilities of a context sum to 1
    for ctx in {g[:-1] for g in list(got)[:20]}:
        assert abs(sum(plain.p(ctx + c) for c in [*plain.levels[1], "￿"]) - 1) < 1e-9


@pytest.mark.parametrize("shared", [0, 2, 3])
def test_two_classes_share_short_orders(rows, shared):
    got = kneserney.estimate(kneserney.gram_counts(rows, 2, 3), ["c0", "c1"], shared, 3).collect()
    own = [[t for i, t in enumerate(TEXTS) if i % 5 != 4 and i % 2 == k] for k in (0, 1)]
    both = Plain(own[0] + own[1], 3)
    for k in (0, 1):
        plain = Plain(own[k], 3, both, shared)
        plain.symbols = both.symbols
        assert all(abs(r[f"q_c{k}"] - plain.p(r["g"])) < 1e-9 for r in got)


def test_broadcast_and_joined_sums_agree(rows):
    model = kneserney.estimate(kneserney.gram_counts(rows, 2, 3), ["c0"], order=3).select("g", "n", F.log("q_c0").alias("logp")).cache()
    plain = Plain([t for i, t in enumerate(TEXTS) if i % 5 != 4 and i % 2 == 0], 3)
    for hot, common in ((0, 10**6), (20, 3), (10**6, 10**6)):
        got = kneserney.score(rows.select(F.struct("id").alias("row"), "text"), model, ["logp"], 3, hot=hot, common=common).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            grams = padded(TEXTS[r["row"]["id"]], 3)
            assert r["n_scored"] == len(grams) and abs(r["logp"] - sum(math.log(plain.p(g)) for g in grams)) < 1e-9


def test_exact_quantile(spark):
    values = [("a", float(rnd.randint(0, 40))) for _ in range(500)] + [(None, float(x)) for x in range(7)] + [("b", 3.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(3)
    for share in (0.0, 0.5, 0.98, 1.0):
        got = {r["g"]: r["q"] for r in quality.exact_quantile(df, "g", "v", share).collect()}
        for g in ("a", None, "b"):
            own = sorted(v for k, v in values if k == g)
            assert got[g] == own[max(0, math.ceil(len(own) * share) - 1)]


def test_toxic_words_are_found(spark):
    """Held-out accuracy, labels wrong now and then; long, repeated and null rows change nothing."""
    vocabulary = ["".join(rnd.choice("aeiou") + rnd.choice("bcdfg") for _ in range(rnd.randint(1, 3))) for _ in range(80)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 90))]
        if toxic:
            words[:: len(words) // 2] = ["xylq zonk"] * len(words[:: len(words) // 2])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if rnd.random() > 0.05 else 1 - toxic))
    extra = [(5000, " ".join(rnd.choice(vocabulary) for _ in range(60_000))), (5001, None), (5001, ""), (5002, rows[0][1]), (5002, rows[0][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, marks).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert [r["predicted"] for r in got if r["doc_id"] in (5000, 5001)] == [0, 0, 0]
    assert [r["predicted"] for r in got if r["doc_id"] == 5002] == [1, 1]
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == ["doc_id", "text"] and kept.where("doc_id = 5002").count() == 0 and kept.where("doc_id = 5001").count() == 2
    for bound in (0, 10**6):
        again = toxicity.drop_toxic(docs, marks, max_broadcast=bound)
        assert sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in got if r["predicted"] == 0)
