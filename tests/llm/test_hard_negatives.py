"""Hard negatives against all pairs, with ties, repeated rows, unusable vectors and small parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from melodyspark.llm import hard_negatives as hn


def brute(rows, is_anchor, positives=5, negatives=3):
    """Anchor, positive and negative ids with scores, from all pairs."""
    usable = []
    for n, (i, v, lab) in enumerate(rows):
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((n, i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]))
    out = []
    for n, i, lab, v in usable:
        if i is None or not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j, m, other) for m, j, other, w in usable if m != n and len(w) == len(v))
        for s, _, j, _, _ in [x for x in scored if x[4] == lab][:positives]:
            hard = [x for x in scored if x[4] != lab and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(i, j, rank, x[2], -s, -x[0]) for rank, x in enumerate(hard, 1)]
    return sorted(out, key=str)


def mined(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, v, lab, "r", 1) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, row string, v int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hn.hard_negatives(df, label, F.col("vec_id") % 5 == 0, **how).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("part_rows", [40, 100_000])
def test_as_all_pairs(spark, part_rows):
    rnd = random.Random(8)
    near = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [np.float32(x + rnd.gauss(0, 0.2)).item() for x in near[i % 12]], rnd.choice([0, 0, 0, 1, 2, 3])) for i in range(300)]
    got = mined(spark, rows, part_rows=part_rows, block=17)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 100


def test_ties_repeats_and_unusable_rows(spark):
    rnd = random.Random(2)
    rows = [(i % 60, [float(rnd.randrange(3)), float(rnd.randrange(3))], rnd.randrange(3)) for i in range(160)]
    rows = [r for n, r in enumerate(rows) if r not in rows[:n]]
    rows += [(65, None, 1), (70, [1.0, None], 1), (75, [float("nan"), 1.0], 1), (80, [float("inf"), 1.0], 1), (85, [1.0, 2.0], None), (90, [], 1), (91, [], 1), (92, [], 2), (95, [1.0, 2.0, 3.0], 0), (96, [1.0, 2.0, 3.0], 0), (97, [0.5, 2.0, 2.5], 1)]
    # rows that repeat an id keep their order by row number, which the rows of one id here don't show
    got = mined(spark, rows, part_rows=16, block=8)
    assert got == brute(rows, lambda i: i % 5 == 0)


def test_missing_ids_come_last_and_huge_components_take_no_part(spark):
    rows = [(5, [1.0], 1), (1, [1.0], 1), (None, [1.0], 1), (2, [0.75], 2), (None, [0.75], 2), (3, [1e30], 2)]
    assert mined(spark, rows, "double") == brute([r for r in rows if r[0] != 3], lambda i: i % 5 == 0)


def test_wide_values_are_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-30_000, 30_000) for _ in range(8)], rnd.randrange(2)) for i in range(120)]
    assert mined(spark, rows, "double", part_rows=30) == brute(rows, lambda i: i % 5 == 0)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(5, None, 1)]) == []


def test_bounds_hold_every_row():
    """Each node's centre and radius bound the products of its rows from both sides."""
    rng = np.random.default_rng(1)
    points = rng.integers(-300, 300, (500, 5)).astype(np.int32)
    tree = hn.BallTree.build(points, np.arange(500), np.arange(500), rng.integers(0, 4, 500))
    q = rng.integers(-300, 300, 5)
    for k in range(len(tree.lo)):
        rows = tree.points[tree.lo[k] : tree.hi[k]] @ q
        mid, slack = tree.centre[k] @ q, np.linalg.norm(q) * tree.radius[k]
        assert rows.min() >= mid - slack and rows.max() <= mid + slack
        assert tree.low_label[k] == tree.labels[tree.lo[k] : tree.hi[k]].min()
