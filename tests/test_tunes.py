"""Nearest sister sections against all pairs, with the candidates counted; and the table function of lyric units."""

import random

from pyspark.sql import functions as F

from melodyspark.functions import tablefunctions
from melodyspark.functions import text as X
from melodyspark.jobs import sequence_queries as J


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def songs():
    rnd = random.Random(9)
    out = {}
    for song in range(4):
        themes = [[rnd.randrange(55, 75) for _ in range(rnd.choice([2, 9, 24]))] for _ in range(3)]
        for section in range(10):
            tune = [m + rnd.choice([0, 0, 2, -3]) * 1 for m in themes[section % 3]]
            shift = rnd.randrange(-5, 6)
            tune = [m + shift for m in themes[section % 3]] if rnd.random() < 0.7 else tune
            for _ in range(rnd.randrange(3)):
                tune[rnd.randrange(len(tune))] += 1
            out[song, section] = tune[: rnd.choice([len(tune), max(1, len(tune) - 2)])]
    out[9, 0] = [60, 62]
    return out


def test_nearest_sisters_and_their_candidates(spark):
    tunes = songs()
    df = spark.createDataFrame([(k, s, t) for (k, s), t in tunes.items()], "song int, section int, ms array<int>").repartition(3)
    got = {(r["song"], r["section"]): (r["edits"], r["shift"], r["sister"]) for r in J.tune_distance(df, "song", "section", "ms").collect()}
    want = {}
    for (k, s), t in tunes.items():
        tries = [(edits([m + d for m in t], o), d, q) for (x, q), o in tunes.items() if x == k and q != s for d in range(-14, 15)]
        if tries:
            want[k, s] = min(tries)
    assert got == want
    pairs = len([1 for k, s in tunes for x, q in tunes if k == x and s != q])
    assert len(want) <= J.tune_candidates(df, "song", "section", "ms").count() < pairs / 2
    for r in J.sister_bounds(df, "song", "section", "ms").collect():
        assert r["least"] <= min(edits([m + d for m in tunes[r["song"], r["section"]]], tunes[r["song"], r["sister"]]) for d in range(-14, 15))


def test_units_from_sql(spark):
    rows = [(1, 0, "Sing a line, don't"), (1, 1, None), (1, 2, "山 high 水"), (2, 0, ""), (2, 1, "one-two")]
    lines = spark.createDataFrame(rows, "song long, line_no int, line string").repartition(3)
    tablefunctions.register(spark)
    lines.createOrReplaceTempView("lines_of_this_test")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM lyric_units(TABLE(lines_of_this_test) PARTITION BY song ORDER BY line_no)").collect())
    plain = lines.select("song", "line_no", F.posexplode(X.tokens(F.col("line"))).alias("k", "token")).orderBy("song", "line_no", "k").collect()
    seen, want = {}, []
    for r in plain:
        want.append((r["song"], r["line_no"], r["k"], seen.get(r["song"], 0), r["token"]))
        seen[r["song"]] = seen.get(r["song"], 0) + 1
    assert got == want and len(got) == 8
