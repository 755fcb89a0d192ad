"""Line deduplication against the alignment of all pairs of documents."""

import random

import pytest

from melodyspark.llm import line_dedup

X, L = "header and footer of every page", [f"line number {k} of the passage" for k in range(6)]
OWN = [f"line {k} that one document has" for k in range(60)]
SHAPES = {
    # document 1 holds a line twice, so it anchors nothing there
    "twice": [[OWN[0], X, OWN[1], X, OWN[2]], [OWN[3], X, OWN[4]], [OWN[5], OWN[6], X, OWN[7]], [X, OWN[8]]],
    # document 1 holds the passage in another order
    "order": [[OWN[0], L[3], L[4], L[5], L[0], L[1], L[2], OWN[1]], [OWN[2], *L, OWN[3]], [OWN[4], *L, OWN[5]]],
    # the block is long enough only with its neighbours, which the first holder does not have
    "short": [[OWN[0], "one two three", OWN[1]], [OWN[2], "one two three", "four five six", "", "seven", OWN[3]], [OWN[4], "one two three", "four five six", "", "seven", OWN[5]]],
    # more holders than the first rounds take, none of which aligns with the last
    "many": [*[[OWN[k], X, OWN[k + 30], X, f"end of {k}"] for k in range(30)], ["start", X, "middle"], ["other start", "more", X, "other end"]],
}


def brute(docs, least=20):
    out = []
    for k, b in enumerate(docs):
        gone = set()
        for a in docs[:k]:
            gone |= {j for s, e in line_dedup.common_blocks(a, b, [len(x) for x in b], least) for j in range(s, e)}
        out.append(sorted(gone))
    return out


def removed(spark, docs):
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    return [r["removed"] for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_equal_all_pairs(spark, shape):
    want = brute(SHAPES[shape])
    assert any(want) and removed(spark, SHAPES[shape]) == want


def test_random_documents_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FIRST_HUBS", 1)
    monkeypatch.setattr(line_dedup, "MOST_HUBS", 2)
    rnd = random.Random(3)
    lines = ["", "a", "bb cc", "ten chars.", "eleven char", "nineteen characters", *L[:4]]
    docs = [[rnd.choice(lines) for _ in range(rnd.randint(1, 12))] for _ in range(40)]
    assert removed(spark, docs) == brute(docs)


def test_ranges_are_found_around_every_line():
    rnd = random.Random(4)
    for _ in range(300):
        chars = line_dedup.np.array([rnd.choice([0, 0, 1, 5, 9, 12, 19]) for _ in range(rnd.randint(1, 9))])
        n, real = len(chars), line_dedup.np.flatnonzero(chars)
        for i in range(n):
            got = line_dedup._around(chars, real, 0, i, n, 20)
            assert all(x <= i <= y and chars[x : y + 1].sum() >= 20 for x, y in got)
            for x in range(i + 1):
                for y in range(i, n):
                    assert chars[x : y + 1].sum() < 20 or any(x <= p and q <= y for p, q in got)


def test_a_round_takes_as_many_pairs_as_the_first(spark, monkeypatch):
    taken = []
    away = line_dedup._aligned_away
    monkeypatch.setattr(line_dedup, "_aligned_away", lambda *a: taken.append(1) or away(*a))
    docs = [[f"own line of document {k}", "a line that all of these have"] for k in range(2500)]
    assert removed(spark, docs + SHAPES["many"]) == [[]] + [[1]] * 2499 + brute(SHAPES["many"])
    assert len(taken) == 2


def test_copies_are_not_aligned(spark, monkeypatch):
    docs = [[X, "", X, OWN[0]], ["short", ""], [X, "", X, OWN[0]], ["short", ""], [" " + X, "", X, OWN[0] + "\r"], [OWN[1], X]]
    want = brute([[x.strip() for x in d] for d in docs])
    monkeypatch.setattr(line_dedup, "common_blocks", None)
    assert removed(spark, docs[:5]) == want[:5] == [[], [], [0, 1, 2, 3], [], [0, 1, 2, 3]]
    monkeypatch.undo()
    assert removed(spark, docs) == want
