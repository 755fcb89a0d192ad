"""Sections against a plain loop over each block's notes, and words outside their section."""

import random

import pytest

from melodyspark.operators import sections as S

NOTES = "rec long, note long, onset double, end double"
BLOCKS = "rec long, block int, start double, end double, part_gap double"
VERSES = "rec long, block int, verse int, tokens int, anchored int, anchor_start double, anchor_end double, o_start double, o_end double, absent boolean"


def two(x):
    return round(round(x * 100) / 100, 2)


def silence(notes, lo, hi, fallback):
    """Middle of the widest silence in a range, by looking at every pair of neighbours."""
    found = []
    for left, right in zip(notes[:-1], notes[1:], strict=True):
        middle = (left[2] + right[1]) / 2
        if lo <= middle <= hi:
            found.append((right[1] - left[2], middle))
    return two(max(found)[1] if found else fallback)


def split(notes, gap):
    out = []
    for n in notes:
        if not out or n[1] - out[-1][-1][2] >= gap:
            out.append([])
        out[-1].append(n)
    return out


def plain(notes, block, verses):
    _, name, start, end, part_gap = block
    own = [n for n in notes if start <= n[1] < end]
    if part_gap is not None:
        return {f"{name}-{k}": ("unscripted", two(p[0][1] - 0.05), two(p[-1][2] + 0.05)) for k, p in enumerate(split(own, part_gap), 1)}
    found = [v for v in verses if not v[9] and (v[7] is not None or v[4] >= max(3, 0.3 * v[3]))]
    edges = [start if found and found[0][7] is None else found[0][7] if found else None]
    for v, nxt in zip(found, found[1:], strict=False):
        if nxt[7] is not None:
            edges.append(nxt[7])
        else:
            lo = (v[6] if v[7] is None else v[8]) - 0.3
            edges.append(silence(own, lo, nxt[5] + 1.2, (lo + nxt[5]) / 2))
    edges.append(end if found and found[-1][8] is None or found and found[-1][7] is None else found[-1][8] if found else None)
    out, covered = {}, []
    for v, a, z in zip(found, edges, edges[1:], strict=False):
        sid, mine = f"{name}-{v[2] + 1}", [n for n in own if a <= n[1] < z]
        covered.append((a, z))
        if v[7] is None:
            lead = [p for p in split(mine, 1.2) if p[-1][2] < v[5] - 0.6]
            if lead:
                at = silence(mine, lead[-1][-1][2] - 0.1, v[5] + 0.1, v[5] - 0.3)
                out[f"{sid}-lead"] = ("wordless", a, at)
                a = at
        out[sid] = ("sung", a, z)
    loose = [n for n in own if not any(a <= n[1] < z for a, z in covered)]
    return out | {f"{name}-x{k}": ("unscripted", two(p[0][1] - 0.05), two(p[-1][2] + 0.05)) for k, p in enumerate(split(loose, 1.2), 1)}


def made_up(seed):
    rnd = random.Random(seed)
    t, notes = 0.0, []
    for k in range(220):
        t = round(t + rnd.choice([0.0, 0.02, 0.1, 0.4, 1.2, 1.5, 3.0]), 3)
        d = round(rnd.uniform(0.1, 0.9), 3)
        notes.append((k, t, round(t + d, 3)))
        t += d
    last, blocks, verses = notes[-1][2], [], {}
    for b in range(4):
        blocks.append((seed, b, two(b * last / 4), two((b + 1) * last / 4), 0.8 if b == 3 else None))
        a, z = blocks[-1][2:4]
        verses[b] = []
        for v in range(3) if b < 3 else ():
            lo = a + (z - a) * v / 3
            start, end = round(lo + rnd.uniform(0, 12), 3), round(lo + (z - a) / 3 - rnd.uniform(0, 5), 3)
            over = rnd.random() < 0.25
            verses[b].append((seed, b, v, rnd.choice([5, 12]), rnd.choice([2, 3, 6]), start, max(start, end), two(lo + 1) if over else None, two(lo + (z - a) / 3 - 1) if over else None, rnd.random() < 0.15))
    return notes, blocks, verses


def test_sections_equal_a_plain_loop(spark):
    data = {s: made_up(s) for s in range(12)}
    notes = spark.createDataFrame([(s, *n) for s, (ns, _, _) in data.items() for n in ns], NOTES).repartition(4)
    blocks = spark.createDataFrame([b for _, bs, _ in data.values() for b in bs], BLOCKS)
    verses = spark.createDataFrame([v for _, _, vs in data.values() for own in vs.values() for v in own], VERSES)
    rows = S.find_sections(notes, blocks, verses, ["rec"], "note").collect()
    got = {(r["rec"], r["section"]): (r["kind"], pytest.approx(r["start"]), pytest.approx(r["end"])) for r in rows}
    want = {(s, sid): x for s, (ns, bs, vs) in data.items() for b in bs for sid, x in plain(ns, b, vs[b[1]]).items()}
    assert len(got) == len(rows) and {k: v for k, v in want.items()} == got
    assert {k for k, *_ in got.values()} == {"sung", "wordless", "unscripted"} and sum(k[1].endswith("-lead") for k in got) > 5
    for r in rows:
        mine = [n for n in data[r["rec"]][0] if r["start"] <= n[1] < r["end"]]
        assert r["notes"] == len(mine)
        stray = len(mine) < 6 or sum(n[2] - n[1] for n in mine) < 0.5 * (mine[-1][2] - mine[0][1])
        assert r["excluded"] == (r["kind"] == "wordless" and stray)
    assert S.find_sections(notes.limit(0), blocks, verses, ["rec"], "note").where("kind <> 'sung'").count() == 0


def test_words_outside_their_section_are_no_evidence(spark):
    rows = [(1, 0, 9.0, 9.2, "heard"), (1, 1, 40.0, 40.2, "heard"), (1, 2, None, None, "none"), (1, 3, 13.0, 13.2, "heard"), (1, 4, 14.0, 14.2, "interpolated"), (2, 0, None, None, None), (2, 1, 50.0, 51.0, "heard")]
    t = spark.createDataFrame([(*r, 9.4 if r[0] == 1 else 0.0, 20.0) for r in rows], "sec int, k int, start double, end double, anchor string, s_start double, s_end double")
    got = {(r["sec"], r["k"]): (r["start"], r["end"], r["anchor"]) for r in S.weak_anchors(t, ["sec"], "k").collect()}
    near = lambda a, b, c: (pytest.approx(a), pytest.approx(b), c)
    step = (13.0 - 9.2) / 3
    assert got[1, 0] == near(9.0, 9.2, "heard") and got[1, 1] == near(9.2 + step, 9.35 + step, "interpolated") and got[1, 2] == near(9.2 + 2 * step, 9.35 + 2 * step, "interpolated")
    assert got[1, 4] == near(13.2 + 6.8 / 2, 13.35 + 6.8 / 2, "interpolated") and got[2, 0] == near(20 / 3, 20 / 3 + 0.15, "interpolated") and got[2, 1] == near(40 / 3, 40 / 3 + 0.15, "interpolated")
