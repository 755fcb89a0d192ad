"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from melodyspark.llm import decontaminate, exact_dedup, line_dedup, mixing, ngram_join, quality, substring_dedup, token_counts, toxicity, warc

rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
LONG = " ".join(rnd.choice(WORDS) for _ in range(40_000))
BASE = " ".join(rnd.choice(WORDS) for _ in range(120))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, "One TWO"), (6, "One TWO"), (None, "one two"), (None, None),
    (7, LONG), (8, BASE), (9, BASE.upper()), (10, BASE + " tail"), (11, "échelle ÉCHELLE ünïcode 字"), (12, "spam " * 300),
]
SCHEMA = "doc_id long, text string, lang string, source string, row string, n long, label string, digest string, evidence string, token string, copies string, block string, cid string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", "r", k, "l", "d", "e", "t", "c", "b", "x") for k, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, None, None), (7, 1, 0), (8, 1, 0), (10, 0, 1), (12, 0, 1), (99, 1, 1), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def test_exact_dedup(docs, empty):
    got = exact_dedup.duplicate_groups(docs, share=0.1, counters=20).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(low(t), []).append(i)
    want = sorted(
        (str(i), str(max((x for x in groups[low(t)] if x is not None), default=None)), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest())
        for i, t in TEXTS
    )
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [low(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted(groups)
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_heavy_and_ordinary_digests_agree(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    by = lambda **p: sorted(map(tuple, exact_dedup.duplicate_groups(df, **p).collect()))
    assert by(share=0.2, counters=10) == by(share=0.9, counters=3)
    low_counts = {r["key"]: r["low"] for r in exact_dedup.frequent_keys(df.withColumn("k", F.xxhash64("text")), "k", 10).collect()}
    assert max(low_counts.values()) >= 1000 - 3000 / 11


def test_ngram_join(docs, empty):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.near_duplicate_components(docs).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3
    assert got[4, 1] == got[5, 1] == got[6, 1] == 4
    assert got[None, 1] is None and got[None, 0] is None
    assert {v for (i, _), v in got.items() if i in (8, 9, 10)} == {8}
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "7", "8", "11", "12", "None", "None"])
    assert ngram_join.near_duplicate_components(empty).count() == 0


def test_decontamination(spark, docs, empty):
    words = BASE.split()
    items = [(1, " ".join(words[10:40]).upper()), (2, "one   TWO"), (2, "one two"), (3, None), (4, ""), (None, " ".join(words[50:65])), (10, "not here " * 10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (64 << 20, 400):
        got = {r["doc_id"]: r for r in decontaminate.contamination_report(docs.where("doc_id is not null"), bench, max_bytes=limit).collect()}
        assert (got[8]["n_words"], got[8]["n_hit"], got[8]["n_items"], got[8]["contaminated"]) == (120, 45, 1, True)
        assert got[8]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
        assert (got[4]["n_hit"], got[4]["items_sha256"]) == (2, hashlib.sha256(b"2").hexdigest())
        assert (got[1]["n_words"], got[1]["contaminated"], got[1]["items_sha256"]) == (0, False, hashlib.sha256(b"").hexdigest())
        assert not got[7]["contaminated"]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs.where("doc_id in (1, 8, 11)"), bench).collect()}
    assert cut[1] is None and cut[11] == TEXTS[13][1] and cut[8].split() == words[:10] + words[40:50] + words[65:]
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 7, 11, 12, None}
    assert decontaminate.contamination_report(empty, bench).count() == 0
    assert decontaminate.contamination_report(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_toxicity_and_quality(docs, empty, labels):
    got = toxicity.toxicity_report(docs, labels)
    assert got.count() == len(TEXTS) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity_report(empty, labels).count() == 0
    assert toxicity.toxicity_report(docs, labels.where("false")).count() == len(TEXTS)
    q = quality.perplexity_report(docs, labels)
    assert q.count() == len(TEXTS) and q.where("n_scored = 0 and kept").count() == 0
    assert q.where("doc_id = 7 and kept").count() == 1
    assert quality.perplexity_report(empty, labels).count() == 0
    assert quality.perplexity_report(docs, labels.where("false")).count() == len(TEXTS)


def test_token_counts(docs, empty):
    lengths = token_counts.encoded_lengths(docs)
    h = {r["n_tokens"]: r for r in token_counts.length_histogram(lengths, stride=4).collect()}
    each = sorted(r["n_tokens"] for r in lengths.collect())
    for limit, r in h.items():
        assert r["docs"] == each.count(limit) and r["docs_over"] == sum(x > limit for x in each)
        assert r["tokens_over"] == sum(x for x in each if x > limit) and r["tokens_kept"] == sum(min(x, limit) for x in each)
    hist = token_counts.length_histogram(lengths)
    at = {r["context"]: r["tokens_kept"] for r in token_counts.at_limits(hist, [0, 3, 1000, 10**6]).collect()}
    assert at == {c: sum(min(x, c) for x in each) for c in at}
    assert token_counts.quantile(hist, 0.5) == each[(len(each) + 1) // 2 - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty)).count() == 0


def test_encoder_round_trip(docs):
    """Every text decodes to itself, and no token joins two of the pattern's pieces."""
    import regex

    enc = token_counts.encoder(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.encoded_lengths(docs.where("doc_id is not null")).collect()}
    for i, t in TEXTS:
        if i is not None:
            ids = enc.encode_ordinary(t or "")
            assert enc.decode(ids) == (t or "") and got[i] == len(ids)
            assert len(ids) == sum(len(enc.encode_ordinary(x)) for x in regex.findall(token_counts.PATTERN, t or ""))


def test_mixing(docs, empty):
    plan = mixing.plan_mix(docs, entropy_share=0.99, max_repeats=3.0, block_docs=2)
    rows = plan.collect()
    assert len(rows) == len(TEXTS) and min(r["copies"] for r in rows) >= 0
    total = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["copies"] for r in rows) <= total
    assert mixing.plan_mix(empty).count() == 0
    mixed = mixing.mix(docs, block_docs=2)
    assert set(docs.columns) | {"epoch", "block_key", "place_key"} == set(mixed.columns)
    one = mixing.plan_mix(docs.withColumn("source", F.lit("s")), block_docs=3).collect()
    assert all(r["copies"] == 1 for r in one if r["n_tokens"])


def test_temperature_reaches_its_target(spark):
    import math

    counts = [1000, 100, 10, 1]
    src = spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(counts)], "source string, tokens long")
    tau = mixing.temperature(src, float(sum(counts)), 0.8, 1e9)

    def entropy(t):
        w = [(c / sum(counts)) ** t for c in counts]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    assert entropy(tau) >= 0.8 * math.log(4) > entropy(tau + 2 / mixing.STEPS)
    limited = mixing.temperature(src, float(sum(counts)), 0.999, 4.0)
    w = [(c / sum(counts)) ** limited for c in counts]
    assert max(sum(counts) * x / sum(w) / c for x, c in zip(w, counts, strict=True)) <= 4.0


def test_line_dedup(spark, docs, empty):
    line = ["this is a shared line number one", "and a second shared line follows it", "short", "own line of the first document"]
    rows = [(1, "\n".join(line)), (2, "\n".join(["new beginning of the second one", line[0], "  " + line[1], "own end"])), (3, line[2]), (4, "\n".join(line)), (4, "\n".join(line)), (5, None)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["kept_text"] == "new beginning of the second one\nown end" and got[2]["removed"] == [1, 2]
    assert got[3]["kept_text"] == "short" and got[4]["n_removed"] == 4 and (got[5]["n_lines"], got[5]["n_removed"]) == (1, 0)
    assert line_dedup.dedup_lines(docs).count() == len(TEXTS) and line_dedup.dedup_lines(empty).count() == 0


def test_patience_diff_keeps_order():
    for _ in range(100):
        a, b = ([rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        got = line_dedup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:], strict=False))
    assert len(line_dedup.aligned(list("abcdef"), list("abcdef"))) == 6


def test_substring_dedup(docs, empty):
    def brute(rows, size):
        words = [(t or "").split(" ") if (t or "").strip() else [] for _, t in rows]
        words = [[w for w in " ".join(ws).split()] for ws in words]
        seen = {}
        for ws in words:
            for i in range(len(ws) - size + 1):
                key = tuple(ws[i : i + size])
                seen[key] = seen.get(key, 0) + 1
        out = []
        for (i, _), ws in zip(rows, words, strict=True):
            gone = {p for s in range(len(ws) - size + 1) if seen[tuple(ws[s : s + size])] > 1 for p in range(s, s + size)}
            out.append((str(i), len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
        return sorted(out)

    for params in ({}, {"hot": 1, "shard_words": 200}):
        got = substring_dedup.remove_repeats(docs, **params).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute(TEXTS, 35)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_warc(spark):
    rows = [
        (1, "response", "http://www.a.org/x/", 10, "t1", 1, {"etag": "t1", "server": "s", "vary": None}, "p1"),
        (2, "response", "https://A.org/x?utm_source=q#f", 10, "t2", 2, {"etag": "t2", "date": "d0"}, "p2"),
        (3, "revisit", "http://m.a.org/x.html", 11, "W/t2", None, {"date": "d1", "content-length": "0"}, None),
        (4, "revisit", "http://a.org/x", 10, "t1", None, None, None),
        (5, "revisit", "http://a.org/x", 99, "old", None, {}, None),
        (6, "revisit", "http://a.org/x", 99, None, 2, None, None),
        (7, "revisit", None, 99, "t2", 2, None, None),
        (8, "revisit", "http://a.org/x", None, "t2", 2, None, None),
        (9, "revisit", "http://a.org/x", 99, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, t long, etag string, last_modified long, headers map<string,string>, payload_sha256 string")
    for n in (1, 500_000):
        got = {r["record_id"]: r for r in warc.resolve_revisits(df, bucket_rows=n).collect()}
        assert {k: (r["response_id"], r["status"]) for k, r in got.items()} == {3: (2, "resolved"), 4: (None, "no-response"), 5: (2, "validator-mismatch"), 6: (2, "resolved"), 7: (None, "no-response"), 8: (None, "no-response"), 9: (2, "no-validator")}
        assert (got[3]["payload_sha256"], got[3]["headers"]) == ("p2", "date: d1\netag: t2")
    assert warc.resolve_revisits(df.where("false")).count() == 0
