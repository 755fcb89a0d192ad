"""Byte-pair encoding against the tokenizers library, word by word and over whole tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from melodyspark.llm import bpe
from melodyspark.llm.arrowtext import chunks
from melodyspark.llm.queries import op11_bpe_round_trip

LETTERS = "aaaabbcdeé ßΣσςİıÀÁ \t\n\x0b\x1c\x85 'sS'ſK'REm<>|019٣½中文漢字🎵-–_‍̀"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.WORD_BPE)


@pytest.fixture(scope="module")
def known():
    with open(bpe.WORD_BPE) as f:
        return bpe.Known(bpe.Vocabulary(f.read()), most=3000)


def ids(known, texts):
    out = []
    for _, _, data, at in chunks(pa.array(texts, pa.string()), 4000):
        flat, counts = known.texts(data, at)
        out += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    return out


def test_random_texts_as_the_library(known, library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += [f"{t[:9]}<|endoftext|>{t[9:]}<|startoftext|>" for t in texts[:100]]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x80, 0x3000), rnd.randrange(0x20, 0x7F), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    texts += ["a" * n for n in range(40)] + ["ab" * n for n in range(20)] + ["x" * 5000, "", " \n"]
    assert ids(known, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_vocabulary_out_of_order_is_refused():
    import json

    with open(bpe.WORD_BPE) as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError, match="merges"):
        bpe.Vocabulary(json.dumps(spec))


def test_tables(spark, library):
    texts = [(1, None), (2, ""), (3, "One  TWO two"), (3, "One  TWO two"), (None, "the cat's <|endoftext|> Σας"), (5, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, ids string, row string").repartition(2)
    got = bpe.decode(bpe.encode(docs, chunk=50), most=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.encode(docs, decoded=True).collect()))
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in texts]
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == sorted((str(i), w, library.decode(w, skip_special_tokens=False)) for (i, _), w in zip(texts, want, strict=True))
    assert bpe.decode(bpe.encode(docs.where("false"))).count() == 0


def test_decoding_passes_over_unknown_ids(spark, library):
    lists = [(1, [0, 5, 10**6, None, 49407, -3]), (2, None), (3, [])]
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(lists, "doc_id long, ids array<int>").coalesce(1)).collect()}
    assert got == {1: library.decode([0, 5, 49407], skip_special_tokens=False), 2: None, 3: ""}


def test_query(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r[1:] for r in op11_bpe_round_trip(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        e = library.encode(r["text"], add_special_tokens=False).ids
        hexed = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e)), library.decode(e, skip_special_tokens=False))]
        assert got[r["doc_id"]] == (len(e), *hexed)


def test_a_text_costs_little_beside_a_large_table_of_known_pieces(known):
    import time

    table = bpe.Known(known.vocab)
    table.hash = np.arange(2_000_000, dtype=np.uint64) << np.uint64(43)
    table.start = table.length = np.zeros(len(table.hash), np.int64)
    texts = [f"some new{k} text" for k in range(12)]
    begin = time.process_time()
    got = [ids(table, [t])[0] for t in texts]
    took = time.process_time() - begin
    assert len(table.hash) > 2_000_000 and (np.diff(table.hash.astype(object)) > 0).all()
    assert got == ids(known, texts) and took < 2
