"""Byte-pair encoding and decoding of whole texts by a pair occurrence index.

A vocabulary of words with end marks (a tokenizers JSON file) is read on the driver and broadcast.
Each task takes its partition in Arrow batches. Texts are cut at spaces, which no word
crosses; the distinct words of those pieces of a batch that this worker has not met are laid side by side as symbols; an index maps every mergeable pair to all its positions
among them. Active ranks are applied in ascending order: all positions of the rank's pair are
merged, leftmost first, and the lists of the pairs that each merge makes with its neighbours are
extended; positions whose symbols have changed since are passed over. Texts are then the ids of
their pieces. Memory follows a batch and a bounded table of known pieces, not the partition.

Defined results: null and empty texts have no ids; they decode to an empty text. Strings of the
special tokens in a text become these tokens. Null id lists decode to null, ids that the vocabulary
lacks and null ids are passed over. Rows that repeat a doc_id are rows of their own. An empty table
gives an empty result. Of the input only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melodyspark.llm.arrowtext import SPACED, chunks
from melodyspark.llm.arrowtext import words as words_of
from melodyspark.llm.token_counts import TOKENIZERS

WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
#: ids that a worker's table of known pieces may hold; beyond, it begins anew
KNOWN = 6_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and word pattern of a tokenizers file with word ends, lower case and no unknown token."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        normal = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or spec["decoder"] is not None or model["unk_token"] is not None:
            raise ValueError("a vocabulary of lower-case words with end marks is needed")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        ids: dict[str, int] = model["vocab"]
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.tokens: list[str | None] = [names.get(i) for i in range(max(names) + 1)]
        letters, end = byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        #: by rank what is merged into what
        self.merges: list[tuple[int, int, int]] = []
        latest: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, new = ids[a], ids[b], ids[a + b]
            latest[new] = r
            self.merges.append((left, right, new))
        if len(latest) < len(self.merges) or any(max(latest.get(a, -1), latest.get(b, -1)) >= r for r, (a, b, _) in enumerate(self.merges)):
            raise ValueError("merges do not follow those that make their parts")
        keys = np.array([a << 32 | b for a, b, _ in self.merges], np.int64)
        self.ranks = np.argsort(keys)
        self.pairs = keys[self.ranks]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.source, self.library = text, None

    def newer(self, text: str) -> list[str]:
        """Words of a text with characters that Python's tables lack: cut by the tokenizers library, whose tables are newer."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in cut]

    def words(self, text: str) -> list[str]:
        """Words of a text after composition and, letter by letter, lower case."""
        if not text.isascii():
            if "Cn" in set(map(unicodedata.category, set(text))):
                return self.newer(text)
            text = unicodedata.normalize("NFC", text)
            # the whole-text form would treat a final sigma apart
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        return self.pattern.findall(text)


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending positions of a pair of equal symbols, those that are merged when each symbol takes part once, leftmost first."""
    kept: list[int] = []
    taken = -1
    for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
        if p != taken:
            kept.append(p)
            taken = q
    return np.array(kept, np.int64)


def merge_words(words: list[str], vocab: Vocabulary) -> list[bytes]:
    """The ids of each word as 32-bit integers, all words merged together rank by rank."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), np.uint8)
    symbol = vocab.inner[data]
    symbol[ends - 1] = vocab.final[data[ends - 1]]
    after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
    after[ends - 1] = before[ends - sizes] = -1
    where: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(p: np.ndarray) -> None:
        """Enter positions whose pair with the next symbol can be merged."""
        key = symbol[p] << 32 | symbol[after[p]]
        i = np.minimum(np.searchsorted(vocab.pairs, key), len(vocab.pairs) - 1)
        good = vocab.pairs[i] == key
        p, r = p[good], vocab.ranks[i[good]]
        if not len(p):
            return
        order = np.argsort(r, kind="stable")
        p, r = p[order], r[order]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        for lo, hi, rank in zip(first.tolist(), [*first[1:].tolist(), len(r)], r[first].tolist(), strict=True):
            if rank not in where:
                where[rank] = []
                heapq.heappush(active, rank)
            where[rank].append(p[lo:hi])

    add(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        left, right, new = vocab.merges[rank]
        p = np.sort(np.concatenate(where.pop(rank)))
        p = p[np.diff(p, prepend=-1) > 0]
        q = after[p]
        p = p[(symbol[p] == left) & (q >= 0) & (symbol[q] == right)]
        if left == right:
            p = _leftmost(p, after)
        q = after[p]
        symbol[p], symbol[q] = new, -1
        n = after[q]
        after[p] = n
        before[n[n >= 0]] = p[n >= 0]
        o = before[p]
        add(np.concatenate([p[n >= 0], o[o >= 0]]))
    stays = symbol >= 0
    upto = np.concatenate([[0], np.cumsum(stays)[ends - 1]]) * 4
    flat = symbol[stays].astype(np.int32).tobytes()
    return [flat[lo:hi] for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def _piece_ids(pieces: list[str], vocab: Vocabulary) -> list[bytes]:
    """The ids of pieces of text without spaces; the distinct words of all of them are merged together."""
    cut: list[list[str | int]] = []
    for piece in pieces:
        row: list[str | int] = []
        for part in vocab.split.split(piece) if vocab.split and "<" in piece else [piece]:
            row += [vocab.special[part]] if part in vocab.special else vocab.words(part)
        cut.append(row)
    words = list({w for row in cut for w in row if isinstance(w, str)})
    ids: dict[str | int, bytes] = dict(zip(words, merge_words(words, vocab), strict=True)) if words else {}
    ids |= {i: np.int32(i).tobytes() for i in vocab.special.values()}
    return [b"".join([ids[w] for w in row]) for row in cut]


class Known:
    """Pieces met by this worker, by ascending 64-bit hash: where their ids lie in one array. Begins anew beyond ``most`` ids."""

    def __init__(self, vocab: Vocabulary, most: int = KNOWN) -> None:
        self.vocab, self.most = vocab, most
        self.clear()

    def clear(self) -> None:
        self.hash, self.start, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def learn(self, at: np.ndarray, hashes: np.ndarray, pieces: list[str]) -> None:
        """Enter pieces, by ascending hash, before the places ``at`` of the table."""
        made = _piece_ids(pieces, self.vocab)
        length = np.array([len(x) // 4 for x in made], np.int64)
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), np.int32)])
        self.hash, self.start, self.length = np.insert(self.hash, at, hashes), np.insert(self.start, at, start), np.insert(self.length, at, length)

    def texts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of texts in a row, and how many each text has."""
        if len(self.ids) > self.most:
            self.clear()
        w = words_of(data, at, SPACED, lower=False)
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        found = np.searchsorted(self.hash, distinct)
        fresh = np.ones(len(distinct), bool)
        if len(self.hash):
            fresh = self.hash[np.minimum(found, len(self.hash) - 1)] != distinct
        raw = data.tobytes()
        self.learn(found[fresh], distinct[fresh], [raw[s:e].decode() for s, e in zip(w.start[first[fresh]].tolist(), w.end[first[fresh]].tolist(), strict=True)])
        found = np.searchsorted(self.hash, distinct)
        start, length = self.start[found][inverse], self.length[found][inverse]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(start - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[w.first[1:]] - upto[w.first[:-1]]


@lru_cache(maxsize=2)
def _known(text: str) -> Known:
    """One table a Python worker and vocabulary, kept from task to task."""
    return Known(Vocabulary(text))


def _joined(ids: pa.Array, offsets: np.ndarray, names: pa.Array) -> pa.Array:
    """The tokens of each list of ids joined by one space; ids without a token are passed over."""
    at = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    good = (at >= 0) & (at < len(names))
    taken = names.take(pa.array(np.where(good, at, 0)))
    good &= taken.is_valid().to_numpy(zero_copy_only=False)
    if not good.all():
        offsets, taken = np.concatenate([[0], np.cumsum(good)])[offsets], taken.filter(pa.array(good))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), taken), pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, chunk: int = 2 << 20, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row, and with ``decoded`` what these ids decode to.

    ``chunk``: bytes of text whose words are merged together; memory follows it and the longest text.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        names = pa.array(known.vocab.tokens, pa.large_string())
        for b in batches:
            for lo, hi, data, at in chunks(b.column(1), chunk):
                ids, counts = known.texts(data, at)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                out = {"doc_id": b.column(0).slice(lo, hi - lo), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))}
                if decoded:
                    out["decoded"] = _joined(pa.array(ids), offsets, names)
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str = WORD_BPE, most: int = 1_000_000) -> DataFrame:
    """``encoded`` with column decoded: the tokens of ``ids_col``, word ends and special tokens included, joined by one space.

    Batches are taken in slices of about ``most`` ids.
    """
    spark = encoded.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(_known(shared.value).vocab.tokens, pa.large_string())
        for b in batches:
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
                lists = b.column(1).slice(lo, hi - lo)
                text = _joined(lists.flatten(), upto[lo : hi + 1] - upto[lo], names)
                yield pa.RecordBatch.from_pydict({"row": b.column(0).slice(lo, hi - lo), "decoded": pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))})
                lo = hi

    row = encoded.select(F.struct(*[encoded[f"`{c}`"] for c in encoded.columns]).alias("row"), F.col(f"`{ids_col}`").alias("ids"))
    out = row.mapInArrow(run, T.StructType([row.schema["row"], T.StructField("decoded", T.StringType())]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in encoded.columns], "decoded")
