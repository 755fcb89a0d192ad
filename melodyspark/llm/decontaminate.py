"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is
13 consecutive words of a benchmark item; an item of fewer words is one window of its own length.
Every window of every document is looked up by hash, each hit is verified word by word, and the
words that verified windows cover are hit.

The set is broadcast only while it stays under ``max_bytes``, which is measured first. A larger
benchmark is split by window into blocks under that bound; documents are scanned once per block, each
scan is written before the next begins, and the blocks' hits are united per document.

Defined results: null or empty texts have no words and no hits. Items without words have no
windows. An item without an id can hit words but is not counted in n_items. Items that repeat an
id count once. Rows that repeat a doc_id are rows of their own. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melodyspark.llm.arrowtext import ALNUM, Words, chunks, joined, windows, words
from melodyspark.llm.scratch import materialize

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def benchmark_windows(benchmark: DataFrame, size: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, n (words), window (normalised words), item: the distinct windows of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"hash": [], "n": [], "window": [], "item": []}
            ids = b.column(0).to_pylist()
            for lo, _, data, at in chunks(b.column(1)):
                w = words(data, at, ALNUM, lower=True)
                lengths = np.diff(w.first)
                for k in sorted({min(size, int(x)) for x in lengths if x}):
                    begin, hashes = windows(w, k)
                    row = w.row[begin]
                    for i, r, h in zip(begin.tolist(), row.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        if min(size, lengths[r]) == k:
                            out["hash"].append(h)
                            out["n"].append(k)
                            out["window"].append(joined(data, w, i, i + k, lower=True))
                            out["item"].append(ids[lo + r])
            yield pa.RecordBatch.from_arrays([pa.array(out["hash"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["window"], pa.binary()), pa.array(out["item"], pa.string())], names=list(out))

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "hash long, n int, window binary, item string").distinct()


@dataclass
class WindowSet:
    """Windows of one block: sorted hashes by length, and what stands behind each hash."""

    by_length: dict[int, np.ndarray] = field(default_factory=dict)
    behind: dict[tuple[int, int], list[tuple[bytes, str | None]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list) -> WindowSet:
        out = cls()
        lengths: dict[int, set[int]] = {}
        for r in rows:
            lengths.setdefault(r["n"], set()).add(r["hash"])
            out.behind.setdefault((r["n"], r["hash"]), []).append((bytes(r["window"]), r["item"]))
        out.by_length = {k: np.sort(np.array(list(v), np.int64).view(np.uint64)) for k, v in lengths.items()}
        return out

    def filters(self) -> dict[int, np.ndarray]:
        """A bit per 20-bit hash prefix, to pass over most windows with one lookup."""
        out = {}
        for k, v in self.by_length.items():
            out[k] = np.zeros(1 << 20, bool)
            out[k][(v >> np.uint64(44)).astype(np.int64)] = True
        return out


def _hits(w: Words, data: np.ndarray, known: WindowSet, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Per word: covered by a verified window; per row: the items that occur."""
    cover = np.zeros(len(w.hash) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for k, sorted_hashes in known.by_length.items():
        begin, hashes = windows(w, k)
        maybe = filters[k][(hashes >> np.uint64(44)).astype(np.int64)]
        begin, hashes = begin[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
        found = sorted_hashes[at] == hashes
        begin, hashes = begin[found], hashes[found]
        rows = np.searchsorted(w.first, begin, "right") - 1
        for i, r, h in zip(begin.tolist(), rows.tolist(), hashes.view(np.int64).tolist(), strict=True):
            text = joined(data, w, i, i + k, lower=True)
            same = [item for window, item in known.behind[k, h] if window == text]
            if same:
                cover[i] += 1
                cover[i + k] -= 1
                items.setdefault(r, set()).update(x for x in same if x is not None)
    return np.cumsum(cover)[:-1] > 0, items


def _scan(docs: DataFrame, text_col: str, known: WindowSet) -> DataFrame:
    """``docs`` as column ``row`` with its ``hits`` in one block of windows."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        filters = known.filters()
        for b in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for lo, hi, data, at in chunks(b.column(1)):
                w = words(data, at, ALNUM, lower=True)
                hit, found = _hits(w, data, known, filters)
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words += np.diff(w.first).tolist()
                n_hit += (total[w.first[1:]] - total[w.first[:-1]]).tolist()
                for r in range(hi - lo):
                    if n_hit[lo + r] == 0:
                        spans.append([])
                        items.append([])
                        continue
                    own = np.concatenate([[0], hit[w.first[r] : w.first[r + 1]].astype(np.int8), [0]])
                    edge = np.diff(own)
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                    items.append(sorted(found.get(r, ())))
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
            hits = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind.field(2).type), pa.array(items, kind.field(3).type)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), hits], names=["row", "hits"])

    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([row.schema["row"], T.StructField("hits", HITS)])
    return row.mapInArrow(run, schema)


def _cover(spans: F.Column) -> F.Column:
    """Words that the united spans cover."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        ordered,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, max_bytes: int = 64 << 20) -> DataFrame:
    """``row`` (a struct of all columns of docs) and ``hits`` (n_words, n_hit, spans, items)."""
    table = materialize(benchmark_windows(benchmark, size), "windows")
    weight = table.agg(F.coalesce(F.sum(F.length("window") + 400), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-int(weight) // max_bytes))
    if blocks == 1:
        return _scan(docs, text_col, WindowSet.of(table.collect()))
    block = F.pmod(F.xxhash64("window", F.lit(7)), F.lit(blocks))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    numbered = materialize(whole.withColumn("key", F.monotonically_increasing_id()), "rows")
    parts = None
    for k in range(blocks):
        part = _scan(numbered.select("key", F.col(f"row.`{text_col}`").alias("text")), "text", WindowSet.of(table.where(block == k).collect())).select(F.col("row.key").alias("key"), "hits")
        # written before the next block is collected, so the driver holds one block at a time
        part = materialize(part.where((F.col("hits.n_hit") > 0) | F.lit(k == 0)), "block-hits")
        parts = part if parts is None else parts.unionByName(part)
    united = parts.groupBy("key").agg(
        F.max("hits.n_words").alias("n_words"),
        F.flatten(F.collect_list("hits.spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits.items")))).alias("items"),
    )
    hits = F.struct("n_words", _cover(F.col("spans")).alias("n_hit"), "spans", "items").cast(HITS).alias("hits")
    return numbered.join(united.select("key", hits), "key").select("row", "hits")


def is_contaminated(hits: str = "hits", share: int = 20) -> F.Column:
    """The rule: some word is hit, and hit words are at least one in ``share`` of all words."""
    return (F.col(f"{hits}.n_hit") > 0) & (share * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of hit words."""
    return scan(docs, benchmark, id_col, text_col, **params).select(
        F.col(f"row.{id_col}").alias("doc_id"),
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        F.col("hits.spans").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns."""
    return scan(docs, benchmark, id_col, text_col, **params).where(~is_contaminated()).select("row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """``docs`` with every hit span of words cut out of the text; other columns as they are."""
    found = scan(docs, benchmark, id_col, text_col, **params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = b.column(2).to_pylist(), []
            for lo, hi, data, at in chunks(b.column(1)):
                w = words(data, at, ALNUM, lower=False)
                for r in range(hi - lo):
                    piece, upto = [], int(at[r])
                    first = int(w.first[r])
                    for s in sorted(spans[lo + r] or [], key=lambda x: x["start"]):
                        piece.append(data[upto : max(upto, int(w.start[first + s["start"]]))].tobytes())
                        upto = max(upto, int(w.end[first + s["end"] - 1]))
                    piece.append(data[upto : int(at[r + 1])].tobytes())
                    texts.append(b"".join(piece).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "cut"])

    rows = found.select("row", F.col(f"row.`{text_col}`").alias("text"), F.col("hits.spans").alias("spans"))
    cut = rows.mapInArrow(run, T.StructType([found.schema["row"], T.StructField("cut", T.StringType())]))
    return cut.select(*[F.when(F.col(f"row.`{c}`").isNull(), F.lit(None)).otherwise(F.col("cut")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


