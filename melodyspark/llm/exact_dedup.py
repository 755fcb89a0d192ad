"""Exact duplicate removal with a heavy-hitter split.

Texts are equal when they are identical after lower-casing A-Z. Misra-Gries summaries of every
partition find the digests that may be frequent; their exact groups are counted, verified with a
second digest, and broadcast, so rows of frequent texts are settled map-side and never meet in a
shuffle. All other digests go through an ordinary shuffled aggregation and join.

Defined results: null and empty texts are equal (an empty text). Null doc_ids rank below all
others. Rows that repeat a doc_id are rows of their own: each counts in ``group_size``, each is
reported, and of a group only one row is kept. An empty table gives an empty result. Extra columns
are never read, and passed through by ``exact_dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melodyspark.llm.arrowtext import LOWER, strings
from melodyspark.llm.scratch import materialize, same_row, without


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1 and k2 (hashes of id and text), digest (SHA-256 of the normalised text), check (a second digest with the length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = strings(b.column(3))
            base = int(at[0])
            low = memoryview(LOWER[data[base : at[-1]]].tobytes())
            cut = (at - base).tolist()
            parts = [low[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:3],
                    pa.array([hashlib.sha256(p).digest() for p in parts], pa.binary()),
                    pa.array([hashlib.blake2b(p, digest_size=12, key=len(p).to_bytes(8, "little")).digest() for p in parts], pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "digest", "check"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    k1, k2 = same_row(F.col(id_col), text)
    rows = docs.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, digest binary, check binary")


def _trim(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k counters: subtract the (k+1)th largest count from all, drop what is not positive."""
    if len(keys) <= k:
        return keys, counts
    cut = np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
    stay = counts > cut
    return keys[stay], counts[stay] - cut


def frequent_keys(keyed: DataFrame, key_col: str, counters: int) -> DataFrame:
    """Misra-Gries counters of every partition, summed: key, low (at most the true count).

    A key's true count exceeds ``low`` by no more than rows / (counters + 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            both = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            more = np.concatenate([counts, np.ones(b.num_rows, np.int64)])
            keys, where = np.unique(both, return_inverse=True)
            keys, counts = _trim(keys, np.bincount(where, more, len(keys)).astype(np.int64), counters)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "low"])

    local = keyed.select(F.col(key_col).alias("key")).mapInArrow(run, "key long, low long")
    return local.groupBy("key").agg(F.sum("low").alias("low"))


def _settled(docs: DataFrame, id_col: str, text_col: str, share: float, counters: int) -> DataFrame:
    """One row per input row: own (doc_id, k1, k2 and a number of the row), keep (that of the row that stays), group_size, digest."""
    narrow = digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    narrow = materialize(narrow.select(F.struct("doc_id", "k1", "k2", "row").alias("own"), "digest", "check"), "digests")
    keyed = narrow.withColumn("key", F.xxhash64("digest"))
    total = narrow.count()
    least = total * (share - 1 / (counters + 1))
    maybe = frequent_keys(keyed, "key", counters).where(F.col("low") >= F.lit(max(least, 2.0))).select("key")
    group = [F.max("own").alias("keep"), F.count(F.lit(1)).alias("group_size")]
    heavy = (
        keyed.join(F.broadcast(maybe), "key", "left_semi")
        .groupBy("digest")
        .agg(*group, F.min("check").alias("c1"), F.max("check").alias("c2"))
        .where((F.col("c1") == F.col("c2")) & (F.col("group_size") >= F.lit(max(total * share, 2.0))))
        .select("digest", "keep", "group_size")
    )
    winners = F.broadcast(materialize(heavy, "frequent"))
    settled = narrow.join(winners, "digest", "inner").select("own", "digest", "keep", "group_size")
    rest = narrow.select("own", "digest").join(winners, "digest", "left_anti")
    shuffled = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return settled.unionByName(shuffled.select("own", "digest", "keep", "group_size"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.002, counters: int = 2000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``share``: digests of at least this share of all rows are settled by broadcast. At most
    1 / (share - 1 / (counters + 1)) candidates can pass, so the broadcast is bounded by the two
    parameters (about 670 rows by default), whatever the input.
    """
    return _settled(docs, id_col, text_col, share, counters).select(
        "own.doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("own.row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.002, counters: int = 2000, max_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; one row of each group of equal texts.

    Rows go by the keys of dropped ones, which are broadcast up to ``max_broadcast``: no text is
    shuffled but of rows that repeat both doc_id and text, of which one stays.
    """
    rows = materialize(_settled(docs, id_col, text_col, share, counters).where(F.col("own.row") != F.col("keep.row")).select("own", "keep"), "dropped")
    same = (F.col("own.k1") == F.col("keep.k1")) & (F.col("own.k2") == F.col("keep.k2"))
    kept = without(docs, rows.where(~same).select("own.k1", "own.k2"), id_col, text_col, max_broadcast)
    again = rows.where(same).select("own.k1", "own.k2")
    if again.isEmpty():
        return kept
    once = without(kept, again, id_col, text_col, max_broadcast)
    again = F.broadcast(again.distinct()) if again.count() <= max_broadcast else again.distinct()
    k1, k2 = same_row(kept[f"`{id_col}`"], kept[f"`{text_col}`"].cast("string"))
    whole = kept.select(F.struct(*[kept[f"`{c}`"] for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    one = whole.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return once.unionByName(one.select("row.*"))
