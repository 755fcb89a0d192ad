"""Grouped prefix join on word n-gram sets under Jaccard similarity.

A document's set holds its distinct shingles of five words; a shorter document is one shingle.
Shingles have one global order, rare ones first: all but the frequent by hash, then the frequent by
count. Two sets of similarity 0.8 or more share a shingle among the first n - ceil(0.8 n) + 1 of
each (the prefix), and where they first meet, what is left of both must still suffice.

1. Documents with equal sets are one class; classes with identical prefixes and size are one group, and
   only groups are posted under their prefix shingles.
2. Under each shingle the group whose shingle stands first in its prefix is the hub. Pairs of a group and
   its hub are filtered by size and position, once for all members, and made distinct over all shingles; what
   is left is expanded to the members of the group against the hub's first member, as are the members of
   each group against their own first one, and verified on whole texts.
3. Verified links are joined to components. A group then has a part for each component its members lie in.
   Shingles under which parts of several components are left give pairs of parts: of each part with another
   hub, then of all parts that are not of the shingle's main component with all others. Pairs of parts are
   filtered and made distinct as those of groups were, then expanded to members and verified.

Pairs inside one component are never needed again, so a large group of near copies costs about one
pair a member, not all pairs; yet every pair that could link two components is verified, so the
components are exact. The last step may still meet many parts under one shingle, where many
components that are not similar share it in their prefixes; shingles are rare first to keep that small.
Frequencies of all shingles are counted; they decide only the order, never what is compared, and at
most ``max_frequent`` of the most frequent are broadcast. Shingles of very many groups are dealt over
several tasks.

A class is known by a 64-bit hash of the id and text of its first row, so classes differ even where
rows repeat a doc_id. Texts of a class that meets many others are copied to several tasks.

Defined results: null and empty texts have no shingles and are linked with nothing. Rows with a
null doc_id are reported and linked with nothing. Rows that repeat a doc_id are rows of their own
and share its links: what either text links to is one component. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.llm.arrowtext import SPACED, U64, chunks, windows, words
from melodyspark.llm.components import components
from melodyspark.llm.scratch import big_keys, materialize, same_row, spread_join

#: similarity as a fraction of whole numbers: 100 * intersection >= 80 * union
NUM, DEN = 80, 100


@dataclass
class Order:
    """Frequent shingles as sorted 40-bit hash prefixes, with their ranks from the least frequent on."""

    prefixes: np.ndarray
    rank: np.ndarray

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Numbers in the global order, different for different hashes but for the lowest bit."""
        out = h >> U64(1)
        if len(self.prefixes):
            maybe = np.flatnonzero(self._filter[(h >> U64(40)).astype(np.int64)])
            own = h[maybe] >> U64(24)
            at = np.minimum(np.searchsorted(self.prefixes, own), len(self.prefixes) - 1)
            found = self.prefixes[at] == own
            low = h[maybe[found]] & U64(0xFFFFFF)
            out[maybe[found]] = (U64(1) << U64(63)) + (self.rank[at[found]] << U64(24)) + low
        return out

    def ready(self) -> Order:
        self._filter = np.zeros(1 << 24, bool)
        self._filter[(self.prefixes >> U64(16)).astype(np.int64)] = True
        return self


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles in the global order, and the rows' ranges."""
    w = words(data, at, SPACED, lower=True)
    count = np.diff(w.first)
    begin, h = windows(w, size)
    row = w.row[begin]
    for k in range(1, size):
        if (count == k).any():
            b, x = windows(w, k)
            r = w.row[b]
            own = count[r] == k
            h, row = np.concatenate([h, x[own]]), np.concatenate([row, r[own]])
    key = order.keys(h)
    by = np.lexsort((key, row))
    key, row, h = key[by], row[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(at)))


def _pack(low: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte by byte, compressed."""
    step = np.diff(low, prepend=low[:1] * 0).astype(np.uint32)
    return zlib.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint64)


def frequent_shingles(texts: DataFrame, size: int, max_frequent: int, least: int = 16, block: int = 1_500_000) -> Order:
    """The shingles that most different sets hold, at most ``max_frequent`` of them, from ``least`` sets on.

    Every shingle of every set is counted, by a 40-bit prefix of its hash. Tasks count their shingles, some
    ``block`` at a time, and pass values and counts on in ranges of hashes, packed to a few bytes each, so a
    shingle of very many sets sends one count a block; a range is summed at a time. The number of ranges
    follows the number of rows up to 2**20.
    """
    none = Order(np.empty(0, U64), np.empty(0, U64))
    bits = min(20, max(8, int(texts.count() // 2000).bit_length()))
    width = U64(40 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate([np.empty(0, U64), *parts]) >> U64(24), return_counts=True)
            parts.clear()
            cut = np.searchsorted(t, np.arange((1 << bits) + 1, dtype=U64) << width)
            full = np.flatnonzero(np.diff(cut))
            packed = [_pack(t[cut[r] : cut[r + 1]] - (U64(r) << width)) for r in full]
            counts = [zlib.compress(n[cut[r] : cut[r + 1]].astype(np.uint32).tobytes(), 1) for r in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], names=["range", "packed", "counts"])

        for b in batches:
            for lo, hi, data, at in chunks(b.column(0)):
                h, first = shingle_sets(data, at, size, none)
                total = np.concatenate([np.zeros(1, U64), np.cumsum(h)])
                fresh = np.zeros(hi - lo, bool)
                if len(seen) > 1_000_000:
                    # equal sets are told apart only in stretches of rows: frequencies decide nothing but the order
                    seen.clear()
                for r, x in enumerate((total[first[1:]] - total[first[:-1]]).tolist()):
                    fresh[r] = x not in seen
                    seen.add(x)
                parts.append(h[np.repeat(fresh, np.diff(first))])
                if sum(map(len, parts)) > block:
                    yield flush()
        yield flush()

    def count(table: pa.Table) -> pa.Table:
        r = U64(table["range"][0].as_py())
        t, where = np.unique(np.concatenate([_unpack(x) for x in table["packed"].to_pylist()]), return_inverse=True)
        df = np.bincount(where, np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32) for x in table["counts"].to_pylist()]), len(t))
        often = df >= least
        return pa.table([pa.array(((r << width) + t[often]).view(np.int64)), pa.array(df[often].astype(np.int64))], names=["prefix", "df"])

    local = texts.select("text").mapInArrow(run, "range long, packed binary, counts binary")
    table = materialize(local.groupBy("range").applyInArrow(count, "prefix long, df long"), "frequent")
    powers = table.groupBy(F.floor(F.log2("df")).alias("p")).count().orderBy(F.desc("p")).collect()
    cut, total = None, 0
    for r in powers:
        total += r["count"]
        if total > max_frequent:
            break
        cut = r["p"]
    if cut is None:
        return none
    rows = table.where(F.col("df") >= F.lit(2.0 ** int(cut))).toArrow()
    prefix, df = rows["prefix"].to_numpy().view(U64), rows["df"].to_numpy()
    rank = np.empty(len(prefix), U64)
    rank[np.lexsort((prefix, df))] = np.arange(len(prefix), dtype=U64)
    by = np.argsort(prefix)
    return Order(prefix[by], rank[by])


def signatures(texts: DataFrame, size: int, order: Order) -> DataFrame:
    """doc_id, k (hash of id and text), n, digest of the set, prefix (hashes in the global order)."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value.ready()
        for b in batches:
            for lo, hi, data, at in chunks(b.column(2)):
                h, first = shingle_sets(data, at, size, order)
                n = np.diff(first)
                keep = np.where(n > 0, n - -(-n * NUM // DEN) + 1, 0)
                offsets = np.concatenate([[0], np.cumsum(keep)])
                take = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], keep)
                ends = first.tolist()
                raw = h.tobytes()
                digest = [hashlib.blake2b(raw[8 * i : 8 * j], digest_size=16).digest() if j > i else None for i, j in zip(ends[:-1], ends[1:], strict=True)]
                prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[:2]], pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), prefix], names=["doc_id", "k", "n", "digest", "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "k", "text").mapInArrow(run, f"doc_id {kind}, k long, n long, digest binary, prefix array<long>")


def _near(n1: F.Column, i: F.Column, n2: F.Column, j: F.Column) -> F.Column:
    """Sets of these sizes that first meet at these places can still be similar enough."""
    need = F.ceil(NUM * (n1 + n2) / F.lit(NUM + DEN))
    return (DEN * F.least(n1, n2) >= NUM * F.greatest(n1, n2)) & (F.least(n1 - i, n2 - j) >= need)


def _with_text(pairs: DataFrame, packed: DataFrame, side: str, other: str, most: int, max_broadcast: int) -> DataFrame:
    """``pairs`` with the packed text of one side; texts of more than ``most`` pairs are copied to several tasks."""
    big = big_keys(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("pairs")), side, "pairs", most)
    table = packed.select(F.col("cid").alias(side), F.col("packed").alias(f"t{side}"))
    return spread_join(pairs, table, side, big, F.col(other), max_broadcast)


def verify(texts: DataFrame, pairs: DataFrame, size: int, max_broadcast: int = 1_000_000, most: int = 100) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, judged on the whole texts."""
    ids = materialize(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), "pair-ids")
    wanted = F.broadcast(ids) if ids.count() <= max_broadcast else ids
    none = Order(np.empty(0, U64), np.empty(0, U64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [None if x is None else zlib.compress(x.encode(), 1) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["cid", "packed"])

    named = texts.select(F.col("k").alias("cid"), "text")
    chosen = named.join(wanted, "cid", "left_semi").mapInArrow(pack, "cid long, packed binary").dropDuplicates(["cid"])
    chosen = materialize(chosen, "pair-texts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = b.column(2).to_pylist(), b.column(3).to_pylist()
            good: list[np.ndarray] = [np.empty(0, np.int64)]
            lo, n = 0, b.num_rows
            while lo < n:
                both, weight, hi = [], 0, lo
                while hi < n and (hi == lo or weight < 2 << 20):
                    own = [zlib.decompress(s[hi]) for s in sides]
                    both += own
                    weight += len(own[0]) + len(own[1])
                    hi += 1
                at = np.concatenate([[0], np.cumsum([len(x) for x in both])])
                h, first = shingle_sets(np.frombuffer(b"".join(both), np.uint8), at, size, none)
                sizes = np.diff(first)
                pair = np.repeat(np.arange(len(both)) // 2, sizes)
                by = np.lexsort((h, pair))
                h, pair = h[by], pair[by]
                twice = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][twice], minlength=hi - lo)
                union = sizes[0::2] + sizes[1::2] - common
                good.append(lo + np.flatnonzero((DEN * common >= NUM * union) & (union > 0)))
                lo = hi
            yield pa.RecordBatch.from_arrays([c.take(pa.array(np.concatenate(good))) for c in b.columns[:2]], names=["a", "b"])

    full = _with_text(_with_text(pairs.select("a", "b"), chosen, "b", "a", most, max_broadcast), chosen, "a", "b", most, max_broadcast)
    return full.select("a", "b", "ta", "tb").mapInArrow(judge, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("cid"))
    return rows.join(labels.select(F.col("node").alias("cid"), F.col("label").alias("_l")), "cid", "left").withColumn("label", F.coalesce("_l", "cid")).drop("_l")


def _repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of rows that share a doc_id, None if there are none."""
    kinds = rows.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    kinds = materialize(kinds, "repeated-ids")
    if kinds.isEmpty():
        return None
    theirs = rows.join(kinds, "doc_id", "left_semi").select("doc_id", "n", "digest").distinct().join(classes, ["n", "digest"])
    first = theirs.groupBy("doc_id").agg(F.min("cid").alias("a"))
    return materialize(theirs.join(first, "doc_id").where(F.col("cid") != F.col("a")).select("a", F.col("cid").alias("b")).distinct(), "repeated-links")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, max_frequent: int = 1_000_000, hub_rounds: int = 2) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links reach), class_id (digest of the set)."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), same_row(F.col(id_col), text)[0].alias("k"), text.alias("text"))
    order = frequent_shingles(texts, size, max_frequent)
    sig = materialize(signatures(texts, size, order), "signatures")
    usable = sig.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    full = usable.groupBy("n", "digest").agg(F.min(F.struct("doc_id", "k")).alias("rep"), F.first("prefix").alias("prefix"))
    full = full.select("n", "digest", F.col("rep.k").alias("cid"), F.col("rep.doc_id").alias("low"), "prefix")
    classes = materialize(full.select("cid", "low", "n", "digest", F.xxhash64("prefix").alias("ph")), "classes")
    groups = classes.groupBy("n", "ph").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("size"))
    members = materialize(classes.join(groups, ["n", "ph"]).select("gid", "cid", "n", "ph"), "members")
    followers = members.where(F.col("cid") != F.col("gid"))
    few = followers.select("cid")
    few = F.broadcast(few) if few.count() <= 1_000_000 else few
    postings = full.join(few, "cid", "left_anti").select("n", F.col("cid").alias("gid"), F.posexplode("prefix").alias("pos", "token"))
    shared = materialize(postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "shared")
    common = big_keys(shared, "token", "c")
    met = spread_join(postings, shared.select("token"), "token", common, F.col("gid")).select("token", "gid", "n", "pos")
    # parts of one group meet under the group's own prefix
    inside = followers.select(F.col("ph").alias("token"), "gid", "n", F.lit(0).alias("pos")).distinct()
    places = materialize(met.unionByName(inside), "places")

    links = _repeated_ids(usable, classes)
    labels = None if links is None else components(links)
    done: DataFrame | None = None
    # members by the part they belong to, known by its first member: at first a group is one part
    parts = members.select("gid", F.col("gid").alias("part"), "cid")
    for step in range(hub_rounds + 1):
        if step:
            parts = _labelled(members.select("gid", "cid"), labels).withColumn("part", F.min("cid").over(Window.partitionBy("gid", "label")))
            parts = materialize(parts, "parts")
            heads = parts.where(F.col("cid") == F.col("part")).select("gid", "part", "label")
            here = places.join(heads, "gid")
            open_tokens = here.groupBy("token").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("c")).where(F.col("l1") != F.col("l2")).select("token", "c")
            open_tokens = materialize(open_tokens, "open-tokens")
            common = big_keys(open_tokens, "token", "c")
            here = materialize(spread_join(here, open_tokens.select("token"), "token", common, F.col("part")), "open")
        else:
            here = places.select("token", "gid", F.col("gid").alias("part"), "n", "pos", F.col("gid").alias("label"))
        side = lambda df, x: df.select("token", *[F.col(c).alias(x + c) for c in ("part", "n", "pos", "label")])
        if step < hub_rounds:
            # the part whose shingle stands first; in later rounds another one, not of the first hub's component
            rank = F.struct((F.col("pos") if step == 0 else F.xxhash64("part", F.lit(step))).alias("rank"), F.col("part"), F.col("n"), F.col("pos"), F.col("label"))
            other = here.groupBy("token").agg(F.min(rank).alias("h")).select("token", *[F.col(f"h.{c}").alias(f"h{c}") for c in ("part", "n", "pos", "label")])
            mine = side(here, "m")
        else:
            main = here.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("m")).select("token", F.col("m.label").alias("main"))
            other = side(spread_join(here, main, "token", common, F.col("part")).where(F.col("label") != F.col("main")), "h")
            mine = side(here, "m")
        near = (F.col("mlabel") != F.col("hlabel")) & _near(F.col("mn"), F.col("mpos"), F.col("hn"), F.col("hpos"))
        met_parts = spread_join(mine, other, "token", common, F.col("mpart")).where(near).select("mpart", "hpart").distinct()
        pairs = met_parts.join(parts.select(F.col("part").alias("mpart"), F.col("cid").alias("x")), "mpart")
        if step < hub_rounds:
            pairs = pairs.select("x", F.col("hpart").alias("y"))
        else:
            pairs = pairs.join(parts.select(F.col("part").alias("hpart"), F.col("cid").alias("y")), "hpart").select("x", "y")
        if step == 0:
            pairs = pairs.unionByName(followers.select(F.col("cid").alias("x"), F.col("gid").alias("y")))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        done = pairs if done is None else done.unionByName(pairs)
        fresh = materialize(verify(texts, pairs, size), "verified")
        links = fresh if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(fresh)
        labels = components(links)
    known = _labelled(classes.select("cid", "low", "n", "digest"), labels)
    lowest = known.groupBy("label").agg(F.min("low").alias("component"))
    out = sig.select("doc_id", "n", "digest").join(known.join(lowest, "label").select("n", "digest", "component"), ["n", "digest"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, F.lower(F.hex("digest")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000, **params: int) -> DataFrame:
    """One row of each component of ``docs``, the one of the smallest doc_id; all columns.

    Rows without shingles and rows with a null doc_id stay, and so do rows that repeat the doc_id that
    stays. Ids that go are broadcast up to ``max_broadcast`` of them and shuffled beyond.
    """
    found = near_duplicate_components(docs, id_col, text_col, **params)
    gone = materialize(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    few = gone.count() <= max_broadcast
    return docs.join(F.broadcast(gone) if few else gone, docs[f"`{id_col}`"] == gone["_gone"], "left_anti")
