"""Ranked lexical search by variable block maxima.

Texts are cut into terms (runs of ASCII letters, digits and characters beyond ASCII, A-Z
lower-cased). One pass counts the terms that queries use in every whole text; exact corpus figures
give integer scores. Documents are dealt to shards of about ``shard_docs``. In a shard each term's
postings, in order of doc_id, are cut into blocks of varying length: dynamic programming over runs
of ``run`` postings minimises the error of the block bounds (block maximum less score, summed) plus
a fixed cost per block, for blocks of up to ``widest`` runs. Searching, the block ends of a query's
terms cut the shard into stretches whose bound is the sum of the maxima of the blocks that reach in.
This is the pivot test of WAND made for a whole stretch at once: stretches are taken by falling
bound, those whose bound lies beneath the k-th score are skipped with the blocks that lie only in
them, and documents of the others are scored exactly. Each shard gives at most k rows a query.

Queries travel by broadcast in blocks of at most ``max_bytes``, which are measured first; each
block is one pass, written before the next begins.

Defined results: null and empty texts have no terms, are no documents of the corpus figures and are
never found; queries without terms find nothing. Equal scores go by ascending doc_id, rows without
one last. Rows that repeat a doc_id are rows of their own; so are queries that repeat an id. An
empty table gives an empty result. Extra columns are never read. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.llm.arrowtext import ALNUM, chunks, words
from melodyspark.llm.scratch import materialize


def term_counts(texts: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """row, id, n (terms with repeats), terms (hashes, or places in the sorted hashes ``known``), times: of every text with terms.

    ``texts`` has columns row, id and text. With ``known`` only terms among them are listed; n counts all.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known) if known is not None else None
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else None
        for b in batches:
            for lo, hi, data, at in chunks(b.column(2)):
                w = words(data, at, ALNUM, lower=True)
                row, term = w.row, w.hash
                if wanted is not None:
                    place = np.minimum(np.searchsorted(wanted, term), max(len(wanted) - 1, 0))
                    good = wanted[place] == term if len(wanted) else np.zeros(len(term), bool)
                    row, term = row[good], place[good].astype(np.uint64)
                order = np.lexsort((term, row))
                row, term = row[order], term[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(term) != 0)])) if len(row) else np.empty(0, np.int64)
                times = np.diff(np.append(first, len(row)))
                n = np.diff(w.first)
                offsets = np.searchsorted(row[first], np.arange(hi - lo + 1)).astype(np.int32)
                lists = lambda x, at=offsets: pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int64)))
                part = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), lists(term[first].view(np.int64)), lists(times)]
                yield pa.RecordBatch.from_arrays(part, names=["row", "id", "n", "terms", "times"])

    counted = texts.select("row", "id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"row long, id {kind}, n long, terms array<long>, times array<long>")
    return counted.where(F.col("n") > 0)


def choose_blocks(first: np.ndarray, score: np.ndarray, run: int = 4, widest: int = 64, cost: float = 8.0) -> np.ndarray:
    """Ends (places in ``score``) of the blocks of all lists; list i is score[first[i]:first[i + 1]] and no list is empty.

    For each list the cut of least sum of (block maximum * length - sum of scores) + ``cost`` * list maximum a block,
    where blocks begin at multiples of ``run`` and take at most ``widest`` runs. All lists advance together.
    """
    size = np.diff(first)
    runs = -(-size // run)
    base = np.concatenate([[0], np.cumsum(runs)])
    of = np.repeat(np.arange(len(size)), runs)
    start = first[of] + (np.arange(base[-1]) - base[of]) * run
    top = np.maximum.reduceat(score, start).astype(np.float64)
    upto = np.concatenate([[0], np.cumsum(score)]).astype(np.float64)
    stop = np.minimum(start + run, first[of + 1])
    price = cost * np.maximum.reduceat(score, first[:-1])
    order = np.argsort(-runs, kind="stable")
    # least[base[i] + i + t]: of the first t runs of list i; back: runs of the block that ends there
    least = np.zeros(base[-1] + len(size))
    back = np.zeros(base[-1], np.int64)
    live = np.searchsorted(-runs[order], -np.arange(1, int(runs.max(initial=0)) + 1), "right")
    for t in range(1, len(live) + 1):
        i = order[: live[t - 1]]
        j = base[i][:, None] + (t - 1 - np.arange(min(t, widest)))
        end = stop[base[i] + t - 1]
        error = np.maximum.accumulate(top[j], axis=1) * (end[:, None] - start[j]) - (upto[end][:, None] - upto[start[j]])
        total = least[j + i[:, None]] + error + price[i][:, None]
        best = np.argmin(total, axis=1)
        least[base[i] + i + t] = total[np.arange(len(i)), best]
        back[base[i] + t - 1] = best + 1
    # walk all lists back from their last run
    at, ends = base[1:].copy(), []
    left = at > base[:-1]
    while left.any():
        ends.append(stop[at[left] - 1])
        at[left] -= back[at[left] - 1]
        left = at > base[:-1]
    return np.sort(np.concatenate(ends)) if ends else np.empty(0, np.int64)


@dataclass
class Shard:
    """Postings of a shard: ``terms`` sorted, list i at first[i]:first[i + 1] of docs and scores, blocks block_first[i]:block_first[i + 1]."""

    terms: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    scores: np.ndarray
    block_first: np.ndarray
    block_end: np.ndarray
    block_max: np.ndarray

    KINDS = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int64, np.int64)

    @classmethod
    def build(cls, terms: np.ndarray, docs: np.ndarray, scores: np.ndarray, **how: float) -> Shard:
        """From postings of documents numbered in order."""
        order = np.lexsort((docs, terms))
        terms, docs, scores = terms[order], docs[order], scores[order]
        names, first = np.unique(terms, return_index=True)
        first = np.append(first, len(terms))
        ends = choose_blocks(first, scores, **how)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        most = np.maximum.reduceat(scores, starts) if len(ends) else ends
        return cls(names, first, docs.astype(np.int32), scores, np.searchsorted(starts, first), ends, most)

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f)).astype(k).tobytes() for f, k in zip(self.__dataclass_fields__, self.KINDS, strict=True)]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> Shard:
        return cls(*[np.frombuffer(raw, k) for raw, k in zip(parts, cls.KINDS, strict=True)])

    def search(self, terms: np.ndarray, times: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents with a score above 0; equal scores by number."""
        place = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        have = self.terms[place] == terms if len(self.terms) else np.zeros(len(terms), bool)
        lists = list(zip(place[have].tolist(), times[have].tolist(), strict=True))
        best = np.empty(0, np.int64), np.empty(0, np.int64)
        if not lists:
            return best
        blocks = [slice(int(self.block_first[i]), int(self.block_first[i + 1])) for i, _ in lists]
        last = [self.docs[self.block_end[s] - 1] for s in blocks]
        cuts = np.unique(np.concatenate(last))
        bound = np.zeros(len(cuts), np.int64)
        for (_, n), s, ends in zip(lists, blocks, last, strict=True):
            # the block that reaches into a stretch is the first that does not end before it
            into = np.searchsorted(ends, cuts)
            bound += n * np.append(self.block_max[s], 0)[into]
        order = np.argsort(-bound, kind="stable")
        lowest, done, size = 1, 0, 16
        while done < len(order):
            now = order[done : done + size]
            now = now[bound[now] >= lowest]
            if not len(now):
                break
            live = np.zeros(n_docs + 1, np.int8)
            np.add.at(live, np.where(now > 0, cuts[now - 1] + 1, 0), 1)
            np.add.at(live, cuts[now] + 1, -1)
            live = np.cumsum(live)[:n_docs] > 0
            upto = np.concatenate([[0], np.cumsum(live)])
            score = np.zeros(n_docs, np.int64)
            for (_, n), s in zip(lists, blocks, strict=True):
                ends = self.block_end[s]
                starts = np.concatenate([self.first[np.searchsorted(self.first, ends[:1], "left") - 1], ends[:-1]])
                reach = upto[self.docs[ends - 1] + 1] > upto[self.docs[starts]]
                lo, length = starts[reach], (ends - starts)[reach]
                at = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
                score[self.docs[at]] += n * self.scores[at]
            found = np.flatnonzero(live & (score >= lowest))
            both = np.concatenate([best[0], found]), np.concatenate([best[1], score[found]])
            keep = np.lexsort((both[0], -both[1]))[:k]
            best = both[0][keep], both[1][keep]
            if len(keep) == k:
                lowest = max(1, int(best[1][-1]))
            done, size = done + size, size * 2
        return best


def _search_block(docs: DataFrame, queries: list, shard_docs: int, k: int, how: dict[str, float]) -> DataFrame:
    """item, doc_id, row, score: the best of every shard for each query of one block."""
    spark = docs.sparkSession
    known = np.unique(np.array([t for q in queries for t in q["terms"]], np.int64).view(np.uint64))
    counts = materialize(term_counts(docs, known), "term-counts")
    figures = counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = int(figures["docs"]), max(1, int(figures["terms"]))
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weigh = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = np.zeros(len(known), np.int64)
    for r in df.select("term", weigh.alias("w")).toLocalIterator():
        weights[r["term"]] = r["w"]
    shards = max(1, -(-n_docs // shard_docs))
    kind = docs.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(weights)

    def index(group: pa.Table) -> pa.Table:
        w = shared.value
        group = group.take(pc.sort_indices(group, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end")).combine_chunks()
        n = group.column("n").to_numpy()
        lists, times = group.column("terms").combine_chunks(), group.column("times").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        term, tf = lists.flatten().to_numpy(), times.flatten().to_numpy()
        number = np.repeat(np.arange(len(n)), sizes)
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        score = w[term] * ((1000000000 * tf) // (1000 * tf + 8 * m[number]))
        shard = Shard.build(term, number, score, **how)
        return pa.table({"ids": pa.array([group.column("id").to_pylist()], pa.list_(group.schema.field("id").type)), "rows": pa.array([group.column("row").to_pylist()], pa.list_(pa.int64())), "shard": pa.array([shard.packed()], pa.list_(pa.binary()))})

    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    built = materialize(dealt.groupBy("shard").applyInArrow(index, f"ids array<{kind}>, rows array<long>, shard array<binary>"), "shards")
    asked = spark.sparkContext.broadcast([(q["row"], np.searchsorted(known, np.array(q["terms"], np.int64).view(np.uint64)), np.array(q["times"], np.int64)) for q in queries])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, rows = b.column(0).slice(r, 1).flatten(), b.column(1).slice(r, 1).flatten()
                shard = Shard.unpack(b.column(2)[r].as_py())
                if not asked.value:
                    continue
                got = [(item, *shard.search(terms, times, len(rows), k)) for item, terms, times in asked.value]
                number = pa.array(np.concatenate([x[1] for x in got]))
                item = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids.take(number), rows.take(number), pa.array(np.concatenate([x[2] for x in got]))], names=["item", "doc_id", "row", "score"])

    return built.mapInArrow(find, f"item long, doc_id {kind}, row long, score long")


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_docs: int = 8192, max_bytes: int = 32 << 20, run: int = 4, widest: int = 64, cost: float = 8.0
) -> DataFrame:
    """item_id, rank (from 1, unique), doc_id, score: the ``k`` best documents of every query with a score above 0."""
    spark = docs.sparkSession
    numbered = lambda df, i, t: df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{i}`").alias("id"), F.col(f"`{t}`").alias("text"))
    items = materialize(term_counts(numbered(queries, item_col, item_text_col)), "queries")
    weight = items.agg(F.coalesce(F.sum(64 + 48 * F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(weight) // max_bytes))
    texts = numbered(docs, id_col, text_col)
    how = {"run": run, "widest": widest, "cost": cost}
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms", "times").collect()
        part = materialize(_search_block(texts, block, shard_docs, k, how), "found")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = items.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
