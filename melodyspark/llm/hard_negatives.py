"""Hard negatives by ball trees: exact integer inner products, bounded above and below.

Rows are dealt to partitions of about ``part_rows`` rows, and each builds one ball tree, split by
label first and then by distance. Of a node with centre c and radius r, the inner product with an
anchor q lies in q.c - |q| r .. q.c + |q| r. Searching, a node is passed over when it holds no row
of a wanted label, when its bounds lie outside the score window, or when its upper bound lies
strictly beneath the k-th score found so far. Anchors go in packed blocks to every partition, so
what is shuffled is blocks, and what comes back is at most k rows a query and partition.

A first search finds the positives of each anchor (its best rows of the same label), a second the
negatives: rows of other labels whose score lies in a window given by the positive's.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part, nor do those with a component whose floor is not under 2**23 in size (products then fit 64
bits). Vectors of different lengths have no product: rows meet anchors of their own length only.
A row without vec_id is no anchor and comes last among equal scores. Rows that repeat a vec_id are
rows of their own, as anchors, positives and negatives. An empty table gives an empty result.
Extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.llm.scratch import materialize

LEAF = 32
#: products are exact in doubles up to here
EXACT = 2.0**52
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def quantized(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """row (a number of the row), vec_id, label, v (floor of ``scale`` times each component) of the rows that take part."""
    x = F.col(f"`{vector_col}`")
    cell = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    small = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(scale)) * c.cast("double")) < float(1 << 23))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", small))
    return rows.select("row", "vec_id", "label", F.transform("x", lambda c: cell(c).cast("int")).alias("v"))


def _matrix(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components in a row and the length of each vector."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.diff(col.offsets.to_numpy()) if len(col) else np.empty(0, np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), lengths


def _pack(arrays: list[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


class BallTree:
    """Rows in leaf order, and nodes as arrays: children follow their parent in order of depth."""

    #: name and kind of the stored arrays
    FIELDS = (("points", np.int32), ("ids", np.int64), ("rows", np.int64), ("labels", np.int64), ("lo", np.int32), ("hi", np.int32), ("child", np.int32), ("centre", np.float64), ("radius", np.float64), ("low_label", np.int64), ("high_label", np.int64))

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> BallTree:
        """Split by label until a node holds one label, then between two far points at the median; leaves hold at most ``LEAF`` rows."""
        out = cls()
        order = np.argsort(labels, kind="stable")
        lo, hi, child, centre, radius = [0], [len(order)], [], [], []
        k = 0
        while k < len(lo):
            part = order[lo[k] : hi[k]]
            x = points[part].astype(np.float64)
            c = x.mean(axis=0)
            # a little more than the distance, so that rounding never cuts a row off
            gap = np.sqrt(((x - c) ** 2).sum(axis=1))
            centre.append(c)
            radius.append(float(gap.max()) * (1 + 1e-9) + 1e-6)
            child.append(-1)
            if len(part) > LEAF:
                own = labels[part]
                if own[0] != own[-1]:
                    # the change of label nearest to the middle
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    cut = int(cuts[np.argmin(np.abs(cuts - len(part) // 2))])
                else:
                    a = x[np.argmax(gap)]
                    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
                    cut = len(part) // 2
                    order[lo[k] : hi[k]] = part[np.argpartition(x @ (b - a), cut)]
                child[k] = len(lo)
                lo += [lo[k], lo[k] + cut]
                hi += [lo[k] + cut, hi[k]]
            k += 1
        out.points, out.ids, out.rows, out.labels = points[order], ids[order], rows[order], labels[order]
        out.lo, out.hi, out.child = np.array(lo, np.int32), np.array(hi, np.int32), np.array(child, np.int32)
        out.centre, out.radius = np.array(centre), np.array(radius)
        least = [(int(out.labels[a:b].min()), int(out.labels[a:b].max())) for a, b in zip(lo, hi, strict=True)]
        out.low_label, out.high_label = np.array([x[0] for x in least]), np.array([x[1] for x in least])
        return out

    @classmethod
    def unpack(cls, parts: list[bytes]) -> BallTree:
        out = cls()
        for (name, kind), raw in zip(cls.FIELDS, parts, strict=True):
            setattr(out, name, np.frombuffer(raw, kind))
        out.points = out.points.reshape(len(out.ids), len(out.points) // len(out.ids))
        out.centre = out.centre.reshape(len(out.lo), out.points.shape[1])
        return out

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows of each query: index of the query, place of the row, score.

        Rows of the same label as the query (other labels if not ``same``), but for row ``own``,
        with scores from ``low`` to ``high``; more than k where the k-th score is shared.
        """
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        qf = q.astype(np.float64)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        products = qf @ self.centre.T
        while len(who):
            mid = products[who, node]
            slack = norm[who] * self.radius[node] * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(mid)
            a, b, lab = self.low_label[node], self.high_label[node], label[who]
            fits = (a <= lab) & (lab <= b) if same else (a != b) | (a != lab)
            fits &= (mid + slack >= low[who]) & (mid - slack <= high[who])
            who, node, top = who[fits], node[fits], (mid + slack)[fits]
            leaf = self.child[node] < 0
            pairs.append((who[leaf], node[leaf], top[leaf]))
            who, node = who[~leaf], node[~leaf]
            who, node = np.concatenate([who, who]), np.concatenate([self.child[node], self.child[node] + 1]).astype(np.int64)
        who, node, top = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((-top, who))
        who, node, top = who[order], node[order], top[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kth = np.full(len(q), LOWEST, np.int64)
        best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        exact = self.points.shape[1] * (float(np.abs(self.points).max(initial=0)) + 1) * (float(np.abs(q).max(initial=0)) + 1) < EXACT
        points = self.points.astype(np.float64 if exact else np.int64)
        qx = qf if exact else q.astype(np.int64)
        # each query's leaves by falling upper bound, in rounds that double; the k-th score of one round prunes the next
        first, size = 0, 1
        while first < (int(rank.max()) + 1 if len(rank) else 0):
            now = (rank >= first) & (rank < first + size) & (top >= kth[who])
            w, n = who[now], node[now]
            by_leaf = np.argsort(n, kind="stable")
            w, n = w[by_leaf], n[by_leaf]
            found = [best]
            cuts = np.flatnonzero(np.diff(n, prepend=-1)) if len(n) else np.empty(0, np.int64)
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)], strict=True) if len(n) else ():
                lo, hi, rows = int(self.lo[n[i]]), int(self.hi[n[i]]), w[i:j]
                score = (qx[rows] @ points[lo:hi].T).astype(np.int64)
                hit = (score >= np.maximum(low[rows], kth[rows])[:, None]) & (score <= high[rows][:, None]) & (self.rows[lo:hi] != own[rows][:, None])
                hit &= (self.labels[lo:hi] == label[rows][:, None]) == same
                r, c = np.nonzero(hit)
                found.append((rows[r], lo + c, score[r, c]))
            best = self._top(tuple(np.concatenate(x) for x in zip(*found, strict=True)), k)
            # the k-th of each query that has k
            place = np.arange(len(best[0])) - np.searchsorted(best[0], best[0])
            full = place == k - 1
            kth[best[0][full]] = best[2][full]
            first, size = first + size, size * 2
        return best

    def _top(self, found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query: higher scores, then smaller ids, then smaller rows."""
        who, at, score = found
        order = np.lexsort((self.rows[at], self.ids[at], -score, who))
        who, at, score = who[order], at[order], score[order]
        stay = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[stay], at[stay], score[stay]


TREE = "part long, length int, tree array<binary>"
#: ids stand for missing ones at the end of the order
NO_ID = (1 << 63) - 1


def partitions(rows: DataFrame, part_rows: int, max_broadcast: int = 100_000) -> DataFrame:
    """length, parts: into how many partitions the vectors of each length go; to be broadcast if there are at most ``max_broadcast`` lengths."""
    sizes = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(sizes.select("length", F.ceil(F.col("n") / F.lit(part_rows)).alias("parts")), "lengths")
    return F.broadcast(parts) if parts.count() <= max_broadcast else parts


def ball_trees(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """part, length of its vectors, tree: one tree of each partition."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        flat, _ = _matrix(group.column("v"))
        ids = group.column("vec_id").fill_null(NO_ID).to_numpy()
        tree = BallTree.build(flat.reshape(len(ids), key[0].as_py()), ids, group.column("row").to_numpy(), group.column("label").to_numpy())
        packed = _pack([getattr(tree, name).astype(kind) for name, kind in BallTree.FIELDS])
        return pa.table({"part": [key[1].as_py()], "length": [key[0].as_py()], "tree": pa.array([packed], pa.list_(pa.binary()))}, schema=pa.schema([("part", pa.int64()), ("length", pa.int32()), ("tree", pa.list_(pa.binary()))]))

    dealt = rows.withColumn("length", F.size("v")).join(parts, "length").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    return dealt.select("row", "vec_id", "label", "v", "length", "part").groupBy("length", "part").applyInArrow(build, TREE)


FOUND = "anchor long, slot int, row long, vec_id long, score long"


def search(trees: DataFrame, parts: DataFrame, queries: DataFrame, k: int, same: bool, block: int = 2048) -> DataFrame:
    """The k best rows of every query: anchor, slot, rank, row, vec_id, score.

    ``queries``: anchor (its row), label, v, low and high (arrays of equal length: the windows of
    its slots). Anchors go in blocks of about ``block`` to all trees of their vectors' length.
    """
    total = queries.agg(F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-total // block))
    packed = queries.withColumn("length", F.size("v")).groupBy("length", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("anchor", "label", "v", "low", "high")).alias("qs"))
    copies = packed.join(parts, "length").select("length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "qs")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        tree = BallTree.unpack(left.column("tree")[0].as_py())
        out: list[list[np.ndarray]] = []
        for i in range(right.num_rows):
            qs = right.column("qs").slice(i, 1).combine_chunks().flatten()
            anchor, label = qs.field("anchor").to_numpy(), qs.field("label").to_numpy()
            flat, _ = _matrix(qs.field("v"))
            v = flat.reshape(len(anchor), key[0].as_py())
            low, slots = _matrix(qs.field("low"))
            high, _ = _matrix(qs.field("high"))
            of = np.repeat(np.arange(len(anchor)), slots)
            slot = np.arange(len(of)) - np.repeat(np.cumsum(slots) - slots, slots)
            who, at, score = tree.search(v[of], anchor[of], label[of], low, high, k, same)
            out.append([anchor[of[who]], slot[who].astype(np.int32), tree.rows[at], tree.ids[at], score])
        return pa.table(dict(zip(("anchor", "slot", "row", "vec_id", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    found = trees.groupBy("length", "part").cogroup(copies.groupBy("length", "part")).applyInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("vec_id", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")))


def hard_negatives(
    vectors: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, part_rows: int = 2048, block: int = 2048
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on vec_id. Of each anchor the ``positives`` best other rows of its
    label; for each of them the ``negatives`` best rows of other labels whose score s satisfies
    low * positive <= 100 * s <= high * positive.
    """
    rows = materialize(quantized(vectors, label, id_col, vector_col), "vectors")
    parts = partitions(rows, part_rows)
    trees = materialize(ball_trees(rows, parts), "trees")
    anchors = materialize(rows.where(is_anchor & F.col("vec_id").isNotNull()).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    whole = anchors.select("anchor", "label", "v", F.array(F.lit(LOWEST)).alias("low"), F.array(F.lit(HIGHEST)).alias("high"))
    good = materialize(search(trees, parts, whole, positives, True, block).select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = good.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("ps"))
    share = lambda p, percent: percent * p["positive_score"].cast("decimal(20,0)") / F.lit(100)
    # the least s with 100 s >= low p, and the greatest with 100 s <= high p
    least = F.transform("ps", lambda p: F.ceil(share(p, low)).cast("long")).alias("low")
    most = F.transform("ps", lambda p: F.floor(share(p, high)).cast("long")).alias("high")
    bounds = windows.select("anchor", least, most)
    bad = search(trees, parts, anchors.join(bounds, "anchor").select("anchor", "label", "v", "low", "high"), negatives, False, block)
    out = bad.select("anchor", (F.col("slot") + 1).alias("place"), F.col("rank").alias("negative_rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(good, (out["anchor"] == good["anchor"]) & (out["place"] == good["rank"])).drop(good["anchor"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("negative_rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
