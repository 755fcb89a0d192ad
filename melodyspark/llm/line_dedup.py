"""Line deduplication by pairwise alignment.

The result is that of aligning all pairs of documents. Documents with the same lines are told first: the
earliest of them stands for all, the others lose every line to it if they have ``min_chars`` characters, and delete nothing that it does not. Lines with their neighbours up to
``min_chars`` characters are keys. Each key that several documents hold pairs every later holder
with the earliest one; where a later holder keeps the line, it is paired with the key's next
holders, as many a round as the first round had pairs for, until no kept line has an earlier holder it was not aligned
with. Small sides of these rounds are broadcast, so that a round is a few shuffles. So pairs grow with the lines that repeat, and only lines that no alignment deletes meet all
their holders. The lines of both documents are aligned by patience diff: lines that occur once in
each, in increasing order, anchor the alignment, which grows from the anchors and recurses between
them. Blocks of aligned lines with at least ``min_chars`` characters are deleted from the later
document. Documents are compared as they came in, not as other pairs leave them.

Documents are ordered by doc_id. Lines are compared without ASCII white space at their ends, by
64-bit hash and length.

Defined results: null and empty texts have one empty line, which is never deleted. Null doc_ids
are earliest. Rows that repeat doc_id and text are treated alike, not deleted for each other. Rows
that share a doc_id but not a text are ordered by a hash of the text. Extra columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melodyspark.llm.scratch import big_keys, materialize, same_row, spread_join

#: the fewest and the most holders of a key that a later round aligns kept lines with; Spark limits such windows before the shuffle up to 1000 rows
FIRST_HUBS, MOST_HUBS = 4, 512
#: parts that a key's holders are dealt into before the earliest of all are taken
PARTS = 16
#: rows of keys, pairs or lines that are broadcast in a round, and lines of documents; larger sides are shuffled
FEW, FEW_LINES = 100_000, 500_000


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned equal lines by patience diff, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        ca, cb = Counter(a[i:i2]), Counter(b[j:j2])
        where = {x: k for k, x in enumerate(b[j:j2], j) if cb[x] == 1}
        pairs = [(k, where[x]) for k, x in enumerate(a[i:i2], i) if ca[x] == 1 and x in where]
        tails: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for n, (_, q) in enumerate(pairs):
            at = bisect_left(tails, q)
            tails[at : at + 1] = [q]
            last[at : at + 1] = [n]
            back.append(last[at - 1] if at else -1)
        n = last[-1] if last else -1
        anchors = []
        while n >= 0:
            anchors.append(pairs[n])
            n = back[n]
        anchors.reverse()
        p, q = i, j
        for x, y in anchors:
            todo.append((p, x, q, y))
            p, q = x, y
        if anchors:
            # an anchor starts the piece behind it, which grows it forwards; the piece before grows back to it
            todo.append((p, i2, q, j2))
    return sorted(set(out))


def common_blocks(a: list, b: list, chars: list[int], min_chars: int) -> list[tuple[int, int]]:
    """Ranges of lines of ``b`` that align with ``a`` as blocks of at least ``min_chars`` characters."""
    out = []
    run: list[tuple[int, int]] = []
    for x, y in [*aligned(a, b), (-2, -2)]:
        if run and (x, y) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(chars[j] for _, j in run) >= min_chars:
                out.append((run[0][1], run[-1][1] + 1))
            run = []
        run.append((x, y))
    return out


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _around(chars: np.ndarray, real: np.ndarray, lo: int, i: int, hi: int, least: int) -> list[tuple[int, int]]:
    """Smallest ranges of the lines lo .. hi - 1 that hold line i and ``least`` characters, ends included.

    ``real`` has the numbers of all lines that are not empty; only those, and i, begin or end a range.
    """
    below, above = bisect_left(real, i), bisect_right(real, i)
    right, total = [i], int(chars[i])
    for y in real[above : above + least]:
        if y >= hi or total >= least:
            break
        right.append(int(y))
        total += int(chars[y])
    out, x, own = [(i, right[-1])] if total >= least else [], i, int(chars[i])
    while own < least and below > 0 and real[below - 1] >= lo:
        below -= 1
        x = int(real[below])
        own, total, grown = own + int(chars[x]), total + int(chars[x]), not out
        while len(right) > 1 and total - int(chars[right[-1]]) >= least:
            total -= int(chars[right.pop()])
            grown = True
        if grown and total >= least:
            out.append((x, right[-1]))
    return out


def _spots(table: DataFrame, least: int) -> DataFrame:
    """at, h, j, once: line j of document ``at`` is in a smallest range of ``least`` characters with key h; ``once`` marks one line a document and key.

    A block of that size around a line holds such a range, so documents that share no key of a line
    never delete it. Keys only choose pairs: a clash costs an alignment and changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin = b.column(1).offsets.to_numpy()
            begin = begin - begin[0]
            h, chars = (b.column(k).flatten().to_numpy() for k in (1, 2))
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            whole = np.flatnonzero(chars >= least)
            real = np.flatnonzero(chars > 0)
            parts = [(i, x, y) for i in np.flatnonzero(chars < least).tolist() for x, y in _around(chars, real, begin[row[i]], i, begin[row[i] + 1], least)]
            j, x, y = np.array(parts, np.int64).reshape(-1, 3).T
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64), dtype=np.uint64)])
            key = (sums[y + 1] - sums[x] + (y - x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            j, key = np.concatenate([whole, j]), np.concatenate([h[whole], key])
            by = np.lexsort((key, row[j]))
            new = np.ones(len(j), bool)
            new[1:] = (np.diff(key[by]) != 0) | (np.diff(row[j[by]]) != 0)
            once = np.zeros(len(j), bool)
            once[by[new]] = True
            for k in range(0, len(j), 50_000):
                at = row[j[k : k + 50_000]]
                own = [pa.array(key[k : k + 50_000]), pa.array((j[k : k + 50_000] - begin[at]).astype(np.int32)), pa.array(once[k : k + 50_000])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *own], names=["at", "h", "j", "once"])

    rows = table.select(F.struct("doc_id", "rk").alias("at"), "hashes", "chars")
    return rows.mapInArrow(run, T.StructType([rows.schema["at"], T.StructField("h", T.LongType()), T.StructField("j", T.IntegerType()), T.StructField("once", T.BooleanType())]))


def _few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """``rows``, a written table or of at most ``n`` rows, to be broadcast if they are few."""
    return F.broadcast(rows) if (rows.count() if n is None else n) <= FEW else rows


def _aligned_away(pairs: DataFrame, table: DataFrame, min_chars: int) -> DataFrame:
    """rk, j: the lines that documents b lose to documents a of ``pairs`` (a, b)."""
    left = table.select(F.col("rk").alias("a"), F.col("hashes").alias("ha"))
    right = table.select(F.col("rk").alias("b"), F.col("hashes").alias("hb"), F.col("chars").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = zip(x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)
            gone = [[j for s, e in common_blocks(a, b, c, min_chars) for j in range(s, e)] for a, b, c in rows]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["rk", "removed"])

    if pairs.count() <= FEW:
        # documents stay where they are
        pairs = F.broadcast(pairs)
        left = left.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
        if (left.agg(F.sum(F.size("ha"))).first()[0] or 0) <= FEW_LINES:
            left = F.broadcast(left)
    both = right.join(pairs, "b").join(left, "a").select("b", "ha", "hb", "cb")
    gone = both.mapInArrow(run, "rk long, removed array<int>").where(F.size("removed") > 0)
    return gone.select("rk", F.explode("removed").alias("j")).distinct()


def _first(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` earliest rows of each group, numbered from 1 in column n."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("at"))
    return rows.withColumn("n", nth).where(F.col("n") <= n)


def removed_lines(keyed: DataFrame, min_chars: int = 20) -> DataFrame:
    """rk, removed (numbers of lines, from 0) of documents (doc_id, text, rk) that lose any."""
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    lines = keyed.withColumn("t", trimmed).select(
        "rk",
        "doc_id",
        F.transform("t", lambda x: F.xxhash64(x, F.length(x))).alias("hashes"),
        F.transform("t", lambda x: F.length(x)).alias("chars"),
    )
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    lines = materialize(lines.withColumn("same", F.xxhash64("hashes")).withColumn("n", F.size("hashes")).withColumn("total", total), "lines")
    # of documents with the same lines the earliest stands for all
    leads = lines.groupBy("same", "n", "total").agg(F.min(F.struct("doc_id", "rk", "hashes", "chars")).alias("x"))
    table = materialize(leads.select("x.*"), "leads")
    copies = lines.where(F.col("total") >= max(min_chars, 1)).select("rk", "n").join(table.select("rk"), "rk", "left_anti").distinct()
    copies = copies.select("rk", F.sequence(F.lit(0), F.col("n") - 1).alias("removed"))
    spots = _spots(table, max(min_chars, 1))
    shared = spots.groupBy("h").agg(F.min("at").alias("last"), F.max("at").alias("newest"), F.count(F.lit(1)).alias("holders")).where(F.col("last") < F.col("newest"))
    shared = materialize(shared.select("h", "last", "holders"), "shared-keys")
    # a very common line meets its first holder in many tasks
    spots = materialize(spread_join(spots, shared.drop("holders"), "h", big_keys(shared, "h", "holders"), F.col("at")), "shared-lines")
    pairs = materialize(spots.where(F.col("at") > F.col("last")).select(F.col("last.rk").alias("a"), F.col("at.rk").alias("b")).distinct(), "pairs")
    gone = materialize(_aligned_away(pairs, table, min_chars), "gone")

    def still(rows: DataFrame, lost: DataFrame) -> DataFrame:
        lost = _few(lost).select(F.col("rk").alias("_rk"), F.col("j").alias("_j"))
        return materialize(rows.join(lost, (F.col("at.rk") == F.col("_rk")) & (F.col("j") == F.col("_j")), "left_anti"), "kept-lines")

    # ``live``: kept lines that have a holder after ``last``, the latest one their key has been aligned with, and before their own document
    live = still(spots.where(F.col("at") > F.col("last")).drop("once"), gone)
    most = pairs.count()
    while n_live := live.count():
        hubs_a_key = min(MOST_HUBS, max(FIRST_HUBS, most // n_live))
        keys = live.groupBy("h").agg(F.max("last").alias("last"), F.max("at").alias("newest"))
        found = spots.where("once").select("h", "at").join(_few(keys, n_live), "h").where((F.col("at") > F.col("last")) & (F.col("at") < F.col("newest")))
        # first by parts of a key's holders, so that no task reads more than a few times the hubs of a key
        parts = found.select("h", "at", F.pmod(F.xxhash64("at.rk"), F.lit(PARTS)).alias("part"))
        hubs = materialize(_first(_first(parts, hubs_a_key, "h", "part").drop("n"), hubs_a_key, "h").select("h", F.col("at").alias("hub"), "n"), "hubs")
        new = live.join(_few(hubs), "h").where(F.col("hub") < F.col("at")).select(F.col("hub.rk").alias("a"), F.col("at.rk").alias("b")).distinct()
        if n_live * hubs_a_key > FEW:
            # few pairs are sooner aligned again than looked up
            new = new.join(pairs, ["a", "b"], "left_anti")
        new = materialize(new, "pairs")
        lost = materialize(_aligned_away(new, table, min_chars), "gone")
        # a key with fewer hubs than were asked for has no further ones
        ahead = hubs.where(F.col("n") == hubs_a_key).select("h", F.col("hub").alias("last"))
        live = still(live.drop("last").join(_few(ahead, n_live), "h").where(F.col("at") > F.col("last")).select(live.columns), lost)
        pairs, gone = pairs.unionByName(new), gone.unionByName(lost)
    return gone.groupBy("rk").agg(F.collect_set("j").alias("removed")).unionByName(copies)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, max_broadcast: int = 2_000_000) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_text, removed (numbers of the deleted lines)."""
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), same_row(F.col(id_col), text)[0].alias("rk"))
    gone = materialize(removed_lines(keyed, min_chars), "removed")
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))

    def cut(rows: DataFrame) -> DataFrame:
        with_lines = rows.withColumn("lines", lines).withColumn("stay", stay)
        kept = F.array_join(F.transform("stay", lambda i: F.element_at("lines", i + 1)), "\n")
        return with_lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), kept.alias("kept_text"), F.array_sort("removed").alias("removed"))

    none = F.array().cast("array<int>").alias("removed")
    if gone.count() > max_broadcast:
        return cut(keyed.join(gone, "rk", "left").select("doc_id", "text", F.coalesce("removed", none).alias("removed")))
    marked = F.broadcast(gone.select("rk"))
    clean = keyed.join(marked, "rk", "left_anti").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.coalesce("text", F.lit("")).alias("kept_text"), none)
    return clean.unionByName(cut(keyed.join(marked, "rk", "left_semi").join(gone, "rk").select("doc_id", "text", "removed")))
