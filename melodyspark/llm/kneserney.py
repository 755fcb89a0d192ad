"""Interpolated modified Kneser-Ney models over character n-grams, as sharded tables.

Characters are those of Unicode as they are (A-Z may be lower-cased); runs of ASCII white space count
as one space, and ``order - 1`` spaces stand before the first character of a text. Counts, context
totals, discounts and probabilities are DataFrames, hashed by context or by n-gram, and grow with the
texts: no table is collected, folded or cut.

1. ``gram_counts`` counts the n-grams of all documents, combined inside each task before the
   shuffle, and beside them the occurrences in each class of training texts.
2. ``estimate`` derives the lower orders (continuation counts) by suffix, joins counts to the totals
   of their contexts and to the next shorter order, and so gives every n-gram that occurs in a
   document its probability under every model, n-grams that training never saw included.
3. ``score`` reads the documents again. The most frequent n-grams, at most ``hot`` whatever the input and
   told by a histogram of counts, are broadcast and summed in place; the others are counted per document
   and joined to the table of step 2, sharded by n-gram, those of very many occurrences dealt over several
   tasks. Both give the same sums.

Tables hold n-grams as strings; only the broadcast ones are found by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melodyspark.llm.arrowtext import LOWER, U64, chunks, mix
from melodyspark.llm.scratch import big_keys, materialize, spread_join

ORDER = 5
#: n-grams whose values are broadcast for scoring: under 10 MB, whatever the input
HOT = 300_000
#: bytes of text whose n-grams are taken together; a worker's arrays are some hundred times as large
CHUNK = 1 << 20
COLD = T.ArrayType(T.StructType([T.StructField("g", T.StringType()), T.StructField("c", T.IntegerType())]))
_SPACE = np.zeros(128, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U64(0x9E3779B97F4A7C15)


def symbols(data: np.ndarray, at: np.ndarray, order: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, each behind ``order - 1`` spaces, and where each row begins (its spaces included)."""
    raw = (LOWER[data] if lower else data).tobytes()
    cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    if len(cp) != upto[-1]:
        # bytes that are not UTF-8
        rows = [raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]
        cp = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        upto = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    blank = _SPACE[np.minimum(cp, 127)]
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    # white space at the beginning of a row follows the spaces that stand before it
    heads = upto[:-1][upto[:-1] < upto[1:]]
    keep[heads] = ~blank[heads]
    kept = np.concatenate([[0], np.cumsum(keep)])
    sizes = np.diff(kept[upto])
    first = np.concatenate([[0], np.cumsum(sizes + order - 1)])
    out = np.full(first[-1], 32, np.uint32)
    place = np.arange(kept[-1]) + np.repeat((order - 1) * np.arange(1, len(at)), sizes)
    out[place] = np.where(blank, np.uint32(32), cp)[keep]
    return out, first


def ends(first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n-grams end, and the row of each."""
    sizes = np.diff(first) - (order - 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(row)) + (order - 1) * (row + 1), row


def gram_strings(cp: np.ndarray, end: np.ndarray, order: int) -> list[str]:
    """The n-grams that end at these positions."""
    text = np.stack([cp[end - order + 1 + j] for j in range(order)], 1).astype("<u4").tobytes().decode("utf-32-le") if len(end) else ""
    return [text[i : i + order] for i in range(0, len(text), order)]


def hashes(cp: np.ndarray, order: int) -> np.ndarray:
    """A hash of the n-gram that ends at each position from ``order - 1`` on."""
    n = len(cp) - order + 1
    h = np.zeros(max(n, 0), U64)
    for j in range(order):
        h = h * _BASE + cp[j : j + n].astype(U64) + U64(1)
    return mix(h)


class _Counts:
    """Counts of (n-gram, class) of one task; n-grams are packed as numbers of the characters met so far."""

    def __init__(self, order: int, classes: int) -> None:
        self.order, self.classes = order, classes
        self.bits = 60 // order
        self.reset()

    def reset(self) -> None:
        self.number = np.full(0x110000, -1, np.int32)
        self.met: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def take(self, cp: np.ndarray) -> bool:
        """Number the characters of ``cp``; False if there are too many to pack."""
        seen = np.zeros(0x110000, bool)
        seen[cp] = True
        fresh = np.flatnonzero(seen & (self.number < 0))
        if len(self.met) + len(fresh) > 1 << self.bits:
            return False
        self.number[fresh] = np.arange(len(self.met), len(self.met) + len(fresh))
        self.met += fresh.tolist()
        return True

    def add(self, cp: np.ndarray, end: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the n-grams that end at ``end``, in any number of pieces; full tables are yielded."""
        todo = [(0, len(end))]
        while todo:
            lo, hi = todo.pop()
            if lo == hi:
                continue
            piece = cp[end[lo] - self.order + 1 : end[hi - 1] + 1]
            if not self.take(piece):
                if self.parts:
                    yield from self.flush()
                    todo.append((lo, hi))
                else:
                    # even alone too many kinds of characters; a piece of one n-gram always fits
                    self.reset()
                    todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                continue
            own = self.number[piece].astype(np.int64)
            code = np.zeros(len(piece) - self.order + 1, np.int64)
            for j in range(self.order):
                code = (code << self.bits) | own[j : j + len(code)]
            keys, n = np.unique((code[end[lo:hi] - end[lo]] << 2) | label[lo:hi], return_counts=True)
            self.parts.append((keys, n.astype(np.int64)))
            self.held += len(keys)
            if self.held > 3_000_000:
                self.merge()
                if self.held > 1_500_000:
                    yield from self.flush()

    def merge(self) -> None:
        keys, where = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, where, np.concatenate([c for _, c in self.parts]))
        self.parts, self.held = [(keys, n)], len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            keys, n = self.parts[0]
            gram, where = np.unique(keys >> 2, return_inverse=True)
            table = np.zeros((len(gram), 4), np.int64)
            table[where, keys & 3] = n
            met = np.array(self.met, np.uint32)
            mask = (1 << self.bits) - 1
            cp = np.stack([met[(gram >> (self.bits * (self.order - 1 - j))) & mask] for j in range(self.order)], 1).ravel()
            for i in range(0, len(gram), 50_000):
                k = min(len(gram), i + 50_000)
                g = gram_strings(cp, np.arange(i, k) * self.order + self.order - 1, self.order)
                own = [pa.array(table[i:k, j]) for j in range(self.classes)]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(table[i:k].sum(1)), *own], names=["g", "n", *[f"c{j}" for j in range(self.classes)]])
        self.reset()


def gram_counts(texts: DataFrame, classes: int, order: int = ORDER, lower: bool = False) -> DataFrame:
    """From texts (text, label): g, n (all occurrences) and c0 .. (those in texts of each label under ``classes``, at most 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(order, classes)
        for b in batches:
            label = b.column(1).fill_null(3).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in chunks(b.column(0), CHUNK):
                cp, first = symbols(data, at, order, lower)
                end, row = ends(first, order)
                yield from counts.add(cp, end, label[lo:hi].astype(np.int64)[row])
        yield from counts.flush()

    names = ["n", *[f"c{k}" for k in range(classes)]]
    local = texts.select("text", F.col("label").cast("int")).mapInArrow(run, "g string, " + ", ".join(f"{c} long" for c in names))
    return local.groupBy("g").agg(*[F.sum(c).alias(c) for c in names])


def discounts(table: DataFrame, cols: list[str]) -> dict[str, list[float]]:
    """Modified Kneser-Ney discounts of each count column, for counts of one, two, and three or more."""
    n = table.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in cols for k in range(1, 5)]).first()
    out = {}
    for c in cols:
        n1, n2, n3, n4 = (float(n[f"{c}_{k}"]) for k in range(1, 5))
        if not n1 or not n2:
            out[c] = [0.5, 0.5, 0.5]
            continue
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        out[c] = [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]
    return out


def _step(table: DataFrame, cols: list[str], below: dict[str, Column]) -> DataFrame:
    """``table`` (g and count columns) with a probability q_<col> for each: counts joined to the totals of their contexts."""
    d = discounts(table, cols)
    keyed = table.withColumn("ctx", F.expr("substring(g, 1, char_length(g) - 1)"))
    seen = {c: F.col(c) > 0 for c in cols}
    kinds = [(c, k, F.col(c) == k if k < 3 else F.col(c) > 2) for c in cols for k in (1, 2, 3)]
    totals = keyed.groupBy("ctx").agg(*[F.sum(c).cast("double").alias(f"t_{c}") for c in cols], *[F.count_if(x).alias(f"n_{c}_{k}") for c, k, x in kinds])
    joined = keyed.join(totals, "ctx")
    for c in cols:
        cut = F.when(F.col(c) == 1, d[c][0]).when(F.col(c) == 2, d[c][1]).otherwise(d[c][2])
        own = F.when(seen[c], F.greatest(F.col(c) - cut, F.lit(0.0))).otherwise(F.lit(0.0))
        back = d[c][0] * F.col(f"n_{c}_1") + d[c][1] * F.col(f"n_{c}_2") + d[c][2] * F.col(f"n_{c}_3")
        p = F.when(F.col(f"t_{c}") > 0, (own + back * below[c]) / F.col(f"t_{c}")).otherwise(below[c])
        joined = joined.withColumn(f"q_{c}", p)
    return joined.select(*table.columns, *[f"q_{c}" for c in cols])


def estimate(grams: DataFrame, models: list[str], shared: int = 0, order: int = ORDER) -> DataFrame:
    """g, n and q_<model>, the probability of the last character, from ``grams`` (g, n and a count column for each model).

    The lowest ``shared`` orders come from the counts of all models together; only the longer ones are
    each model's own. Below all of them every known character, and one for all unknown ones, is alike.
    """
    both = "all_models"
    total = sum((F.col(m) for m in models[1:]), F.col(models[0]))
    tables = [grams.select("g", "n", *models, total.alias(both))]
    for _ in range(order - 1):
        up = tables[-1]
        tables.append(materialize(up.groupBy(F.expr("substring(g, 2)").alias("g")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in (*models, both)]), "lower-grams"))
    known = tables[-1].where(F.col(both) > 0).count() + 1
    done: DataFrame | None = None
    for k, t in enumerate(reversed(tables), 1):
        cols = [both] if k <= shared else models
        last = [both] if k - 1 <= shared else models
        kept = ["g", "n"] if k == order else ["g"]
        t = t.select(*kept, *cols)
        if done is None:
            t = _step(t, cols, dict.fromkeys(cols, F.lit(1.0 / known)))
        else:
            shorter = done.select(F.col("g").alias("_s"), *[F.col(f"q_{c}").alias(f"b_{c}") for c in last])
            t = t.join(shorter, F.expr("substring(g, 2)") == F.col("_s")).drop("_s")
            below = {c: F.col(f"b_{c}" if c in last else f"b_{both}") for c in cols}
            t = _step(t, cols, below).select(*kept, *[f"q_{c}" for c in cols])
        done = materialize(t, "probabilities") if k < order else t
    if shared >= order:
        done = done.select("g", "n", *[F.col(f"q_{both}").alias(f"q_{m}") for m in models])
    return done


class _Hot:
    """Hashes of the broadcast n-grams under a 20-bit index, and their values."""

    def __init__(self, grams: list[str], values: np.ndarray, order: int) -> None:
        cp = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
        h = hashes(cp, order)[::order] if grams else np.empty(0, U64)
        by = np.argsort(h)
        self.keys, self.values = h[by], values[by]

    def ready(self) -> _Hot:
        if not hasattr(self, "begin"):
            self.begin = np.searchsorted(self.keys, np.arange((1 << 20) + 1, dtype=U64) << U64(44)).astype(np.int32)
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the values, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        top = (h >> U64(44)).astype(np.int64)
        at, stop = self.begin[top], self.begin[top + 1]
        left = np.flatnonzero(at < stop)
        at, stop, h = at[left], stop[left], h[left]
        while len(left):
            same = self.keys[at] == h
            out[left[same]] = at[same]
            at = at + 1
            more = ~same & (at < stop)
            left, at, stop, h = left[more], at[more], stop[more], h[more]
        return out


def frequent_from(grams: DataFrame, hot: int, steps: int = 16) -> Column:
    """A condition on n that at most ``hot`` n-grams meet: the bound lies between steps of a histogram of log2 n.

    The histogram has at most 64 * ``steps`` rows; no task sorts or gathers n-grams.
    """
    step = F.floor(F.log2("n") * steps).cast("int")
    total, cut = 0, None
    for r in grams.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("grams")).orderBy(F.desc("s")).collect():
        total += r["grams"]
        if total > hot:
            break
        cut = r["s"]
    return F.lit(False) if cut is None else step >= cut


def score(rows: DataFrame, grams: DataFrame, values: list[str], order: int = ORDER, lower: bool = False, hot: int = HOT, common: int = 50_000) -> DataFrame:
    """``rows`` (row, text) as row, n_scored and the sum of every value over the text's n-grams.

    ``grams`` has g, n and the value columns for every n-gram of the texts. Of those that are not broadcast,
    n-grams of more than ``common`` occurrences are dealt over several tasks.
    """
    spark = rows.sparkSession
    often = frequent_from(grams, hot)
    top = grams.where(often).select("g", *values).toArrow()
    found = _Hot(top["g"].to_pylist(), np.stack([top[v].to_numpy() for v in values], 1).reshape(-1, len(values)), order)
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.ready()
        for b in batches:
            for lo, hi, data, at in chunks(b.column(1), CHUNK):
                cp, first = symbols(data, at, order, lower)
                end, row = ends(first, order)
                size = np.bincount(row, minlength=hi - lo)
                h = hashes(cp, order)[end - order + 1] if len(end) else np.empty(0, U64)
                place = known.find(h)
                met = place >= 0
                sums = []
                for j in range(len(values)):
                    value = np.zeros(len(h))
                    value[met] = known.values[place[met], j]
                    total = np.concatenate([[0.0], np.cumsum(value)])
                    upto = np.concatenate([[0], np.cumsum(size)])
                    sums.append(pa.array(total[upto[1:]] - total[upto[:-1]]))
                # n-grams that are not broadcast, once per row with their count
                miss = np.flatnonzero(~met)
                by = np.lexsort((h[miss], row[miss]))
                miss = miss[by]
                new = np.ones(len(miss), bool)
                new[1:] = (h[miss[1:]] != h[miss[:-1]]) | (row[miss[1:]] != row[miss[:-1]])
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(miss)))
                offsets = np.searchsorted(row[miss[start]], np.arange(hi - lo + 1)).astype(np.int32)
                cold = pa.StructArray.from_arrays([pa.array(gram_strings(cp, end[miss[start]], order), pa.string()), pa.array(n.astype(np.int32))], names=["g", "c"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), *sums, pa.ListArray.from_arrays(pa.array(offsets), cold)],
                    names=["row", "n_scored", *values, "cold"],
                )

    extra = [T.StructField("n_scored", T.LongType()), *[T.StructField(v, T.DoubleType()) for v in values], T.StructField("cold", COLD)]
    part = rows.select("row", "text").mapInArrow(run, T.StructType([rows.schema["row"], *extra]))
    part = materialize(part.withColumn("key", F.monotonically_increasing_id()), "hot-sums")
    asked = part.where(F.size("cold") > 0).select("key", F.explode("cold").alias("x")).select("key", "x.g", "x.c")
    rest = grams.where(~often)
    met = spread_join(asked, rest.select("g", *values), "g", big_keys(rest, "g", "n", common), F.col("key"))
    cold = met.groupBy("key").agg(*[F.sum(F.col(v) * F.col("c")).alias(f"cold_{v}") for v in values])
    both = part.drop("cold").join(cold, "key", "left")
    return both.select("row", "n_scored", *[(F.col(v) + F.coalesce(f"cold_{v}", F.lit(0.0))).alias(v) for v in values])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", how: str = "inner", max_rows: int = 4_000_000) -> DataFrame:
    """Texts joined to their labels: labels are broadcast up to ``max_rows`` rows, shuffled beyond."""
    n = labels.count()
    return docs.join(F.broadcast(labels) if n <= max_rows else labels, id_col, how)
