"""Substring deduplication: words in windows of 35 that occur more than once, by sharded FM-indexes.

1. Every run of a document's windows with the same minimizer (the smallest hash of an 8-word gram
   inside the window) is a segment. Equal windows have equal minimizers, so segments of one
   minimizer form one shard and no window has to be looked up elsewhere.
2. Segments whose minimizer occurs once in all documents cannot repeat and go no further. Equal segments collapse to
   one with a weight, before any text moves. A minimizer with more than ``hot`` different segments
   is split: its windows are dealt, and collapsed, by their own hashes.
3. Each shard, of about ``shard_words`` words, builds a compressed FM-index (wavelet matrix over the
   Burrows-Wheeler transform). Backward search gives the matching statistics of every segment; the
   intervals of windows that occur twice or more, by weight, are reported.
4. Intervals go back to all documents that hold the segment; covered words are removed.

Windows are judged on the input, all copies alike, the same document included. Rows are told apart
by a 64-bit hash of doc_id and text.

Defined results: null and empty texts have no words. Texts under 35 words lose none. Rows that
repeat doc_id and text are rows of their own: their windows occur as often as the rows do. Null
doc_ids are allowed. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melodyspark.llm.arrowtext import SPACED, U64, Words, chunks, joined, mix, powers, windows, words
from melodyspark.llm.fmindex import repeated_windows
from melodyspark.llm.scratch import big_keys, materialize, same_row, spread_join

GRAM, RUN = 8, 256
_R = 0xA0761D6478BD642F
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences start:end."""
    n = len(values)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * powers(_R, n))])
    return mix((total[end] - total[start]) * powers(pow(_R, -1, 1 << 64), n + 1)[start] + (end - start).astype(U64))


def _sliding(op: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """op over every ``span`` neighbours, by doubling."""
    out, width = x, 1
    while width * 2 <= span:
        out, width = op(out[:-width], out[width:]), width * 2
    n = len(x) - span + 1
    return op(out[:n], out[span - width : span - width + n])


def segments(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimizer of each segment, and whether the minimizer occurs in it twice."""
    none = np.empty(0, np.int64)
    nothing = none, none, none.astype(U64), none.astype(bool)
    gram, h = windows(w, GRAM)
    span = size - GRAM + 1
    if len(h) < span:
        return nothing
    low = _sliding(np.minimum, h, span)
    begin, _ = windows(w, size)
    if len(begin) == 0:
        return nothing
    at = np.searchsorted(gram, begin)
    value = low[at]
    new = np.ones(len(begin), bool)
    new[1:] = (value[1:] != value[:-1]) | (begin[1:] != begin[:-1] + 1)
    # a window that follows in the next row is not a neighbour
    row = np.searchsorted(w.first, begin, "right")
    new[1:] |= row[1:] != row[:-1]
    start = np.flatnonzero(new)
    place = np.arange(len(begin)) - np.repeat(start, np.diff(np.append(start, len(begin))))
    start = np.flatnonzero(place % RUN == 0)
    # grams that are some window's minimizer; inside one segment equal ones follow each other
    best = np.zeros(len(h) + span - 1, U64)
    best[at + span - 1] = value
    chosen = np.flatnonzero(_sliding(np.maximum, best, span) == h)
    again = chosen[:-1][(h[chosen[1:]] == h[chosen[:-1]]) & (chosen[1:] - chosen[:-1] <= span)]
    first = begin[start]
    # told by value within the document, which may mark a segment too many but never one too few
    of = lambda word: np.searchsorted(w.first, word, "right").astype(U64) * U64(_R)
    twice = np.isin(value[start] ^ of(first), h[again] ^ of(gram[again]))
    return first, np.diff(np.append(start, len(begin))), value[start], twice


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), same_row(F.col(id_col), text)[0].alias("rk"))


def segment_table(keyed: DataFrame, size: int) -> DataFrame:
    """m (minimizer), h1 and h2 (hashes of the words), windows, rk, start of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, at in chunks(b.column(1)):
                w = words(data, at, SPACED, lower=False)
                start, n, m, twice = segments(w, size)
                row = np.searchsorted(w.first, start, "right") - 1
                end = start + n + size - 1
                other = mix(w.hash ^ U64(0x5851F42D4C957F2D))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (m.view(np.int64), _range_hash(w.hash, start, end).view(np.int64), _range_hash(other, start, end).view(np.int64), n.astype(np.int32), rk[lo + row].astype(np.int64), (start - w.first[row]).astype(np.int32), twice)],
                    names=["m", "h1", "h2", "windows", "rk", "start", "twice"],
                )

    return keyed.select("rk", "text").mapInArrow(run, "m long, h1 long, h2 long, windows int, rk long, start int, twice boolean")


def _texts_of(keyed: DataFrame, wanted: DataFrame, max_broadcast: int) -> DataFrame:
    """One text for each rk in ``wanted`` (columns rk and more): joined after a map-side filter where that is small."""
    few = wanted.select("rk").distinct()
    if few.count() <= max_broadcast:
        keyed = keyed.join(F.broadcast(few), "rk", "left_semi")
    return keyed.select("rk", "text").dropDuplicates(["rk"]).join(wanted, "rk")


def _segment_texts(with_text: DataFrame, size: int) -> DataFrame:
    """From rk, text, wanted (start, windows, h1, h2, weight, hot): the words of each segment.

    A hot segment comes as its windows, each with hashes of its own; ``s1, s2, offset`` say where
    it stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(1).to_pylist()
            for lo, hi, data, at in chunks(b.column(0)):
                w = words(data, at, SPACED, lower=False)
                out: dict[str, list] = {k: [] for k in ("k1", "k2", "weight", "s1", "s2", "offset", "hot", "words")}
                for r in range(hi - lo):
                    for x in wanted[lo + r]:
                        s = int(w.first[r]) + x["start"]
                        starts = range(s, s + x["windows"]) if x["hot"] else (s,)
                        length = size if x["hot"] else x["windows"] + size - 1
                        for i in starts:
                            out["s1"].append(x["h1"])
                            out["s2"].append(x["h2"])
                            out["offset"].append(i - s)
                            out["weight"].append(x["weight"])
                            out["hot"].append(x["hot"])
                            out["words"].append((i, i + length))
                span = np.array(out["words"], np.int64).reshape(-1, 2)
                other = mix(w.hash ^ U64(0x5851F42D4C957F2D))
                k1, k2 = (_range_hash(v, span[:, 0], span[:, 1]).view(np.int64) for v in (w.hash, other))
                texts = [joined(data, w, i, j, lower=False) for i, j in span.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), pa.array(out["weight"], pa.int64()), pa.array(out["s1"], pa.int64()), pa.array(out["s2"], pa.int64()), pa.array(out["offset"], pa.int32()), pa.array(out["hot"], pa.bool_()), pa.array(texts, pa.binary())],
                    names=["k1", "k2", "weight", "s1", "s2", "offset", "hot", "words"],
                )

    return with_text.select("text", "wanted").mapInArrow(run, "k1 long, k2 long, weight long, s1 long, s2 long, offset int, hot boolean, words binary")


def _search(table: pa.Table, size: int) -> pa.Table:
    """One shard: index its segments, search them all, report ranges of repeated windows."""
    column = table["words"].combine_chunks()
    n = table.num_rows
    _, ob, db = column.buffers()
    at = np.frombuffer(ob, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    w = words(np.frombuffer(db, np.uint8)[at[0] : at[-1]], at - at[0], SPACED, lower=False)
    found = repeated_windows([w.hash[i:j] for i, j in zip(w.first[:-1], w.first[1:], strict=True)], table["weight"].to_numpy(), size)
    ranges = []
    for hit in found:
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        ranges.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table([table["k1"], table["k2"], pa.array(ranges, kind)], names=["k1", "k2", "ranges"])


def repeated_spans(keyed: DataFrame, size: int = 35, hot: int = 1000, shard_words: int = 500_000, max_broadcast: int = 2_000_000) -> DataFrame:
    """rk and spans (start, end) of words that repeated windows cover, for documents that have any."""
    spark = keyed.sparkSession
    table = segment_table(keyed, size)
    twice = table.groupBy("m").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("twice").cast("int")).alias("t"))
    twice = materialize(twice.where(F.col("rows") + F.col("t") > 1).select("m", "rows"), "minimizers")
    # the segments of a very common minimizer are dealt over many tasks
    maybe = materialize(spread_join(table.drop("twice"), twice.select("m"), "m", big_keys(twice, "m", "rows"), F.col("rk")), "segments")
    distinct = maybe.groupBy("m", "h1", "h2").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("rk", "start", "windows")).alias("at"))
    distinct = materialize(distinct.select("m", "h1", "h2", "weight", "at.*"), "distinct")
    crowded = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("m", F.lit(True).alias("hot"))
    crowded = materialize(crowded, "crowded")
    # at most one in ``hot`` of the segments' number
    crowded = F.broadcast(crowded) if crowded.count() <= max_broadcast else crowded
    asked = distinct.join(crowded, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    requests = asked.groupBy("rk").agg(F.collect_list(F.struct("start", "windows", "h1", "h2", "weight", "hot")).alias("wanted"))
    shard_key = distinct.select("h1", "h2", F.col("m"))
    content = _segment_texts(_texts_of(keyed, requests, max_broadcast), size)
    content = materialize(content, "content")
    plain = content.where(~F.col("hot")).join(shard_key, (F.col("s1") == shard_key["h1"]) & (F.col("s2") == shard_key["h2"])).select("k1", "k2", "weight", "words", F.col("m").alias("route"))
    dealt = content.where("hot").groupBy("k1", "k2").agg(F.sum("weight").alias("weight"), F.min("words").alias("words")).select("k1", "k2", "weight", "words", F.col("k1").alias("route"))
    total = distinct.agg(F.sum(F.col("windows") + size).cast("long").alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // shard_words))
    indexed = plain.unionByName(dealt).withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    found = indexed.groupBy("shard").applyInArrow(lambda t: _search(t, size), T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("ranges", RANGES)]))
    found = materialize(found.where(F.size("ranges") > 0), "found")
    # windows of hot segments go back to their segments, then all go back to every document that holds the segment
    apart = content.where("hot").select("k1", "k2", "s1", "s2", "offset").join(found, ["k1", "k2"]).select("s1", "s2", F.transform("ranges", lambda x: F.struct((x["start"] + F.col("offset")).alias("start"), (x["end"] + F.col("offset")).alias("end"))).alias("ranges"))
    apart = apart.groupBy("s1", "s2").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    whole = content.where(~F.col("hot")).select("k1", "k2", "s1", "s2").join(found, ["k1", "k2"]).select("s1", "s2", "ranges")
    ranges = whole.unionByName(apart).select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), "ranges")
    # a segment that very many documents hold is dealt over many tasks on the way back too
    both = F.struct("h1", "h2").alias("hh")
    common = big_keys(distinct.select(both, "weight"), "hh", "weight")
    back = spread_join(maybe.select(both, "rk", "start"), ranges.select(both, "ranges"), "hh", common, F.col("rk"))
    spans = back.select("rk", F.explode("ranges").alias("r"), "start").select("rk", F.struct((F.col("start") + F.col("r.start")).alias("start"), (F.col("start") + F.col("r.end") + size - 1).alias("end")).alias("span"))
    return spans.groupBy("rk").agg(F.collect_set("span").alias("spans"))


def _cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """From doc_id, text, spans: n_words, n_removed, kept_sha256 (and the kept text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2).to_pylist()
            out: list[list] = [[], [], [], []]
            for lo, hi, data, at in chunks(b.column(1)):
                w = words(data, at, SPACED, lower=False)
                keep = np.ones(len(w.hash), bool)
                for r in range(hi - lo):
                    for s in spans[lo + r] or ():
                        keep[w.first[r] + s["start"] : w.first[r] + s["end"]] = False
                ends = w.first.tolist()
                for r in range(hi - lo):
                    i, j = ends[r], ends[r + 1]
                    own = np.flatnonzero(keep[i:j]) + i
                    base, stop = (int(w.start[i]), int(w.end[j - 1])) if j > i else (0, 0)
                    raw = data[base:stop].tobytes()
                    text = b" ".join([raw[s - base : e - base] for s, e in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)])
                    out[0].append(j - i)
                    out[1].append(j - i - len(own))
                    out[2].append(hashlib.sha256(text).hexdigest())
                    out[3].append(text.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, with_text: bool = True, max_broadcast: int = 2_000_000, **params: int) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless ``with_text``)."""
    keyed = _keyed(docs, id_col, text_col)
    spans = materialize(repeated_spans(keyed, size, max_broadcast=max_broadcast, **params), "spans")
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    if spans.count() > max_broadcast:
        return _cut(keyed.join(spans, "rk", "left"), with_text)
    marked = F.broadcast(spans.select("rk"))
    clean = _cut(keyed.join(marked, "rk", "left_anti").select("doc_id", "text", none), with_text)
    return clean.unionByName(_cut(keyed.join(marked, "rk", "left_semi").join(spans, "rk"), with_text))
