"""Token counts from an exact length histogram.

Every text is encoded once, whole; documents are aggregated by encoded length, so what is shuffled
is one row per length and task. Suffix sums over the histogram then answer, for every context
limit L: how many documents and tokens there are in all, how many reach L, what share lies at or
under it, and how many tokens remain when each document is truncated to L.

Defined results: null and empty texts have length 0 and are counted there. Special-token strings
in a text are ordinary text. An empty table gives an empty histogram. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.llm.scratch import materialize

#: where the public tokenizers' files lie; a parameter of every function here
TOKENIZERS = "/opt/tokenizers"
#: the pre-tokenizing pattern of byte-level BPE vocabularies of about 50k entries (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """A byte-level BPE encoder from a file of ranks, once per Python worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            out = [len(enc.encode_ordinary(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame, stride: int = 1024) -> DataFrame:
    """One row per length L: docs, and by suffix sums what holds at context limit L.

    ``docs_over`` and ``tokens_over``: documents longer than L and their tokens; ``tokens_kept``:
    all tokens when texts are truncated to L; ``share_within``: documents of at most L tokens.
    Sums run inside strides of lengths and then over the strides, so no task holds all lengths.
    """
    hist = materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")), "histogram")
    hist = hist.withColumn("part", F.expr(f"n_tokens div {stride}")).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    parts = hist.groupBy("part").agg(F.sum("docs").alias("pd"), F.sum("tokens").alias("pt"))
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = parts.select("part", F.coalesce(F.sum("pd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("pt").over(after), F.lit(0)).alias("at"), F.sum("pd").over(every).alias("all_docs"), F.sum("pt").over(every).alias("all_tokens"))
    here = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, rest: (F.coalesce(F.sum(c).over(here), F.lit(0)) + F.col(rest)).cast("long")
    out = hist.join(parts, "part").select("n_tokens", "docs", over("docs", "ad").alias("docs_over"), over("tokens", "at").alias("tokens_over"), "all_docs", "all_tokens")
    kept = F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return out.select("n_tokens", "docs", "docs_over", "tokens_over", "all_docs", "all_tokens", kept.cast("long").alias("tokens_kept"), ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """What ``length_histogram`` says for chosen context limits, whether or not a text has that length."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context long")
    # the longest length at most L answers for L: no length lies between
    best = histogram.join(F.broadcast(wanted), F.col("n_tokens") <= F.col("context")).groupBy("context").agg(F.max_by(F.struct(*histogram.columns), "n_tokens").alias("h"))
    return best.select("context", F.col("h.docs_over"), F.col("h.tokens_over"), (F.col("h.all_tokens") - F.col("h.tokens_over") + F.col("h.docs_over") * F.col("context")).alias("tokens_kept"), F.col("h.share_within"))


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of all documents do not exceed."""
    return histogram.where(F.col("share_within") >= share).agg(F.min("n_tokens").alias("q")).first()["q"]
