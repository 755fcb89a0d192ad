"""Mixing sources to target weights, in DataFrame functions only.

A source's share of all tokens is raised to an exponent from 0 (all alike) to 1 (as they are) and
normalised. The exponent is bisected to the largest that still reaches a target entropy (a share
of the highest, log of the number of sources), and raised where a source would otherwise be
repeated more often than ``max_repeats``. Each source then gets its weight of the token budget:
whole epochs, and of the last epoch a prefix of a permutation of its documents. The permutation is
cut into blocks of about ``block_docs`` documents; block totals find the block where the budget
ends, and only inside that block documents are added up one by one, so no source is ever sorted or
summed in one task. What each source comes to is one row of a plan; documents meet it map-side.

Defined results: tokens are words between ASCII white space; a null text has none. A null source
is a source. A source without tokens has weight 0 and no copies. Documents whose turn falls where
the budget ends exactly are taken; a document that does not fit ends the prefix. Rows that repeat
a doc_id are rows of their own, ordered by their tokens and texts; rows that repeat both are taken or
left together, so the budget is never overrun. Rows without an id are ordered by their texts. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.llm.scratch import materialize

#: exponents are multiples of 1 / STEPS; each pass of the bisection tries WAYS + 1 of them
STEPS, WAYS = 1 << 20, 32


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _grid(sources: DataFrame, total: float, budget: float, ks: list[int]) -> dict[int, tuple[float, float]]:
    """For each exponent k / STEPS: the entropy of the weights and the most repetitions of any source."""
    lnp = F.log(F.col("tokens") / F.lit(total))
    at = sources.where(F.col("tokens") > 0).select("tokens", lnp.alias("lnp"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    e = F.col("k") / F.lit(STEPS) * F.col("lnp")
    rows = at.withColumn("e", e).withColumn("x", F.exp("e")).groupBy("k").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.col("e")).alias("s"), F.max(F.col("x") / F.col("tokens")).alias("m"))
    found = rows.select("k", (F.log("z") - F.col("s") / F.col("z")).alias("h"), (F.col("m") * F.lit(budget) / F.col("z")).alias("r")).collect()
    return {r["k"]: (r["h"], r["r"]) for r in found}


def temperature(sources: DataFrame, budget: float, entropy_share: float, max_repeats: float) -> float:
    """The exponent for sources (tokens), found by narrowing a grid; two numbers an exponent reach the driver."""
    first = sources.where(F.col("tokens") > 0).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not first["n"] or first["n"] == 1:
        return 1.0
    import math

    target = entropy_share * math.log(first["n"])

    def last_true(holds) -> int:  # holds(k) is true up to some k
        lo, width = 0, STEPS
        while width > 1:
            step = max(1, width // WAYS)
            ks = [min(STEPS, lo + i * step) for i in range(WAYS + 1)]
            seen = _grid(sources, float(first["t"]), budget, sorted(set(ks)))
            good = [k for k in sorted(set(ks)) if holds(seen[k])]
            if not good:
                return -1
            lo, width = good[-1], step
            if lo == STEPS:
                break
        return lo

    flat = max(0, last_true(lambda x: x[0] >= target))
    # repetitions fall as the exponent rises: the first k within the limit follows the last beyond it
    limited = min(STEPS, last_true(lambda x: x[1] > max_repeats) + 1)
    return max(flat, limited) / STEPS


def _placed(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """source, n_tokens, key and tie (which order the documents of a source) and more columns."""
    text = F.col(f"`{text_col}`").cast("string")
    tie = F.xxhash64(F.coalesce(text, F.lit("")))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), tie.cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return docs.select(*more, F.col(f"`{source_col}`").alias("source"), token_count(f"`{text_col}`").alias("n_tokens"), key.alias("key"), tie.alias("tie"))


def _block(blocks: Column) -> Column:
    return F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * blocks, 32)


def _shares(rows: DataFrame, entropy_share: float, max_repeats: float, budget: int | None, block_docs: int, max_broadcast: int) -> DataFrame:
    """Per source: blocks, full (whole epochs), the block where the last epoch ends, and its last document there.

    Block totals are added up inside runs of blocks and then over the runs; only documents of the one
    block where a source's budget ends are ordered.
    """
    sources = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    aim = total if budget is None else budget
    tau = temperature(sources, float(aim), entropy_share, max_repeats)
    x = F.when(F.col("tokens") > 0, F.exp(F.lit(tau) * F.log(F.col("tokens") / F.lit(float(max(total, 1)))))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(x).alias("z")).first()["z"] or 1.0
    given = F.floor(x / F.lit(z) * F.lit(float(aim)) + 1e-6).cast("long")
    shares = sources.withColumn("given", given).select(
        "source",
        F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(block_docs))).cast("long").alias("blocks"),
        F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0)).alias("full"),
        F.when(F.col("tokens") > 0, F.expr("given % tokens")).otherwise(F.lit(-1)).alias("rest"),
    )
    shares = materialize(shares, "shares")
    small = shares.count() <= max_broadcast

    def with_source(left: DataFrame, table: DataFrame) -> DataFrame:
        t = table.withColumnRenamed("source", "_s")
        return left.join(F.broadcast(t) if small else t, left["source"].eqNullSafe(t["_s"])).drop("_s")

    placed = with_source(rows, shares).withColumn("block", _block(F.col("blocks")))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    sums = materialize(sums.withColumn("run", F.expr("block div 4096")), "block-sums")
    runs = sums.groupBy("source", "run").agg(F.sum("t").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("run"))
    first = lambda t, name: t.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct(name, (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
    ends = first(runs, "run").select("source", F.col("e.run").alias("_run"), F.col("e.before").alias("_before"))
    inside = with_source(sums, ends).where(F.col("run") == F.col("_run"))
    upto = F.col("_before") + F.sum("t").over(Window.partitionBy("source").orderBy("block"))
    ends = materialize(first(inside, "block").select("source", F.col("e.block").alias("last"), F.col("e.before").alias("before")), "ends")
    edge = with_source(placed, ends).where(F.col("block") == F.col("last"))
    edge = edge.groupBy("source", "key", "n_tokens", "tie").agg(F.sum("n_tokens").alias("t"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    at = F.struct("key", "n_tokens", "tie")
    taken = edge.withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy("source").orderBy(at))).where(F.col("upto") <= F.col("rest"))
    cuts = taken.groupBy("source").agg(F.max(at).alias("cut"))
    a, b, c = shares.alias("a"), ends.alias("b"), cuts.alias("c")
    out = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").join(c, F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    return materialize(out.select("a.source", "blocks", "full", "rest", "last", "cut"), "plan")


def _copies(rows: DataFrame, plan: DataFrame, max_broadcast: int) -> DataFrame:
    """``rows`` with block and copies, from the plan of their sources."""
    p = plan.withColumnRenamed("source", "_s")
    own = rows.join(F.broadcast(p) if plan.count() <= max_broadcast else p, rows["source"].eqNullSafe(p["_s"])).withColumn("block", _block(F.col("blocks")))
    before = F.col("last").isNull() | (F.col("block") < F.col("last"))
    within = (F.col("block") == F.col("last")) & (F.struct("key", "n_tokens", "tie") <= F.col("cut"))
    extra = F.when(F.col("rest") < 0, 0).when(before | F.coalesce(within, F.lit(False)), 1).otherwise(0)
    return own.withColumn("copies", (F.col("full") + extra).cast("long")).drop("_s", "blocks", "full", "rest", "last", "cut")


def plan_mix(docs: DataFrame, entropy_share: float = 0.95, max_repeats: float = 4.0, budget: int | None = None, seed: str = "mix", block_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_broadcast: int = 100_000) -> DataFrame:
    """Per row: doc_id, source, n_tokens, block, copies (how often the mix holds the document)."""
    rows = materialize(_placed(docs, seed, id_col, text_col, source_col, F.col(f"`{id_col}`").alias("doc_id")), "tokens")
    plan = _shares(rows, entropy_share, max_repeats, budget, block_docs, max_broadcast)
    return _copies(rows, plan, max_broadcast).select("doc_id", "source", "n_tokens", "block", "copies")


def mix(docs: DataFrame, entropy_share: float = 0.95, max_repeats: float = 4.0, budget: int | None = None, seed: str = "mix", block_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_broadcast: int = 100_000) -> DataFrame:
    """The rows of the mix: docs once an epoch, with epoch (from 1), block_key and place_key.

    Sorting by block_key and then by place_key reads blocks of all sources in one permuted order, each
    permuted inside. Where docs has columns of these names, it keeps them and the new ones begin with
    ``mix_``. Documents meet the plan of their source map-side; no text is shuffled.
    """
    plan = _shares(materialize(_placed(docs, seed, id_col, text_col, source_col), "tokens"), entropy_share, max_repeats, budget, block_docs, max_broadcast)
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = _copies(_placed(docs, seed, id_col, text_col, source_col, whole), plan, max_broadcast).where(F.col("copies") > 0)
    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    hashed = lambda *parts: F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in parts]).cast("binary"))
    new = {"epoch": F.col("epoch"), "block_key": hashed("source", "epoch", "block"), "place_key": hashed("epoch", "key", "tie")}

    def free(name: str) -> str:
        return name if name not in docs.columns else free(f"mix_{name}")

    return epochs.select("row.*", *[c.alias(free(name)) for name, c in new.items()])
