"""Quality by perplexity under a modified Kneser-Ney model of trusted text.

Labelled texts of good quality in folds 1 to 4 train one character n-gram model (see kneserney): its
counts grow with them, and the documents' n-grams are joined to the counts shard by shard. A document
is kept when its perplexity is at most a quantile of the perplexities of trusted texts in its
language that the model never saw, those of fold 0; the quantile is exact.

Defined results: null and empty texts have no characters, perplexity null, and are not kept. A
null language is a language of its own; a language without held-out trusted texts takes the quantile
over all held-out ones. Where all trusted texts fall on one side, they are learnt from and judged by. Without any trusted text everything scorable is kept. Labels that are null or
contradict each other are not trusted. Rows that repeat a doc_id are rows of their own. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melodyspark.llm import kneserney
from melodyspark.llm.scratch import materialize
from melodyspark.llm.toxicity import fold

#: rank error, as a share of all rows, of the approximate quantiles that bracket the exact one
SLACK = 1e-4


def exact_quantile(values: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """Per group: q, the smallest value that at least ``share`` of the group's values do not exceed.

    Approximate quantiles bracket the exact one; values under the bracket are counted, and only those
    inside it, at most some 6 * SLACK of the group, are put in order.
    """
    around = [min(1.0, max(0.0, share + d)) for d in (-3 * SLACK, 3 * SLACK)]
    at = F.percentile_approx(value, F.array(*[F.lit(x) for x in around]), F.lit(int(1 / SLACK)))
    ends = values.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("all"), at.alias("e"))
    bound = values.join(ends, values[group].eqNullSafe(ends["_g"]))
    under = bound.groupBy("_g").agg(F.first("all").alias("all"), F.count_if(F.col(value) < F.col("e")[0]).alias("under"))
    inside = bound.where(F.col(value).between(F.col("e")[0], F.col("e")[1])).groupBy("_g", value).count()
    upto = F.sum("count").over(Window.partitionBy("_g").orderBy(value))
    ranked = inside.withColumn("upto", upto).withColumnRenamed("_g", "_i").join(under, F.col("_i").eqNullSafe(F.col("_g")))
    return ranked.where(F.col("under") + F.col("upto") >= F.ceil(F.col("all") * F.lit(share))).groupBy(F.col("_g").alias(group)).agg(F.min(value).alias("q"))


def perplexity_report(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_label_rows: int = 4_000_000, order: int = kneserney.ORDER, hot: int = kneserney.HOT) -> DataFrame:
    """Per row: doc_id, lang, n_scored, perplexity, threshold of its language, kept."""
    sure = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    good = sure.where(F.col("_q") == 1).select(F.col("doc_id").alias("_id"))
    text = F.col(text_col).cast("string").alias("text")
    held = good.withColumn("label", (fold("_id") == 0).cast("int"))
    known = kneserney.labelled(docs.select(F.col(id_col).alias("_id"), text), held, "_id", "left", max_label_rows)
    counts = materialize(kneserney.gram_counts(known, 2, order), "grams")
    sides = counts.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")).alias("row"), text)
    if not sides["c0"] and not sides["c1"]:
        return rows.select("row.*", F.lit(None).cast("long").alias("n_scored"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("kept"))
    own = "c0" if sides["c0"] else "c1"
    model = kneserney.estimate(counts.select("g", "n", own), [own], order=order)
    model = materialize(model.select("g", "n", F.log(f"q_{own}").alias("logp")), "model")
    scored = kneserney.score(rows, model, ["logp"], order, hot=hot).select("row.*", "n_scored", F.exp(-F.try_divide("logp", "n_scored")).alias("perplexity"))
    scored = materialize(scored, "perplexity")
    judges = good.where(fold("_id") == 0) if sides["c0"] and sides["c1"] else good
    judged = scored.join(judges, scored["doc_id"] == judges["_id"], "left_semi").where(F.col("perplexity").isNotNull())
    judged = materialize(judged.select("lang", "perplexity", F.lit(1).alias("every")), "judges")
    # one row per language: as many rows as languages, small by nature, so left to Spark to broadcast by size
    by_lang = exact_quantile(judged, "lang", "perplexity", quantile).select(F.col("lang").alias("_lang"), F.col("q").alias("_own"))
    overall = exact_quantile(judged, "every", "perplexity", quantile).first()
    out = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["_lang"]), "left")
    threshold = F.coalesce("_own", F.lit(overall["q"] if overall else None).cast("double"))
    return out.select("doc_id", "lang", "n_scored", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
