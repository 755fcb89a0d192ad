"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary labelled texts each give character n-gram counts of their own (see kneserney); both
back off to the same shortest n-grams, counted over both, so an expression too rare in one class is
smoothed by what all texts have. A toxic text is ordinary but for some expressions: its likelihood is
that of the ordinary model with a ``share`` of the toxic one mixed in at every character; with a share of 1 it is
that of the toxic model itself, which tells texts that differ throughout. A document's evidence is the difference of its toxic and ordinary log-likelihoods,
each divided by its length. The evidence of labelled rows that no model was trained on is collected in a histogram of fixed size for each share;
the smallest share that ranks these rows as well as the best one does, within one standard error, is taken, and a rising logistic curve, fitted under the assumption that some labels are wrong, turns its evidence into a score from 0 to 1.

Defined results: null and empty texts have no evidence and get the score of evidence 0. Labels
that are null, contradict each other or have no document are not learnt from. Where folds 1 to 3 lack texts of a class, fold 4 is
learnt from too. Without texts of both classes outside fold 0 every score is 0. Labels, language, source and id are never inputs of a score. Rows that repeat a doc_id are rows of
their own. Extra columns are never read and, by ``drop_toxic``, passed through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melodyspark.llm import kneserney
from melodyspark.llm.scratch import materialize, same_row, without

#: how many of the shortest orders the classes share
SHARED = 2
#: the toxic model's share in the likelihood of toxic text: fold 4 tells which of these
SHARES = (0.002, 0.1, 1.0)
#: histogram of evidence: bins of this width, from -LIMIT to LIMIT
BIN, LIMIT = 0.0001, 2.0
#: the curve where none can be fitted
UNFITTED = (100.0, -1.0, 0.0, 1.0)


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The fold of a document: crc32 of its id as text. Fold 0 is held out from all learning."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def _ranking(bins: list) -> float:
    """How often a row of label 1 has more evidence than one of label 0, ties by half, from a histogram of evidence."""
    table = np.array(sorted((r["bin"], r["pos"], r["neg"]) for r in bins), float).reshape(-1, 3)
    pos, neg = table[:, 1], table[:, 2]
    if pos.sum() == 0 or neg.sum() == 0:
        return 0.5
    return float(pos @ (np.cumsum(neg) - neg / 2) / pos.sum() / neg.sum())


def _curve(bins: list) -> tuple[float, float, float, float]:
    """a, b, low, high of p(label 1) = low + (high - low) / (1 + exp(-(a x + b))), from a histogram of evidence.

    Labels may be wrong at any evidence: 1 - high and low are the shares of wrong labels of either kind,
    found with the curve by expectation and maximisation, so that they do not flatten it. The curve never falls:
    where these rows contradict the models, or have one label only, a fixed one keeps the models' order.
    """
    x = np.array([r["bin"] * BIN for r in bins])
    pos, neg = np.array([float(r["pos"]) for r in bins]), np.array([float(r["neg"]) for r in bins])
    if pos.sum() == 0 or neg.sum() == 0:
        return UNFITTED
    n = pos + neg
    scale = max(float(np.sqrt(np.average(x**2, weights=n))), 1e-6)
    z = np.stack([x / scale, np.ones_like(x)])
    w, low, high = np.zeros(2), 0.01, 0.99
    # the first guess: evidence above its mean in label 1 is toxic
    true = n * (x > np.average(x, weights=pos + 1e-9))
    for _ in range(200):
        old = w.copy()
        for _ in range(8):
            p = 1 / (1 + np.exp(-np.clip(w @ z, -35, 35)))
            step = np.linalg.solve((z * (n * p * (1 - p))) @ z.T + 1e-2 * np.eye(2), z @ (true - n * p) - 1e-2 * w)
            w = w + np.clip(step, -5, 5)
        p = 1 / (1 + np.exp(-np.clip(w @ z, -35, 35)))
        of_pos = pos * p * high / np.maximum(p * high + (1 - p) * low, 1e-12)
        of_neg = neg * p * (1 - high) / np.maximum(p * (1 - high) + (1 - p) * (1 - low), 1e-12)
        true = of_pos + of_neg
        high = float(np.clip((of_pos.sum() + 1) / (true.sum() + 1.01), 0.6, 1 - 1e-6))
        low = float(np.clip((pos.sum() - of_pos.sum() + 0.01) / (n.sum() - true.sum() + 1), 1e-6, 0.4))
        if np.abs(w - old).max() < 1e-6:
            break
    if w[0] <= 0:
        return UNFITTED
    return float(w[0] / scale), float(w[1]), low, high


def evidence(docs: DataFrame, labels: DataFrame, row: Column, id_col: str, text_col: str, max_label_rows: int, order: int, hot: int) -> DataFrame | None:
    """row, n_scored and e0 .. (evidence under each of ``SHARES``) of ``docs``, learnt from all ``labels``; None if a class has no text."""
    text = F.col(text_col).cast("string").alias("text")
    train = labels.select("_id", F.col("_toxic").alias("label"))
    known = kneserney.labelled(docs.select(F.col(id_col).alias("_id"), text), train, "_id", "left", max_label_rows)
    counts = materialize(kneserney.gram_counts(known, 2, order, lower=True), "grams")
    sides = counts.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    if not sides["c0"] or not sides["c1"]:
        return None
    model = kneserney.estimate(counts, ["c0", "c1"], SHARED, order)
    names = [f"e{k}" for k in range(len(SHARES))]
    ratios = [F.log(s * F.col("q_c1") + (1 - s) * F.col("q_c0")) - F.log("q_c0") for s in SHARES]
    model = materialize(model.select("g", "n", *[r.alias(c) for r, c in zip(ratios, names, strict=True)]), "model")
    scored = kneserney.score(docs.select(row.alias("row"), text), model, names, order, lower=True, hot=hot)
    return scored.select("row", "n_scored", *[F.coalesce(F.try_divide(c, "n_scored"), F.lit(0.0)).alias(c) for c in names])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_label_rows: int = 4_000_000, order: int = kneserney.ORDER, hot: int = kneserney.HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, k1 and k2 (hashes of id and text), evidence and score.

    Models learn from folds 1 to 3 of the labelled rows, share and curve from fold 4, nothing from fold 0.
    """
    k1, k2 = same_row(F.col(id_col), F.col(text_col).cast("string"))
    row = F.struct(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    clean = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("_toxic"), F.max("toxic").alias("_most"))
    clean = clean.where((F.col("_toxic") == F.col("_most")) & (fold("doc_id") != 0)).select(F.col("doc_id").alias("_id"), "_toxic")
    fitted = fold("_id") == 4
    found = evidence(docs, clean.where(~fitted), row, id_col, text_col, max_label_rows, order, hot)
    if found is None:
        # too few rows to set a fold aside
        found = evidence(docs, clean, row, id_col, text_col, max_label_rows, order, hot)
        clean = clean.where("false")
    if found is None:
        return docs.select(row.alias("row")).select("row.*", F.lit(0.0).alias("evidence"), F.lit(0.0).alias("score"))
    found = materialize(found.select("row.*", *[f"e{k}" for k in range(len(SHARES))]), "evidence")
    fit = found.join(clean.where(fitted), F.col("doc_id") == F.col("_id"))
    bins = [F.rint(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col(f"e{k}"))) / BIN).cast("int") for k in range(len(SHARES))]
    binned = fit.select("_toxic", F.posexplode(F.array(*bins)).alias("share", "bin")).groupBy("share", "bin")
    rows = binned.agg(F.sum("_toxic").alias("pos"), F.sum(1 - F.col("_toxic")).alias("neg")).collect()
    of = [[r for r in rows if r["share"] == k] for k in range(len(SHARES))]
    ranked = [_ranking(x) for x in of]
    error = np.sqrt(max(ranked) * (1 - max(ranked)) / max(1, min(sum(r[c] for r in of[0]) for c in ("pos", "neg"))))
    taken = next(k for k, x in enumerate(ranked) if x >= max(ranked) - error)
    a, b, low, high = _curve(of[taken])
    found = found.select("doc_id", "k1", "k2", F.col(f"e{taken}").alias("evidence"))
    return found.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) * F.col("evidence") + F.lit(b)))) * F.lit(high - low) + F.lit(low))


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence."""
    out = score_toxicity(docs, labels, id_col, text_col, **params)
    held = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000, **params: int) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns.

    The keys of rejected rows are broadcast up to ``max_broadcast`` of them and shuffled beyond.
    """
    gone = score_toxicity(docs, labels, id_col, text_col, **params).where(F.col("score") >= threshold)
    return without(docs, gone, id_col, text_col, max_broadcast)
