"""Model evaluation as aggregates over (label, prediction, score) frames
(M23-M25, M28, M30-M32).  None of them collects predictions: every metric is
one or two grouped aggregates whose size is bounded by the number of classes
or distinct scores, and ranks come from the distributed prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.stats import attach, prefix_sums, q
from tablelab.session import cut_lineage


def regression_metrics(df: DataFrame, label: str, pred: str, digits: int = 4) -> DataFrame:
    """R2, MAE, RMSE (rounded to ``digits``)."""
    y, p = q(label).cast("double"), q(pred).cast("double")
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("ss_res"),
               F.var_pop(y).alias("vy"), F.avg(F.abs(y - p)).alias("mae"))
    r2 = 1 - F.col("ss_res") / F.nullif(F.col("vy") * F.col("n"), F.lit(0.0))
    return a.select(F.round(r2, digits).alias("r2"), F.round("mae", digits).alias("mae"),
                    F.round(F.sqrt(F.col("ss_res") / F.col("n")), digits).alias("rmse"))


def r2_by(df: DataFrame, group: str, label: str, preds: list[str], digits: int = 4) -> DataFrame:
    """R2 of many prediction columns within every group, in one aggregate."""
    y = q(label).cast("double")
    a = df.groupBy(q(group)).agg((F.var_pop(y) * F.count(F.lit(1))).alias("__all"),
                                 *[F.sum((y - q(p)) * (y - q(p))).alias(p) for p in preds])
    return a.select(group, *[F.round(1 - q(p) / F.nullif("__all", F.lit(0.0)), digits).alias(p) for p in preds])


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted, count) -- k x k cells at most."""
    return df.groupBy(q(label).cast("string").alias("actual"), q(pred).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).cast("long").alias("count"))


def classification_metrics(df: DataFrame, label: str, pred: str, digits: int = 4) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (0 where a
    class is never predicted).  Computed from the confusion cells."""
    cells = confusion(df, label, pred)
    tp = cells.where(F.col("actual") == F.col("predicted")).groupBy(F.col("actual").alias("cls")).agg(
        F.sum("count").alias("tp"))
    sup = cells.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    prd = cells.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("npred"))
    per = sup.join(prd, "cls", "full").join(tp, "cls", "left").na.fill(0, ["tp", "support", "npred"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    agg = per.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"),
                  F.sum(prec * F.col("support")).alias("wp"), F.sum(rec * F.col("support")).alias("wr"),
                  F.sum(f1 * F.col("support")).alias("wf"))
    return agg.select(F.round(F.col("tp") / F.col("n"), digits).alias("accuracy"),
                      F.round(F.col("wf") / F.col("n"), digits).alias("f1"),
                      F.round(F.col("wp") / F.col("n"), digits).alias("precision"),
                      F.round(F.col("wr") / F.col("n"), digits).alias("recall"))


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    is_pos = (q(label) == F.lit(positive)).cast("long")
    return df.where(q(score).isNotNull()).groupBy(F.lit("s").alias("g"), q(score).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(is_pos).alias("pos"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1, digits: int = 4) -> DataFrame:
    """M25 (binary): rank-sum AUC with tie-averaged ranks, exact.
    AUC = (sum of positive ranks - P(P+1)/2) / (P N)."""
    return _rank_sums(_score_counts(df, label, score, positive), [], digits)


def _rank_sums(counts: DataFrame, by: list[str], digits: int) -> DataFrame:
    """AUC of every group ``g`` of (g, x, cnt, pos) counts, which are made once for all their readers."""
    sc = prefix_sums(cut_lineage(counts), "g", "x", ("cnt",))
    avg_rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    a = sc.groupBy(*by).agg(F.sum(F.col("pos") * avg_rank).alias("rs"), F.sum("pos").alias("P"),
                            (F.sum("cnt") - F.sum("pos")).alias("N"))
    auc = (F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0) / F.nullif(F.col("P") * F.col("N"), F.lit(0))
    return a.select(*by, F.round(auc, digits).alias("roc_auc"), F.col("P").cast("long").alias("n_pos"),
                    F.col("N").cast("long").alias("n_neg"))


def roc_auc_ovr(df: DataFrame, label: str, prob_cols: dict, digits: int = 4) -> DataFrame:
    """M25 (multiclass): one-vs-rest AUC per class weighted by support.
    ``prob_cols`` maps class value -> probability column."""
    each = F.explode(F.array(*[F.struct(F.lit(str(cls)).alias("g"), q(col).cast("double").alias("x"),
                                        (q(label) == F.lit(cls)).cast("long").alias("pos")) for cls, col in prob_cols.items()]))
    counts = df.select(each.alias("s")).select("s.*").where(F.col("x").isNotNull()).groupBy("g", "x").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("pos").alias("pos"))
    u = _rank_sums(counts, ["g"], 12)
    return u.agg(F.round(F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos"), digits).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str, score: str, positive=1, digits: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from the highest
    threshold down, plus the (inf, 0, 0) start.  Running sums come from
    :func:`prefix_sums` on the negated score (no global window)."""
    sc = _score_counts(df, label, score, positive).withColumn("x", -F.col("x"))
    sc = sc.withColumn("neg", F.col("cnt") - F.col("pos"))
    run = prefix_sums(sc, "g", "x", ("pos", "neg"))
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = attach(run, tot).select(
        (-F.col("x")).alias("threshold"),
        F.round((F.col("neg_before") + F.col("neg")) / F.nullif(F.col("N"), F.lit(0)), digits).alias("fpr"),
        F.round((F.col("pos_before") + F.col("pos")) / F.nullif(F.col("P"), F.lit(0)), digits).alias("tpr"))
    start = df.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def residual_analysis(df: DataFrame, label: str, pred: str, bins: int = 35) -> DataFrame:
    """Residual histogram (density) with the normal curve of the
    residuals' mean and population std at each bin centre."""
    from tablelab.operators.eda import histogram
    res = df.select((q(label).cast("double") - q(pred).cast("double")).alias("residual"))
    h = histogram(res, ["residual"], bins)
    st = res.agg(F.avg("residual").alias("mu"), F.stddev_pop("residual").alias("sd"))
    mid = (F.col("lo") + F.col("hi")) / 2
    z = (mid - F.col("mu")) / F.col("sd")
    return attach(h, st).select(
        "bin", "lo", "hi", "cnt", "density",
        F.round(F.exp(-0.5 * z * z) / (F.col("sd") * math.sqrt(2 * math.pi)), 6).alias("normal_pdf"),
        F.round("mu", 6).alias("mean"), F.round("sd", 6).alias("std_pop"))


def prediction_sample(df: DataFrame, key: list[str], label: str, pred: str, n: int = 50) -> DataFrame:
    """The first n (actual, predicted) pairs by key (distributed top-n)."""
    return df.orderBy(*[q(k) for k in key]).limit(n).select(
        *[q(k) for k in key], q(label).alias("actual"), q(pred).alias("predicted"))
