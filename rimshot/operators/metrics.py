"""Prediction-quality metrics as grouped aggregates.

Every metric takes a predictions DataFrame with a 0/1 label ``y`` and a
probability ``p`` and a list of grouping columns (the fold: model,
checkpoint, test season, ...). Nothing is collected: each metric is one
groupBy, a two-stage top-k, or a distributed prefix sum over a reduced table.
Sums of scores do not depend on the order of the rows (``functions.exact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions.exact import exact_avg, exact_sum
from rimshot.functions.expressions import FLOAT_EPS, calibration_bin
from rimshot.operators.ordering import keyed_prefix_sums, top_k_per_group
from rimshot.operators.selection import quantiles
from rimshot.session import checkpoint_dir


def _y(y):
    return F.col(y).cast("double")


def auc(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Q1: ROC AUC per group (Mann-Whitney, ties count one half); null when a group has one class.

    The predictions are first reduced to (group, score) -> (positives,
    negatives) with a map-side partial aggregate; the ordered pass then runs
    over distinct scores only, as a distributed prefix sum: AUC = sum(pos * (neg below + neg tied / 2)) / (P * N).
    """
    positive = F.col(y).cast("int") == 1
    c = df.groupBy(*by, p).agg(F.count(F.when(positive, 1)).alias("_npos"), F.count(F.when(~positive, 1)).alias("_nneg"))
    # negatives strictly below each score: a keyed prefix sum (range-partitioned, so one
    # large fold is split across tasks), minus the row's own negatives
    c = keyed_prefix_sums(c, list(by), [p], ["_nneg"])
    c = c.withColumn("_neg_below", (F.col("_s__nneg") - F.col("_nneg")).cast("double"))
    g = c.groupBy(*by).agg(
        F.sum(F.col("_npos") * (F.col("_neg_below") + F.lit(0.5) * F.col("_nneg"))).alias("_u"),
        F.sum("_npos").alias("_P"), F.sum("_nneg").alias("_N"))
    return g.select(*by, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                F.col("_u") / (F.col("_P") * F.col("_N"))).alias("auc"))


def log_loss_expr(y: str = "y_true", p: str = "y_prob", eps: float = FLOAT_EPS):
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1.0 - eps))
    return exact_avg(-(_y(y) * F.ln(q) + (1.0 - _y(y)) * F.ln(1.0 - q)))


def brier_expr(y: str = "y_true", p: str = "y_prob"):
    return exact_avg(F.pow(F.col(p) - _y(y), 2))


def accuracy_expr(y: str = "y_true", p: str = "y_prob", threshold: float = 0.5):
    hit = (F.col(p) >= F.lit(threshold)) == (F.col(y) == 1)
    return F.avg(F.when(hit, 1.0).otherwise(0.0))


def fold_metrics(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Q2-Q4 + Q7 + Q1 per fold: n, mean p, mean y, log loss, Brier, accuracy at 0.5, AUC."""
    m = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), exact_avg(p).alias("mean_p"), F.avg(_y(y)).alias("mean_y"),
        log_loss_expr(y, p).alias("logloss"), brier_expr(y, p).alias("brier"),
        accuracy_expr(y, p).alias("accuracy"))
    return m.join(auc(df, by, y, p), by, "left")


def top_k_hits(df: DataFrame, k: int, by: list[str], group: list[str] | None = None,
               y: str = "y_true", p: str = "y_prob", key: str = "team_id", fixed_divisor: bool = False) -> DataFrame:
    """The k highest probabilities per (fold, group) -> hits, picks, hit rate per fold.

    W9: group = [conference] (a null conference is its own group; a group
    with fewer than k teams yields fewer picks). W10: group = none and the
    rate divides by k (``fixed_divisor``). Ties broken by ``key`` ascending.
    """
    parts = list(by) + list(group or [])
    picked = top_k_per_group(df, parts, [F.desc(p), F.asc(key)], k, "_rk")
    g = picked.groupBy(*by).agg(F.sum(F.col(y).cast("long")).alias("hits"), F.count(F.lit(1)).alias("picks"))
    denom = F.lit(float(k)) if fixed_divisor else F.col("picks").cast("double")
    return g.withColumn("hit_rate", F.col("hits") / denom)


def calibration(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob", n_bins: int = 10,
                keep_empty: bool = False) -> DataFrame:
    """Q5: calibration table per fold: bin (right-closed), n, mean p, actual rate, |gap|. Empty bins are absent, or,
    with ``keep_empty``, have n = 0 and nulls."""
    b = df.withColumn("bin", calibration_bin(F.col(p), n_bins))
    t = b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), exact_avg(p).alias("pred_mean"),
                                  F.avg(_y(y)).alias("actual_rate"))
    if keep_empty:
        every = t.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
        t = every.join(t, [*by, "bin"], "left").fillna(0, subset=["n"])
    return t.withColumn("abs_gap", F.abs(F.col("pred_mean") - F.col("actual_rate")))


def ece(cal: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error from a calibration table, weights n / sum(n) per fold."""
    c = cal.where(F.col("pred_mean").isNotNull() & F.col("actual_rate").isNotNull() & F.col("n").isNotNull())
    w = Window.partitionBy(*by)
    c = c.withColumn("weight", F.col("n") / F.sum("n").over(w))
    return c.groupBy(*by).agg(exact_sum(F.abs(F.col("pred_mean") - F.col("actual_rate")) * F.col("weight")).alias("ece"))


def prediction_summary(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob", digits: int = 3) -> DataFrame:
    """N, actual rate, mean p, exact p10/p50/p90 (linear interpolation), share >= 0.5; half-even rounding."""
    # one pass: everything follows from how often each (label, probability) occurs
    checkpoint_dir(df.sparkSession)
    c = df.groupBy(*by, F.col(p).cast("double").alias("_p"), _y(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    weighted = lambda v: exact_sum(v * F.col("_n")) / F.sum(F.when(v.isNotNull(), F.col("_n")))
    g = c.groupBy(*by).agg(
        F.sum("_n").alias("n"), weighted(F.col("_y")).alias("actual_rate"), weighted(F.col("_p")).alias("mean_p"),
        (F.sum(F.when(F.col("_p") >= 0.5, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("frac_over_05"))
    q = quantiles(c.groupBy(*by, "_p").agg(F.sum("_n").alias("_n")), list(by), "_p", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    g = g.join(q, list(by), "left").select(*by, "n", "actual_rate", "mean_p", "p10", "p50", "p90", "frac_over_05")
    for c in ("actual_rate", "mean_p", "p10", "p50", "p90", "frac_over_05"):
        g = g.withColumn(c, F.bround(F.col(c), digits))
    return g


def threshold_accuracy(df: DataFrame, by: list[str], thresholds=(0.3, 0.5, 0.7),
                       y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Accuracy when predicting 1 for p >= t, for each threshold t."""
    return df.groupBy(*by).agg(*[accuracy_expr(y, p, t).alias(f"acc_at_{str(t).replace('.', '')}")
                                 for t in thresholds])


def backtest_summary(metrics: DataFrame, by: list[str], fold: str, cols: list[str]) -> DataFrame:
    """Over folds: number of folds, mean and sample std of each metric (one fold -> null std)."""
    aggs = [F.countDistinct(fold).alias("folds")]
    for c in cols:
        aggs += [exact_avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return metrics.groupBy(*by).agg(*aggs)


def weighted_means(metrics: DataFrame, by: list[str], weight: str, cols: list[str]) -> DataFrame:
    """sum(metric * n) / sum(n) per group (nulls skipped in numerator and denominator)."""
    aggs = []
    for c in cols:
        w = F.when(F.col(c).isNotNull(), F.col(weight))
        aggs.append((exact_sum(F.col(c) * F.col(weight)) / F.sum(w)).alias(f"{c}_wmean"))
    return metrics.groupBy(*by).agg(*aggs)


def class_report(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob", threshold: float = 0.5) -> DataFrame:
    """Q8: per-class precision, recall, F1 (class 0 and 1) from conditional counts."""
    pred = F.col(p) >= threshold
    actual = F.col(y) == 1
    g = df.groupBy(*by).agg(
        F.sum(F.when(pred & actual, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(pred & ~actual, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred & actual, 1).otherwise(0)).alias("fn"),
        F.sum(F.when(~pred & ~actual, 1).otherwise(0)).alias("tn"))
    rows = []
    for cls, tp, fp, fn in ((1, "tp", "fp", "fn"), (0, "tn", "fn", "fp")):
        prec = F.when(F.col(tp) + F.col(fp) > 0, F.col(tp) / (F.col(tp) + F.col(fp))).otherwise(0.0)
        rec = F.when(F.col(tp) + F.col(fn) > 0, F.col(tp) / (F.col(tp) + F.col(fn))).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        rows.append(g.select(*by, F.lit(cls).alias("cls"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), (F.col(tp) + F.col(fn)).cast("bigint").alias("support")))
    return rows[0].unionByName(rows[1])
