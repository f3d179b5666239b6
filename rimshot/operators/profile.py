"""Feature profiling tables (A8, A10-A15, P12): the numbers behind the reference's EDA plots.

Wide-to-long with ``unpivot`` turns per-column statistics into one grouped
aggregate per statistic family, so adding features adds groups, not passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimshot.functions.exact import exact_sum
from rimshot.operators.ordering import value_counts
from rimshot.operators.selection import quantiles
from rimshot.session import checkpoint_dir

ID_LIKE = ("season", "season_start", "game_id", "team_id", "opp_team_id", "team_game_number", "checkpoint")
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def numeric_features(df: DataFrame, target: str, exclude=ID_LIKE) -> list[str]:
    """Numeric columns that are neither ids nor the target (schema inspection only)."""
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in exclude and c != target]


def long_form(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., feature, value) rows, one per input row and feature, values as double."""
    cast = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(list(keep), cols, "feature", "value")


def base_rates(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Label rate overall, per first key, per both keys (ROLLUP), with a 1-decimal percent (half-even).

    The overall row comes from a global aggregate, so it exists (n = 0, rate null) even for an
    empty input, where a ROLLUP would return nothing."""
    stats = [F.count(F.lit(1)).alias("team_seasons"), F.avg(F.col(label).cast("double")).alias("rate")]
    top = (1 << len(by)) - 1
    g = df.rollup(*by).agg(*stats, F.grouping_id().alias("level")).where(F.col("level") < top)
    overall = df.agg(*stats).select(*[F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in by],
                                    "team_seasons", "rate", F.lit(top).cast("bigint").alias("level"))
    return g.unionByName(overall).withColumn("rate_pct", F.bround(F.col("rate") * 100, 1))


def missingness(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: percent missing per column (one pass), as (feature, missing_pct)."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "missing_frac").select(
        "feature", (F.col("missing_frac") * 100).alias("missing_pct"))


def feature_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature: missing %, distinct values, mean, sample std, min, p01, median, p99, max, flags.

    One pass over the features gives how often each (feature, value) occurs; all statistics follow from that table.
    """
    checkpoint_dir(df.sparkSession)
    c = value_counts(long_form(df, cols), ["feature"], "value").checkpoint()
    known = F.col("value").isNotNull()
    n = F.sum(F.when(known, F.col("_n")))
    basic = c.groupBy("feature").agg(
        (F.sum(F.when(known, 0).otherwise(F.col("_n"))) / F.sum("_n") * 100).alias("missing_pct"),
        F.count("value").alias("n_unique"), (exact_sum(F.col("value") * F.col("_n")) / n).alias("mean"), n.alias("_known"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    # squared distances from the mean, which is known by now, do not cancel
    spread = (c.where(known).join(basic.select("feature", F.col("mean").alias("_mean")), "feature").groupBy("feature")
              .agg(exact_sum(F.col("_n") * F.pow(F.col("value") - F.col("_mean"), 2)).alias("_ss")))
    std = F.when(F.col("_known") > 1, F.sqrt(F.col("_ss") / (F.col("_known") - 1)))
    stats = basic.join(spread, "feature", "left").select("feature", "missing_pct", "n_unique", "mean", std.alias("std"), "min", "max")
    q = quantiles(c, ["feature"], "value", {"p01": 0.01, "median": 0.5, "p99": 0.99})
    a = stats.join(q, "feature", "left")
    return a.select("*", (F.col("n_unique") <= 1).alias("is_constant"),
                    ((F.col("max") > F.col("p99") * 3) & (F.col("p99") != 0)).alias("has_extreme_outliers"))


def std_diff(df: DataFrame, cols: list[str], target: str, min_n: int = 5, top: int = 15) -> DataFrame:
    """(mean | target=1 - mean | target=0) / overall sample std (1 when the std is 0), features with at
    least ``min_n`` non-null values in each class; the ``top`` largest by absolute value."""
    lf = long_form(df, cols, [target])
    y = F.col(target)
    g = lf.groupBy("feature").agg(
        F.count(F.when(y == 1, F.col("value"))).alias("n1"), F.count(F.when(y == 0, F.col("value"))).alias("n0"),
        F.avg(F.when(y == 1, F.col("value"))).alias("mean_playoff"),
        F.avg(F.when(y == 0, F.col("value"))).alias("mean_nonplayoff"),
        F.stddev_samp("value").alias("_sd"))
    sd = F.when(F.col("_sd").isNull() | (F.col("_sd") != 0), F.col("_sd")).otherwise(F.lit(1.0))
    d = (F.col("mean_playoff") - F.col("mean_nonplayoff")) / sd
    r = g.where((F.col("n1") >= min_n) & (F.col("n0") >= min_n)).select(
        "feature", F.abs(d).alias("abs_std_diff"), d.alias("std_diff_signed"), "mean_playoff", "mean_nonplayoff")
    return r.orderBy(F.desc("abs_std_diff"), "feature").limit(top)


class PairMoments:
    """Counts, means and centred products of all pairs of columns over the rows in which both have a value; two of
    these add up without cancellation. ``mean`` and ``square`` at [i, j] are those of column i."""

    def __init__(self, x: np.ndarray):
        known = ~np.isnan(x)
        mask = known.astype(float)
        # distances from a typical value of the column, so that sums of squares stay small
        shift = np.array([c[k].mean() if k.any() else 0.0 for c, k in zip(x.T, known.T)])
        x = np.where(known, x - shift, 0.0)
        self.n = mask.T @ mask
        count = np.maximum(self.n, 1)
        sums = x.T @ mask
        self.mean = shift[:, None] + sums / count
        self.square = (x * x).T @ mask - sums * sums / count
        self.product = x.T @ x - sums * sums.T / count

    def add(self, other: PairMoments) -> None:
        n = self.n + other.n
        share = self.n * other.n / np.maximum(n, 1)
        step = other.mean - self.mean
        self.square += other.square + step * step * share
        self.product += other.product + step * step.T * share
        self.mean += step * other.n / np.maximum(n, 1)
        self.n = n

    def rows(self) -> pa.RecordBatch:
        """One row for each column: the moments of its pairs, of both sides."""
        p = len(self.n)
        parts = [self.n, self.mean, self.mean.T, self.square, self.square.T, self.product]
        lists = [pa.array(list(np.ascontiguousarray(m)), pa.list_(pa.float64())) for m in parts]
        return pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), *lists], _MOMENTS)


_MOMENTS = ["i", "n", "mean", "mean_b", "square", "square_b", "product"]


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows that have both, in one pass for any number of
    columns. Each task sums masked products of whole blocks of rows; a row of the matrix is added up in one group, of
    a row for each task. Null without two rows or without spread."""
    p = len(cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                block = batch.slice(at, 4096)
                m = PairMoments(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in block.columns], axis=1))
                if total is None:
                    total = m
                else:
                    total.add(m)
        if total is not None:
            yield total.rows()

    def added(table: pa.Table) -> pa.Table:
        n, mean, mean_b, square, square_b, product = (np.stack(table.column(c).to_numpy()) for c in _MOMENTS[1:])
        one = [m[0].copy() for m in (n, mean, mean_b, square, square_b, product)]
        for k in range(1, len(n)):
            every = one[0] + n[k]
            share, d, e = one[0] * n[k] / np.maximum(every, 1), mean[k] - one[1], mean_b[k] - one[2]
            one[3] += square[k] + d * d * share
            one[4] += square_b[k] + e * e * share
            one[5] += product[k] + d * e * share
            one[1] += d * n[k] / np.maximum(every, 1)
            one[2] += e * n[k] / np.maximum(every, 1)
            one[0] = every
        spread = np.sqrt(np.maximum(one[3], 0)) * np.sqrt(np.maximum(one[4], 0))
        known = (one[0] > 1) & (spread > 0)
        corr = np.where(known, one[5] / np.where(known, spread, 1), 0.0)
        i = table.column("i")[0].as_py()
        corr[i] = 1.0
        return pa.table({"feature_a": pa.array([cols[i]] * p), "feature_b": pa.array(cols),
                         "corr": pa.array(corr, pa.float64(), mask=~known)})

    values = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    moments = values.mapInArrow(partial, "i int, " + ", ".join(f"{c} array<double>" for c in _MOMENTS[1:]))
    return moments.groupBy("i").applyInArrow(added, "feature_a string, feature_b string, corr double")


def top_corr(corr: DataFrame, cols: list[str], top: int = 10) -> DataFrame:
    """The ``top`` largest absolute correlations of the upper triangle (column order), ties by names."""
    pos = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    up = corr.where(order[F.col("feature_a")] < order[F.col("feature_b")])
    return (up.select("feature_a", "feature_b", F.abs("corr").alias("abs_corr"))
              .where(F.col("abs_corr").isNotNull())
              .orderBy(F.desc("abs_corr"), "feature_a", "feature_b").limit(top))


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """Equal-width histogram per feature between its min and max (the max falls in the last bin)."""
    lf = long_form(df, cols).where(F.col("value").isNotNull())
    rng = lf.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = lf.join(rng, "feature")
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1))) \
         .otherwise(F.lit(0))
    return j.groupBy("feature", b.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def box_by_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Quartiles, min and max per (feature, target class), all from one table of value counts."""
    checkpoint_dir(df.sparkSession)
    c = value_counts(long_form(df, cols, [target]), ["feature", target], "value").checkpoint()
    q = quantiles(c, ["feature", target], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    mm = c.groupBy("feature", target).agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                          F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).alias("n"))
    both = mm.join(q, mm["feature"].eqNullSafe(q["feature"]) & mm[target].eqNullSafe(q[target]), "left")
    return both.select(mm["*"], "q1", "median", "q3")
