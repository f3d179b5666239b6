"""Model training, scoring and evaluation.

Preprocessing is fitted on the training rows only, with aggregates that
return a handful of numbers per feature (median, mean, std, class counts).
Those numbers are applied to train and test as plain column expressions,
so no data is collected. Single models are MLlib estimators. The season
backtest of the checkpoint models fits all folds in one plan (``folds``);
that of the next-game models is a short driver loop over test seasons.
"""

from __future__ import annotations

import math
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions.exact import exact_avg
from rimshot.functions.expressions import CALIBRATION_EPS
from rimshot.functions.shuffles import shuffled
from rimshot.operators import folds as FD
from rimshot.operators import metrics as M
from rimshot.operators.filters import MIN_CALIBRATION_ROWS, MIN_TRAIN_ROWS, enough_rows
from rimshot.operators.ordering import global_row_number, time_split, value_counts
from rimshot.operators.profile import long_form
from rimshot.operators.selection import quantiles
from rimshot.session import checkpoint_dir, stored

# Fixed values.
C_GRID = (0.1, 0.3, 1.0, 3.0, 10.0)
RF_TREES, RF_MIN_LEAF, RF_MAX_DEPTH = 400, 5, 30
GBT_TREES, GBT_DEPTH, GBT_RATE = 100, 3, 0.1
PERM_REPEATS = 30
SEED = 42
FEW_GROUPS = 200_000  # so many groups' temperatures are sent to every task


def medians(train: DataFrame, cols: list[str]) -> dict[str, float]:
    """L1: exact per-feature medians of the training rows (one small row per feature comes back)."""
    q = quantiles(value_counts(long_form(train, cols), ["feature"], "value"), ["feature"], "value", {"median": 0.5})
    found = {r.feature: r.median for r in q.collect()}
    return {c: found.get(c) for c in cols}


def impute(df: DataFrame, med: dict[str, float]) -> DataFrame:
    """Features as doubles with nulls replaced by their medians; a feature without any value becomes the constant
    0, which a fit cannot use (dropping it gives the same model)."""
    return df.withColumns({k: F.coalesce(F.col(k).cast("double"), F.lit(float(v) if v is not None else 0.0)) for k, v in med.items()})


def scaler_stats(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """L2: mean and population std per feature (null when there is no data)."""
    row = train.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]], center: bool) -> DataFrame:
    """L2: centred (next-game models) or uncentred (season models) standard scaling; a constant
    (or empty) feature is divided by 1, as sklearn does."""
    for c, (m, s) in stats.items():
        div = s if s and s > 0 else 1.0
        shifted = (F.col(c) - F.lit(m if m is not None else 0.0)) if center else F.col(c)
        df = df.withColumn(c, shifted / F.lit(div))
    return df


def with_class_weights(train: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """L4: balanced weights n / (2 * n_class), from one grouped count joined back on the label."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = F.sum("_nc").over(Window.partitionBy(F.lit(1)))
    w = counts.select(label, (total / (F.lit(2.0) * F.col("_nc"))).alias(out))
    return train.join(w, label, "left")


def _assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)


def fit_lr(train: DataFrame, cols: list[str], label: str, c: float = 1.0, weight: str | None = None):
    """L3: L2-regularised logistic regression with sklearn's C: regParam = 1 / (C * sum of weights)."""
    tw = train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * float(tw)),
                            elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(_assemble(train, cols))


def fit_rf(train: DataFrame, cols: list[str], label: str, weight: str | None = None):
    """Random forest, 400 trees, min leaf 5, deep trees (MLlib caps depth at 30)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=RF_TREES,
                                minInstancesPerNode=RF_MIN_LEAF, maxDepth=RF_MAX_DEPTH, seed=SEED)
    if weight:
        rf = rf.setWeightCol(weight)
    return rf.fit(_assemble(train, cols))


def fit_gbt(train: DataFrame, cols: list[str], label: str):
    """Gradient-boosted trees with the common library defaults (100 trees, depth 3, rate 0.1)."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=GBT_TREES, maxDepth=GBT_DEPTH,
                        stepSize=GBT_RATE, seed=SEED)
    return gbt.fit(_assemble(train, cols))


def score(model, df: DataFrame, cols: list[str], out: str = "y_prob") -> DataFrame:
    """Probability of class 1 (and the 0.5-threshold label)."""
    s = model.transform(_assemble(df, cols))
    s = s.withColumn(out, vector_to_array(F.col("probability"))[1])
    return s.withColumn("y_pred", (F.col(out) >= 0.5).cast("int")).drop("features", "rawPrediction",
                                                                         "probability", "prediction")


def coefficients(model, cols: list[str]) -> list[tuple[str, float]]:
    """Coefficients on the scaled features, largest magnitude first."""
    return sorted(zip(cols, [float(x) for x in model.coefficients]), key=lambda t: -abs(t[1]))


def prepare(train: DataFrame, test: DataFrame, cols: list[str], label: str, center: bool, balanced: bool):
    """L1 + L2 + L4 fitted on ``train`` and applied to both sides."""
    med = medians(train, cols)
    tr, te = impute(train, med), impute(test, med)
    st = scaler_stats(tr, cols)
    tr, te = scale(tr, st, center), scale(te, st, center)
    if balanced:
        tr = with_class_weights(tr, label)
    return tr, te


def tune_c(train: DataFrame, cols: list[str], label: str, order: list[str], grid=C_GRID, frac: float = 0.8):
    """Time-safe C: fit on the first 80 % (W11), log loss on the last 20 %; smallest loss wins,
    the first C on ties; the model fitted on the 80 % is kept (no refit). Returns (c, model, table)."""
    split = time_split(train, order, frac)
    fit_rows, cal_rows = split.where("split = 'fit'"), split.where("split = 'calib'")
    fit_rows, cal_rows = prepare(fit_rows, cal_rows, cols, label, center=True, balanced=False)
    rows, best = [], None
    for c in grid:
        m = fit_lr(fit_rows, cols, label, c)
        ll = score(m, cal_rows, cols).agg(M.log_loss_expr(label, "y_prob")).first()[0]
        rows.append((float(c), float(ll)))
        if best is None or ll < best[1]:
            best = (c, ll, m)
    return best[0], best[2], rows


#: One-feature-set baselines of the checkpoint backtest (fixed values: names and features).
BASELINES = {
    "Baseline_LR_avg_point_diff_s2d": ["avg_point_diff_s2d"], "Baseline_LR_win_pct_s2d": ["win_pct_s2d"],
    "Baseline_LR_win_pct_s2d_l10": ["win_pct_s2d", "win_pct_l10"], "Baseline_LR_elo_pre": ["elo_pre"],
    "Baseline_LR_net_rtg_s2d": ["net_rtg_s2d"],
    "Baseline_LR_win_pct_s2d_plus_strength": ["win_pct_s2d", "avg_point_diff_s2d", "net_rtg_s2d", "elo_pre"],
}
FOLD_THREADS = 8  # folds are independent jobs; so many run at once
FOLD_ROWS = 32_000_000  # the table's rows times the folds at once are no more than this: a fit caches its fold's rows


def _folds(df: DataFrame, season: str, run, groups: list[str] = ()) -> list:
    """``run(group values, test season, train, test)`` for every season but the first of each group, some at once."""
    found, rows = defaultdict(list), 0
    for r in df.groupBy(*groups, season).agg(F.count(F.lit(1)).alias("_n")).collect():
        found[tuple(r[g] for g in groups)].append(r[season])
        rows += r["_n"]
    todo = []
    for group, seasons in sorted(found.items()):
        own = df
        for g, v in zip(groups, group):
            own = own.where(F.col(g) == F.lit(v))
        todo += [(group, s, own.where(F.col(season) < s), own.where(F.col(season) == s)) for s in sorted(seasons)[1:]]
    with ThreadPoolExecutor(max(1, min(FOLD_THREADS, FOLD_ROWS // max(1, rows)))) as pool:
        return [x for x in pool.map(lambda t: run(*t), todo) if x is not None]


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


TREE_MODELS = ("RandomForest", "GradientBoosting")


def backtest(df: DataFrame, cols: list[str], label: str, season: str = "season_start",
             models=("Baseline_BaseRate", *BASELINES, "LogisticRegression"),
             keep: list[str] = ("team_id", "team_conference"), groups: list[str] = ()) -> DataFrame:
    """Rolling season backtest: train on every earlier season, test on the next one, for each value of
    ``groups`` (the checkpoint).

    Returns one prediction row per (group, model, test season, test row), stored. A baseline runs if its features are
    among ``cols``. Folds without a label of both classes in training are left out. All folds are fitted and scored
    together (``operators.folds``): one Newton fit for all logistic models, one forest, one boosting.
    """
    names = [*groups, season, *keep, label]
    kinds = dict(df.dtypes)
    folds = FD.make_folds(df.select(*names, *[c for c in cols if c not in names]), cols, label, season, list(groups))
    if folds is None:
        schema = ", ".join(f"`{c}` {t}" for c, t in [*[(c, kinds[c]) for c in names], ("model", "string"), ("y_prob", "double")])
        found = df.sparkSession.createDataFrame([], schema)
    else:
        with ThreadPoolExecutor(3) as pool:  # the learners do not depend on each other
            parts = list(pool.map(lambda f: f(), _learners(folds, models)))
        found = _union(parts).join(folds.base.select("rid", *names), "rid").select(*names, "model", "y_prob")
    res = found.withColumnRenamed(label, "y_true").withColumnRenamed(season, "test_season")
    return res.checkpoint(eager=True)         # metrics read the stored predictions


def _learners(folds, models) -> list:
    """Functions that fit and score the wanted models of all folds: (rid, fold, model, y_prob), stored."""
    out = []
    if "Baseline_BaseRate" in models:
        rate = F.get(F.array(*[F.lit(s) for s in folds.share]), F.col("fold"))
        out.append(lambda: folds.rows.where("test").select("rid", "fold", F.lit("Baseline_BaseRate").alias("model"), rate.alias("y_prob")))
    linear = {m: fs for m, fs in BASELINES.items() if m in models and set(fs) <= set(folds.features)}
    if "LogisticRegression" in models:
        linear["LogisticRegression"] = folds.features
    if linear:
        out.append(lambda: FD.score_logistic(folds, FD.fit_logistic(folds, linear)).checkpoint())
    if set(TREE_MODELS) & set(models):
        rows = FD.binned(folds)
        if "GradientBoosting" in models:
            out.append(lambda: FD.boost(folds, rows, GBT_TREES, GBT_DEPTH, GBT_RATE).checkpoint())
        if "RandomForest" in models:
            tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row for each tree follows
            out.append(lambda: FD.forest(folds, rows.repartition(tasks), RF_TREES, RF_MIN_LEAF, SEED).checkpoint())
    return out


def next_game_rows(df: DataFrame, sets: dict[str, list[str]], label: str = "home_win", season: str = "season_start") -> DataFrame:
    """What ``next_game_backtest`` reads of a table: games with a label, their keys and the sets' features, nulls as 0."""
    features = sorted({f for fs in sets.values() for f in fs})
    return df.where(F.col(label).isNotNull()).fillna(0.0, subset=features).select(season, "game_date", "game_id", label, *features)


def next_game_backtest(df: DataFrame, sets: dict[str, list[str]], label: str = "home_win", season: str = "season_start",
                       c: float = 1.0, min_train: int = MIN_TRAIN_ROWS, min_calibration: int = MIN_CALIBRATION_ROWS) -> DataFrame:
    """Rolling next-game backtest of feature sets: for each test season, fit on the first 80 % of all
    earlier games (centred scaling, L2), calibrate a temperature on the last 20 %, score the season.

    A fold needs ``min_train`` training games (F6); the temperature needs ``min_calibration`` games, else T is null
    and the raw probabilities count. Rows: (model, test_season, game_id, y_true, y_prob_raw, y_prob, temperature).

    ``df`` should be stored: all folds read it, and no fold stores its games again (one has nearly all of them).
    """
    checkpoint_dir(df.sparkSession)
    features = sorted({f for fs in sets.values() for f in fs})
    df = next_game_rows(df, sets, label, season)

    def run(_, s, train, test):
        if not enough_rows(train, min_train) or test.isEmpty():
            return None
        split = time_split(train, ["game_date", "game_id"], 0.8, is_stored=True)
        fit_rows, cal = split.where("split = 'fit'").drop("split"), split.where("split = 'calib'").drop("split")
        calibrate = enough_rows(cal, min_calibration)
        stats = scaler_stats(fit_rows, features)
        fit_s, cal_s, test_s = (scale(x, stats, True) for x in (fit_rows, cal, test))
        out = []
        for name, feats in sets.items():
            m = fit_lr(fit_s, feats, label, c)
            t = None
            if calibrate:
                one = score(m, cal_s, feats).select(F.lit(0).alias("fold"), F.col(label).alias("y_true"), "y_prob")
                t = fit_temperature(one, ["fold"]).first()["temperature"]
            p = F.least(F.greatest(F.col("y_prob"), F.lit(CALIBRATION_EPS)), F.lit(1 - CALIBRATION_EPS))
            cooled = F.lit(1.0) / (1 + F.exp(-F.ln(p / (1 - p)) / F.lit(float(t)))) if t is not None else F.col("y_prob")
            out.append(score(m, test_s, feats).select(
                F.lit(name).alias("model"), F.col(season).alias("test_season"), "game_id", F.col(label).alias("y_true"),
                F.col("y_prob").alias("y_prob_raw"), cooled.alias("y_prob"), F.lit(t).cast("double").alias("temperature")))
        return _union(out)

    res = _union(_folds(df, season, run))
    if res is None:
        res = df.sparkSession.createDataFrame([], "model string, test_season long, game_id long, y_true int, y_prob_raw double, "
                                                  "y_prob double, temperature double")
    return stored(res)


def permuted(test: DataFrame, cols: list[str], key: str, repeats: int = PERM_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of ``test`` once for each column and repeat (``_feature``, ``_rep``), with that column's values shuffled
    across all rows. Which row's value takes a row's place is arithmetic on its number in the order of ``key``
    (``functions.shuffles``), so nothing is sorted again, however many repeats there are."""
    checkpoint_dir(test.sparkSession)
    t = global_row_number(test, [key], out="_rn").checkpoint()
    n = t.count()
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("_feature")) for i, c in enumerate(cols)])
    reps = t.withColumn("_f", F.explode(each)).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    number = F.col("_f.i") * repeats + F.col("_rep") + F.lit(seed % 1000) * 1_000_003 % 999_983
    reps = reps.withColumns({"_feature": F.col("_f._feature"), "_src": shuffled(F.col("_rn") - 1, n, number) + 1}).drop("_f")
    values = long_form(t, cols, ["_rn"]).select(F.col("_rn").alias("_src"), F.col("feature").alias("_feature"), F.col("value").alias("_pv"))
    rows = reps.join(values, ["_src", "_feature"])
    return rows.select(*[F.when(F.col("_feature") == c, F.col("_pv")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                         for c in test.columns], "_feature", "_rep")


def permutation_importance(model, test: DataFrame, cols: list[str], label: str, key: str,
                           repeats: int = PERM_REPEATS, seed: int = SEED) -> DataFrame:
    """AUC drop when one feature's values are shuffled across the test rows, ``repeats`` times: all replicas are
    scored in one pass, and AUC is computed per (feature, repeat). Mean and population std of the drop per feature."""
    rows = permuted(test, cols, key, repeats, seed)
    base = M.auc(score(model, test, cols).withColumn("_g", F.lit(0)), ["_g"], label, "y_prob").select(F.col("auc").alias("_base"))
    a = M.auc(score(model, rows, cols), ["_feature", "_rep"], label, "y_prob")
    return importance(a.crossJoin(base))


def importance(aucs: DataFrame) -> DataFrame:
    """Mean and population std over the repeats of (_feature, _rep, auc, _base: the AUC without a shuffle)."""
    drop = F.col("_base") - F.col("auc")
    return aucs.groupBy(F.col("_feature").alias("feature")).agg(
        exact_avg(drop).alias("perm_importance_mean"), F.stddev_pop(drop).alias("perm_importance_std"))


def fit_temperature(preds: DataFrame, by: list[str], y: str = "y_true", p: str = "y_prob",
                    most_steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """Temperature T > 0 minimising the mean NLL of sigmoid(logit(p) / T) per group; T is not bounded.

    The NLL is convex in 1/T. Every step sums gradient and curvature per group and moves log(1/T) by a Newton step
    of at most 1, so the range widens until the optimum is inside. Where predictions say nothing about the label
    (the slope at 1/T = 0 is not negative) T is infinite and the NLL ln 2. Probabilities are clipped to [1e-6, 1 - 1e-6]; NLL adds 1e-15 inside
    the logs. One pass over the predictions a step; a group's state is one row.
    """
    checkpoint_dir(preds.sparkSession)
    q = F.least(F.greatest(F.col(p), F.lit(CALIBRATION_EPS)), F.lit(1 - CALIBRATION_EPS))
    z = preds.select(*by, F.col(y).cast("double").alias("_y"), F.ln(q / (1 - q)).alias("_z")).dropna().checkpoint()
    begun = z.groupBy(*by).agg(F.lit(0.0).alias("_u"), F.avg((0.5 - F.col("_y")) * F.col("_z")).alias("_s")).checkpoint()
    state = begun.where("_s < 0").drop("_s")
    small = F.broadcast if begun.count() <= FEW_GROUPS else (lambda d: d)  # the predictions need not move to meet the groups

    def sums(state: DataFrame) -> DataFrame:
        pt = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z") * F.exp("_u")))
        ll = -(F.col("_y") * F.ln(pt + F.lit(1e-15)) + (1 - F.col("_y")) * F.ln(1 - pt + F.lit(1e-15)))
        return z.join(small(state), list(by)).groupBy(*by, "_u").agg(
            F.avg(ll).alias("nll"), F.avg((pt - F.col("_y")) * F.col("_z")).alias("_g"),
            F.avg(pt * (1 - pt) * F.col("_z") * F.col("_z")).alias("_h"))

    for _ in range(most_steps):
        b = F.exp("_u")
        # slope and curvature in u = log(1/T); where the curvature is not positive the slope's sign gives the step
        slope, bend = F.col("_g") * b, F.col("_h") * b * b + F.col("_g") * b
        step = F.when(bend > 0, -slope / bend).otherwise(-F.signum(slope))
        step = F.when(F.abs(slope) < tolerance, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
        moved = sums(state).select(*by, (F.col("_u") + step).alias("_u"), F.abs(step).alias("_step")).checkpoint()
        state = moved.drop("_step")
        if (moved.agg(F.max("_step")).first()[0] or 0.0) < tolerance:
            break
    flat = begun.where("_s >= 0").select(*by, F.lit(float("inf")).alias("temperature"), F.lit(math.log(2)).alias("nll"))
    return sums(state).select(*by, F.exp(-F.col("_u")).alias("temperature"), "nll").unionByName(flat)
