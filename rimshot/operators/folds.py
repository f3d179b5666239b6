"""Models of all folds at once (L1-L4, L6-L8, L10): rows by fold, Newton steps, boosted trees and forests.

A rolling backtest trains on every earlier season and tests on the next. Here all folds go through one plan: a row is
a training row of every later fold and a test row of its own season's, and ``fold`` is a grouping key like any other.
Preprocessing is fitted by grouped aggregates over (fold, feature). Each pass of a fit is one job for all folds:

- ``fit_logistic``: Newton steps for all (fold, model) pairs from grouped sums of X'WX and X'Wr;
- ``boost``: per level of a tree, grouped histograms (fold, node, feature, bin) of residuals;
- ``forest``: per level, grouped histograms (fold, tree, node, feature, bin) of the Poisson bootstrap; nodes are rows of
  tables and may go as deep as they like.

Histograms are sums of integers, so results do not depend on the order of rows. To the driver come only sums whose
number is bounded by folds, models, features and bins, never rows or the nodes of a forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.operators.ordering import value_counts
from rimshot.operators.selection import quantiles
from rimshot.session import checkpoint_dir

BINS = 256  # cuts at up to 255 quantiles: at every value of a feature with fewer than 256 training rows
FIXED_POINT = 1 << 32  # residuals and curvatures are summed as multiples of 1 / FIXED_POINT
STORE_EVERY = 10  # boosted trees between two stored margins
TASK_ROWS = 20_000  # rows in one task of the learners, whose jobs are many and short
PROBABILITY_SCHEMA = "rid long, fold int, model string, y_prob double"


# --- folds and preprocessing ----------------------------------------------------------------------------------

@dataclass
class Folds:
    """Rows by fold, stored: (rid, fold, test, y, x), ``x`` imputed and scaled on the fold's training rows.

    ``base`` holds each row once with its ``rid``; ``keys`` the group values and test season of each fold; ``share``
    and ``size`` the positive share and the number of its training rows.
    """

    base: DataFrame
    rows: DataFrame
    keys: list[tuple]
    share: list[float]
    size: list[int]
    features: list[str]


def fold_keys(df: DataFrame, season: str, groups: list[str], label: str) -> list[tuple]:
    """(group values..., test season) of the folds whose earlier seasons have both classes, in order."""
    n = df.groupBy(*groups, season).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).collect()
    found = []
    for r in n:
        group = tuple(r[g] for g in groups)
        earlier = [x for x in n if tuple(x[g] for g in groups) == group and x[season] < r[season]]
        if 0 < sum(x["pos"] for x in earlier) < sum(x["n"] for x in earlier):
            found.append((*group, r[season]))
    return sorted(found)


def make_folds(df: DataFrame, features: list[str], label: str, season: str = "season_start", groups: list[str] = ()) -> Folds | None:
    """All folds of a table; rows without a label are left out. Medians (L1) and population standard deviations
    (L2, without centring) are those of a fold's training rows; a feature without any value counts as 0, a constant
    one is divided by 1. None if no fold has both classes in training."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    base = df.where(F.col(label).isNotNull()).withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    # the plan behind a table of few rows may have had very many tasks; the jobs of the fits need no more than its rows do
    base = base.coalesce(1 + base.count() // TASK_ROWS)
    keys = fold_keys(base, season, list(groups), label)
    if not keys:
        return None
    kinds = dict(df.dtypes)
    names = [*[f"_g{i}" for i in range(len(groups))], "_test"]
    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, [*groups, season])) + ", fold int"
    table = F.broadcast(spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], schema))  # one row a fold
    on = F.col(season) <= F.col("_test")
    for g, n in zip(groups, names):
        on = on & (F.col(g) == F.col(n))
    raw = (base.join(table, on).select(
        "rid", "fold", (F.col(season) == F.col("_test")).alias("test"), F.col(label).cast("double").alias("y"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"))).checkpoint()
    train = raw.where(~F.col("test"))
    long = train.select("fold", F.posexplode("x").alias("feature", "value"))
    middle = quantiles(value_counts(long, ["fold", "feature"], "value"), ["fold", "feature"], "value", {"median": 0.5})
    p = len(features)
    med = np.zeros((len(keys), p))
    for r in middle.collect():  # folds x features
        med[r["fold"], r["feature"]] = r["median"]

    def per_fold(values: np.ndarray) -> Column:
        every = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in values])
        return F.get(every, F.col("fold"))

    filled = raw.withColumn("x", F.zip_with("x", per_fold(med), lambda v, m: F.coalesce(v, m)))
    spread = (filled.where(~F.col("test")).select("fold", F.posexplode("x").alias("feature", "value"))
              .groupBy("fold", "feature").agg(F.stddev_pop("value").alias("sd")))
    sd = np.ones((len(keys), p))
    for r in spread.collect():
        if r["sd"] and r["sd"] > 0:
            sd[r["fold"], r["feature"]] = r["sd"]
    rows = filled.withColumn("x", F.zip_with("x", per_fold(sd), lambda v, s: v / s)).checkpoint()
    count = {r["fold"]: r for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()}
    size = [count[i]["n"] for i in range(len(keys))]
    return Folds(base, rows, keys, [count[i]["pos"] / n for i, n in enumerate(size)], size, list(features))


def _balanced(folds: Folds) -> list[tuple[float, float]]:
    """L4: weights of the classes 0 and 1 in each fold: n / (2 * n_class)."""
    return [(0.5 / (1 - s), 0.5 / s) for s in folds.share]


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
            one_task: bool = False) -> np.ndarray:
    """The tasks' partial sums (key, values...; each key once in a task), added by key: an array of keys and sums.
    The sums of a single task need no adding up."""
    names = [c.split()[0] for c in schema.split(", ")]
    total = rows.mapInArrow(partial, schema)
    if not one_task:
        total = total.groupBy("key").agg(*[F.sum(c).alias(c) for c in names[1:]])
    return total.toPandas()[names].to_numpy()


# --- logistic regression --------------------------------------------------------------------------------------

@dataclass
class Logistic:
    """Weights of each (fold, model), the intercept last, and the largest gradient entry there."""

    models: dict[str, list[int]]
    weights: dict[tuple[int, str], np.ndarray]
    gradient: dict[tuple[int, str], float] = field(default_factory=dict)


def _newton_sums(rows: DataFrame, now: Logistic, balanced: list[tuple[float, float]]) -> dict[tuple[int, str], tuple]:
    """For each (fold, model) with weights: (loss, gradient, curvature) of the weighted log loss, summed over rows."""
    names = list(now.models)
    width = max(len(c) for c in now.models.values()) + 1
    span = width * width + width + 1
    order = {k: i for i, k in enumerate(now.weights)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y, x = _column(batch, "fold"), _column(batch, "y"), _matrix(batch, "x")
            for f in np.unique(fold):
                here = fold == f
                t = y[here]
                class_weight = np.where(t == 1, balanced[f][1], balanced[f][0])
                for name in names:
                    if (f, name) not in order:
                        continue
                    w = now.weights[f, name]
                    a = np.hstack([x[here][:, now.models[name]], np.ones((len(t), 1))])
                    z = a @ w
                    p = 1 / (1 + np.exp(-z))
                    loss = (class_weight * (np.logaddexp(0, z) - t * z)).sum()
                    g = a.T @ (class_weight * (p - t))
                    h = (a * (class_weight * p * (1 - p))[:, None]).T @ a
                    out = np.concatenate([[loss], g, h.ravel()])
                    k = order[f, name]
                    sums[k] = sums[k] + out if k in sums else out
        keys = np.concatenate([k * span + np.arange(len(v)) for k, v in sums.items()]) if sums else np.empty(0, np.int64)
        values = np.concatenate(list(sums.values())) if sums else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], ["key", "value"])

    flat = np.zeros(len(order) * span)
    found = _summed(rows, partial, "key long, value double")
    flat[found[:, 0].astype(np.int64)] = found[:, 1]
    out = {}
    for key, k in order.items():
        n = len(now.weights[key])
        part = flat[k * span: (k + 1) * span]
        out[key] = (part[0], part[1: 1 + n], part[1 + n: 1 + n + n * n].reshape(n, n))
    return out


def fit_logistic(folds: Folds, models: dict[str, list[str]], c: float = 1.0, tolerance: float = 1e-8, most_passes: int = 60) -> Logistic:
    """L3 + L8: for every fold and model the minimum of |w|^2 / 2 + C * sum(balanced weight * log loss), the intercept
    free of the penalty. Every pass is one job for all pairs that still move; a step that does not lessen the loss is
    halved."""
    train = folds.rows.where(~F.col("test")).select("fold", "y", "x")
    balanced = _balanced(folds)
    columns = {m: [folds.features.index(f) for f in fs] for m, fs in models.items()}
    done = Logistic(columns, {})
    state = {(f, m): np.zeros(len(cols) + 1) for f in range(len(folds.keys)) for m, cols in columns.items()}
    held: dict[tuple[int, str], tuple[float, np.ndarray, np.ndarray]] = {}  # loss, weights and step where the last step began
    for _ in range(most_passes):
        moving = {}
        for key, (loss, g, h) in _newton_sums(train, Logistic(columns, state), balanced).items():
            w = state[key]
            penalty = np.append(np.ones(len(w) - 1), 0.0)
            loss, g, h = c * loss + (penalty * w * w).sum() / 2, c * g + penalty * w, c * h + np.diag(penalty)
            if key in held and loss > held[key][0] + 1e-12 * abs(loss) and np.abs(held[key][2]).max() > 1e-10:
                before, at, step = held[key]
                held[key] = before, at, step / 2
                moving[key] = at + step / 2
                continue
            done.weights[key], done.gradient[key] = w, float(np.abs(g).max())
            if done.gradient[key] > tolerance * folds.size[key[0]]:
                step = -np.linalg.solve(h + 1e-12 * np.eye(len(w)), g)
                held[key] = loss, w, step
                moving[key] = w + step
        if not moving:
            break
        state = moving
    return done


def score_logistic(folds: Folds, fitted: Logistic) -> DataFrame:
    """(rid, fold, model, y_prob) of every test row under every model of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, fold, x = _column(batch, "rid"), _column(batch, "fold"), _matrix(batch, "x")
            for name, cols in fitted.models.items():
                p = np.empty(len(rid))
                for f in np.unique(fold):
                    here = fold == f
                    w = fitted.weights[f, name]
                    p[here] = 1 / (1 + np.exp(-(x[here][:, cols] @ w[:-1] + w[-1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), pa.array(fold, pa.int32()), pa.array([name] * len(rid)), pa.array(p)], ["rid", "fold", "model", "y_prob"])

    return folds.rows.where("test").select("rid", "fold", "x").mapInArrow(run, PROBABILITY_SCHEMA)


# --- trees ----------------------------------------------------------------------------------------------------

def binned(folds: Folds) -> DataFrame:
    """(rid, fold, test, y, bins): for each feature the number of its fold's cuts below the value. Cuts are quantiles
    of the training rows, so with fewer than ``BINS`` of them every value is a cut."""
    train = folds.rows.where(~F.col("test")).select("fold", F.posexplode("x").alias("feature", "value"))
    qs = [F.lit((k + 1) / BINS) for k in range(BINS - 1)]
    cuts = train.groupBy("fold", "feature").agg(F.array_distinct(F.percentile_approx("value", F.array(*qs), F.lit(100_000))).alias("cuts"))
    # one row a fold: features x bins numbers at most
    every = cuts.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "cuts"))), lambda c: c["cuts"]).alias("cuts"))
    below = F.zip_with("x", "cuts", lambda v, cs: F.size(F.filter(cs, lambda c: c < v)).cast("smallint"))
    rows = folds.rows.join(F.broadcast(every), "fold").select("rid", "fold", "test", "y", below.alias("bins"))
    return rows.repartition(1 + sum(folds.size) // TASK_ROWS).checkpoint()


@dataclass
class Tree:
    """One boosted tree of every fold, nodes numbered as in a heap from 1: a node with feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def node(self, fold: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.ones(len(fold), np.int64)
        for _ in range(levels):
            f = self.feature[fold, at]
            inner = f >= 0
            right = bins[np.arange(len(fold)), np.maximum(f, 0)] > self.cut[fold, at]
            at = np.where(inner, 2 * at + right, at)
        return at


def _histograms(rows: DataFrame, trees: list[Tree], tree: Tree, level: int, p: int, depth: int, one_task: bool) -> np.ndarray:
    """Sums of (residual, curvature, rows) of training rows by (fold, node of ``level``, feature, bin), as rows of
    (key, three integers)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for batch in batches:
            fold, y, bins = _column(batch, "fold"), _column(batch, "y"), _matrix(batch, "bins")
            margin = _column(batch, "margin").copy()
            for t in trees:
                margin += t.value[fold, t.node(fold, bins, depth)]
            at = tree.node(fold, bins, level)
            prob = 1 / (1 + np.exp(-margin))
            r = np.rint((y - prob) * FIXED_POINT).astype(np.int64)
            h = np.rint(prob * (1 - prob) * FIXED_POINT).astype(np.int64)
            open_ = at >= 2 ** level  # rows of finished leaves stay above
            cell = ((fold.astype(np.int64) * 2 ** level + at - 2 ** level)[:, None] * p + np.arange(p)) * BINS + bins
            cell, where = np.unique(cell[open_].ravel(), return_inverse=True)
            total = np.zeros((len(cell), 3), np.int64)
            np.add.at(total, where, np.repeat(np.stack([r, h, np.ones_like(r)], 1)[open_], p, axis=0))
            keys.append(cell)
            sums.append(total)
        cells, where = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_inverse=True)
        total = np.zeros((len(cells), 3), np.int64)
        if keys:
            np.add.at(total, where, np.concatenate(sums))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *[pa.array(total[:, i], pa.int64()) for i in range(3)]],
                                         ["key", "r", "h", "n"])

    return _summed(rows, partial, "key long, r long, h long, n long", one_task)


def split_gain(left_r, left_n, all_r, all_n):
    """Lessening of the squared error of a split, from sums of residuals and numbers of rows."""
    right_r, right_n = all_r - left_r, all_n - left_n
    return left_r * left_r / left_n + right_r * right_r / right_n - all_r * all_r / all_n


def _grow(tree: Tree, cells: np.ndarray, level: int, p: int, depth: int, rate: float) -> np.ndarray:
    """Best splits and leaf values of one level from its cells; the gain of each split by (fold, node)."""
    gains = np.zeros(tree.value.shape)
    if not len(cells):
        return gains
    cells = cells[np.argsort(cells[:, 0], kind="stable")]
    key = cells[:, 0].astype(np.int64)
    group, bin_ = key // BINS, key % BINS
    sums = cells[:, 1:].astype(float) / np.array([FIXED_POINT, FIXED_POINT, 1.0])
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    leaf = lambda r, h: rate * r / h if abs(h) > 1e-150 else 0.0
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(edges, np.append(edges[1:], len(key))):
        f, node = int(group[a]) % p, int(group[a]) // p
        fold, at = node // 2 ** level, 2 ** level + node % 2 ** level
        cum = sums[a:b].cumsum(axis=0)
        total = cum[-1]
        if (fold, at) not in best:
            best[fold, at] = (1e-12, None, total, None)
        if b - a < 2:
            continue
        gain = split_gain(cum[:-1, 0], cum[:-1, 2], total[0], total[2])
        k = int(gain.argmax())
        if gain[k] > best[fold, at][0] * (1 + 1e-9):  # equal gains: the first feature and cut
            best[fold, at] = (gain[k], (f, int(bin_[a + k])), total, cum[k])
    for (fold, at), (gain, split, total, left) in best.items():
        if split is None:
            tree.value[fold, at] = leaf(total[0], total[1])
            continue
        tree.feature[fold, at], tree.cut[fold, at] = split
        gains[fold, at] = gain
        if level == depth - 1:
            tree.value[fold, 2 * at] = leaf(left[0], left[1])
            tree.value[fold, 2 * at + 1] = leaf(total[0] - left[0], total[1] - left[1])
    return gains


def _empty_tree(folds: int, depth: int) -> Tree:
    shape = (folds, 2 ** (depth + 1))
    return Tree(np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape))


def _with_margins(folds: Folds, rows: DataFrame) -> DataFrame:
    """Rows with the log odds of their fold's training rows, which boosting begins with."""
    start = F.array(*[F.lit(math.log(s / (1 - s))) for s in folds.share])
    return rows.withColumn("margin", F.get(start, F.col("fold")))


def root_gains(folds: Folds, rows: DataFrame, depth: int = 3) -> np.ndarray:
    """For each fold the gain of the first boosted tree's root split."""
    p, tree = len(folds.features), _empty_tree(len(folds.keys), depth)
    cells = _histograms(_with_margins(folds, rows).where(~F.col("test")), [], tree, 0, p, depth, False)
    return _grow(tree, cells, 0, p, depth, 1.0)[:, 1]


def boost(folds: Folds, rows: DataFrame, trees: int, depth: int, rate: float) -> DataFrame:
    """Gradient boosting of the log loss in every fold: (rid, fold, model, y_prob) of the test rows.

    ``rows`` are those of ``binned``. A level of a tree is one job for all folds. Margins are added up in the tasks
    and stored every few trees.
    """
    p = len(folds.features)
    state = _with_margins(folds, rows)
    recent: list[Tree] = []

    def moved(df: DataFrame, added: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold, bins = _column(batch, "fold"), _matrix(batch, "bins")
                margin = _column(batch, "margin").copy()
                for t in added:
                    margin += t.value[fold, t.node(fold, bins, depth)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(margin)], batch.schema.names)

        return df.mapInArrow(run, df.schema)

    state = state.checkpoint()
    one_task = state.rdd.getNumPartitions() == 1
    for k in range(trees):
        tree = _empty_tree(len(folds.keys), depth)
        for level in range(depth):
            _grow(tree, _histograms(state.where(~F.col("test")), recent, tree, level, p, depth, one_task), level, p, depth, rate)
        recent = [*recent, tree]
        if len(recent) == STORE_EVERY and k + 1 < trees:
            state, recent = moved(state, recent).checkpoint(), []
    return moved(state.where("test"), recent).select(
        "rid", "fold", F.lit("GradientBoosting").alias("model"), (1 / (1 + F.exp(-F.col("margin")))).alias("y_prob"))


# --- forests --------------------------------------------------------------------------------------------------

#: P(Poisson(1) <= k) for k = 0, 1, ...: how often a row is drawn follows from where its hash lies among these.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def draws(seed: int, *columns: str) -> Column:
    """Poisson(1) draws of a row from the hash of ``columns``."""
    u = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sum((u >= F.lit(q)).cast("int") for q in POISSON)


def forest(folds: Folds, rows: DataFrame, trees: int, min_leaf: int, seed: int = 42, per_split: int | None = None) -> DataFrame:
    """Random forest in every fold: (rid, fold, model, y_prob) of the test rows, the mean over trees of the
    weighted positive share in their leaf.

    Each tree draws every training row a Poisson(1) number of times by its hash, and weighs the classes to equal sums
    within its draw. A node looks at ``per_split`` features (the root of their number) chosen by hash, needs
    ``min_leaf`` drawn rows on both sides of a split, and goes on until its rows are of one class or too few: there
    is no limit of depth. Nodes are named by the way from the root. Test rows walk along with the training rows.
    """
    p = len(folds.features)
    wanted = per_split or max(1, int(math.sqrt(p)))
    tree_keys, node = ["fold", "tree"], ["fold", "tree", "node"]
    drawn = (rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
             .withColumn("k", F.when(F.col("test"), 0).otherwise(draws(seed, "tree", "rid"))).where(F.col("test") | (F.col("k") > 0))
             .select("rid", *tree_keys, F.lit("").alias("node"), "k", (F.col("y") == 1).alias("pos"), "bins"))
    at = drawn.checkpoint()
    pos, neg = F.when(F.col("pos"), F.col("k")).otherwise(0), F.when(F.col("pos"), 0).otherwise(F.col("k"))
    # a class that was not drawn has no rows to weigh
    per_tree = at.where("k > 0").groupBy(*tree_keys).agg(
        F.greatest(F.sum(pos), F.lit(1)).alias("t1"), F.greatest(F.sum(neg), F.lit(1)).alias("t0")).checkpoint()
    weight = lambda n0, n1: n0 / F.col("t0") + n1 / F.col("t1")
    chosen = F.transform(F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda f: F.struct(
        F.xxhash64(F.lit(seed), *node, f).alias("h"), f.alias("f")))), 1, wanted), lambda s: s["f"])
    prior = F.array(*[F.lit(x) for x in folds.share])
    finished = []
    while True:
        train = at.where("k > 0")
        nodes = (train.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.sum(neg).alias("n0"), F.sum(pos).alias("n1"))
                 .join(per_tree, tree_keys))
        open_ = nodes.where(f"n >= {2 * min_leaf} and n0 > 0 and n1 > 0").select(
            *node, F.col("n").alias("an"), F.col("n0").alias("a0"), F.col("n1").alias("a1"), "t0", "t1", F.explode(chosen).alias("f"))
        cells = (train.join(open_, node).groupBy(*node, "f", "an", "a0", "a1", "t0", "t1", F.get("bins", F.col("f")).alias("b"))
                 .agg(F.count(F.lit(1)).alias("n"), F.sum(neg).alias("n0"), F.sum(pos).alias("n1")))
        along = Window.partitionBy(*node, "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        left = cells.select(*node, "f", "b", "an", "a0", "a1", "t0", "t1",
                            *[F.sum(c).over(along).alias(c) for c in ("n", "n0", "n1")])
        score = lambda n0, n1: (n1 / F.col("t1")) * (n1 / F.col("t1")) / weight(n0, n1)
        gain = (score(F.col("n0"), F.col("n1")) + score(F.col("a0") - F.col("n0"), F.col("a1") - F.col("n1"))
                - score(F.col("a0"), F.col("a1")))
        good = left.where(f"n >= {min_leaf} and an - n >= {min_leaf}").withColumn("gain", gain).where("gain > 1e-12")
        best = good.groupBy(*node).agg(F.max_by(F.struct("f", "b"), F.struct("gain", -F.col("f"), -F.col("b"))).alias("s"))
        step = (at.join(best, node, "left")
                .withColumn("side", F.when(F.get("bins", F.col("s.f")) > F.col("s.b"), "R").when(F.col("s").isNotNull(), "L"))
                .drop("s").checkpoint())
        share = nodes.select(*node, (F.col("n1") / F.col("t1") / weight(F.col("n0"), F.col("n1"))).alias("share"))
        # a tree that drew no row at all says what the fold's share says
        ends = (step.where("k = 0 and side is null").select("rid", *node).join(share, node, "left")
                .select("rid", "fold", F.coalesce("share", F.get(prior, F.col("fold"))).alias("share")).checkpoint())
        finished.append(ends)
        at = step.where("side is not null").withColumn("node", F.concat("node", "side")).drop("side")
        if at.isEmpty():
            break
    every = finished[0]
    for f in finished[1:]:
        every = every.unionByName(f)
    return every.groupBy("rid", "fold").agg((F.sum(F.col("share").cast("decimal(20,15)")) / trees).cast("double").alias("y_prob")).select(
        "rid", "fold", F.lit("RandomForest").alias("model"), "y_prob")
