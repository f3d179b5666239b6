"""Models of all folds at once: logistic fits against MLlib, trees against plain recursive ones, any partitioning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimshot.operators import folds as FD
from rimshot.operators import models as ML

COLS = ["a", "b", "c", "same", "nothing"]
SCHEMA = "checkpoint int, season_start long, team_id long, team_conference string, a double, b double, c int, same double, nothing double, won int"


def _table(seed=1, seasons=5, teams=24):
    rng = random.Random(seed)
    rows = []
    for ck in (20, 40):
        for s in range(2000, 2000 + seasons):
            for t in range(teams):
                a, b, c = rng.gauss(0, 1), round(rng.gauss(0, 2), 1), rng.randint(0, 4)
                won = int(a + 0.4 * b - 0.3 * c + rng.gauss(0, 1) > -0.5)
                rows.append((ck, s, t, "EW"[t % 2], None if rng.random() < 0.1 else a, b, c, 3.0, None, None if rng.random() < 0.03 else won))
    # a first season of one class only: its successor is no fold
    return rows + [(60, 2000 + k, t, "E", 1.0 * t, 0.0, 1, 3.0, None, int(k > 0 and t % 2)) for k in range(3) for t in range(6)]


@pytest.fixture(scope="module")
def folds(spark):
    return FD.make_folds(spark.createDataFrame(_table(), SCHEMA), COLS, "won", groups=["checkpoint"])


def test_folds_and_their_rows(folds):
    assert folds.keys == [*[(c, s) for c in (20, 40) for s in range(2001, 2005)], (60, 2002)]
    rows = _table()
    for i, (ck, season) in enumerate(folds.keys):
        train = [r for r in rows if r[0] == ck and r[1] < season and r[-1] is not None]
        assert folds.size[i] == len(train) and folds.share[i] == pytest.approx(sum(r[-1] for r in train) / len(train))
    got = folds.rows.where("fold = 3").toPandas()
    train = [r for r in rows if r[0] == 20 and r[1] < 2004 and r[-1] is not None]
    a = np.array([np.nan if r[4] is None else r[4] for r in train])
    a = np.where(np.isnan(a), np.nanmedian(a), a)
    x = np.stack(got[~got.test].x)
    assert sorted(x[:, 0]) == pytest.approx(sorted(a / a.std())) and set(x[:, 3]) == {3.0} and set(x[:, 4]) == {0.0}


def test_logistic_fits_equal_single_fits(spark, folds):
    models = {"one": ["a"], "all": COLS}
    fitted = FD.fit_logistic(folds, models)
    assert max(fitted.gradient.values()) < 1e-5
    scored = FD.score_logistic(folds, fitted).join(folds.base.select("rid", "team_id"), "rid").toPandas()
    t = spark.createDataFrame(_table(), SCHEMA).where("won is not null")
    for fold in (2, 7):
        ck, season = folds.keys[fold]
        own = t.where(f"checkpoint = {ck}")
        tr, te = ML.prepare(own.where(f"season_start < {season}"), own.where(f"season_start = {season}"), COLS, "won", center=False, balanced=True)
        for name, cols in models.items():
            want = {r.team_id: r.y_prob for r in ML.score(ML.fit_lr(tr, cols, "won", 1.0, "weight"), te, cols).collect()}
            got = scored[(scored.fold == fold) & (scored.model == name)]
            assert dict(zip(got.team_id, got.y_prob)) == pytest.approx(want, abs=1e-4)


def test_separable_classes_have_a_fit(spark):
    rows = [(2000 + s, t, float(t if t > 5 else t - 100), int(t > 5)) for s in range(2) for t in range(12)]
    f = FD.make_folds(spark.createDataFrame(rows, "season_start long, team_id long, a double, won int"), ["a"], "won")
    fitted = FD.fit_logistic(f, {"m": ["a"]})
    assert max(fitted.gradient.values()) < 1e-6
    p = {r.rid: r.y_prob for r in FD.score_logistic(f, fitted).collect()}
    assert len(p) == 12 and all(0 < v < 1 for v in p.values())


# --- trees in plain Python ------------------------------------------------------------------------------------

def _best(x, r, w, count, least):
    """(gain, feature, value) of the best split of rows with weighted targets ``r * w``; the first of equals."""
    best = (1e-12, None, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if count[left].sum() < least or count[~left].sum() < least:
                continue
            part = lambda m: (w * r)[m].sum() ** 2 / w[m].sum()
            gain = part(left) + part(~left) - (w * r).sum() ** 2 / w.sum()
            if gain > best[0] * (1 + 1e-9) + (1e-12 if best[1] is not None else 0):
                best = (gain, f, v)
    return best


def _boosted(x, y, test, trees, depth, rate):
    z, zt = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), np.full(len(test), math.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        r, h = y - p, p * (1 - p)
        add, add_t = np.zeros(len(y)), np.zeros(len(test))

        def grow(rows, tests, level):
            split = _best(x[rows], r[rows], np.ones(len(rows)), np.ones(len(rows)), 1) if level < depth and len(rows) > 1 else (0, None, None)
            if split[1] is None:
                add[rows] = add_t[tests] = rate * r[rows].sum() / h[rows].sum()
                return
            _, f, v = split
            grow(rows[x[rows, f] <= v], tests[test[tests, f] <= v], level + 1)
            grow(rows[x[rows, f] > v], tests[test[tests, f] > v], level + 1)

        grow(np.arange(len(y)), np.arange(len(test)), 0)
        z, zt = z + add, zt + add_t
    return 1 / (1 + np.exp(-zt))


def _parts(folds, fold):
    d = folds.rows.where(F.col("fold") == fold).orderBy("rid").toPandas()
    return np.stack(d[~d.test].x), d[~d.test].y.to_numpy(), d[~d.test].rid.to_numpy(), np.stack(d[d.test].x), d[d.test].rid.to_numpy()


def test_boosting_equals_plain_trees(folds):
    got = FD.boost(folds, FD.binned(folds), 13, 3, 0.1).toPandas()
    for fold in (1, 6):
        x, y, _, test, rid = _parts(folds, fold)
        mine = got[got.fold == fold].set_index("rid").y_prob
        assert mine.loc[rid].to_numpy() == pytest.approx(_boosted(x, y, test, 13, 3, 0.1), abs=1e-6)


def test_forest_equals_plain_trees(folds):
    trees, least = 6, 3
    rows = FD.binned(folds)
    got = FD.forest(folds, rows, trees, least, seed=9, per_split=len(COLS)).toPandas()
    drawn = rows.where("not test").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(
        "fold", "tree", "rid", FD.draws(9, "tree", "rid").alias("k")).toPandas()
    for fold in (0, 5, 8):
        x, y, train, test, rid = _parts(folds, fold)
        total = np.zeros(len(rid))
        for tree in range(trees):
            k = drawn[(drawn.fold == fold) & (drawn.tree == tree)].set_index("rid").k.loc[train].to_numpy()
            here = k > 0
            xs, ys, ks = x[here], y[here], k[here]
            w = ks / np.where(ys == 1, max(1, ks[ys == 1].sum()), max(1, ks[ys == 0].sum()))

            def walk(rows, tests):
                pure = len(set(ys[rows])) < 2
                _, f, v = (0, None, None) if pure else _best(xs[rows], ys[rows], w[rows], np.ones(len(rows)), least)
                if f is None:
                    total[tests] += (w * ys)[rows].sum() / w[rows].sum()
                    return
                walk(rows[xs[rows, f] <= v], tests[test[tests, f] <= v])
                walk(rows[xs[rows, f] > v], tests[test[tests, f] > v])

            walk(np.arange(len(xs)), np.arange(len(rid)))
        mine = got[got.fold == fold].set_index("rid").y_prob
        assert mine.loc[rid].to_numpy() == pytest.approx(total / trees, abs=1e-9)


def test_trees_do_not_depend_on_the_partitions(folds):
    rows = FD.binned(folds)
    key = ["fold", "rid"]
    for learn in (lambda r: FD.boost(folds, r, 4, 3, 0.1), lambda r: FD.forest(folds, r, 5, 2)):
        one, seven = (learn(rows.repartition(n)).toPandas().sort_values(key).y_prob.tolist() for n in (1, 7))
        assert one == seven


def test_draws_are_poisson(spark):
    d = spark.range(40000).select(FD.draws(1, "id").alias("k")).groupBy("k").count().toPandas().set_index("k")["count"] / 40000
    for k in range(4):
        assert d[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)


def test_deep_trees(spark):
    """Equal shares of the classes in turn along one feature: more levels than thirty, nothing is cut."""
    rows = [(2000, i, float(2 ** min(i, 1000)), i % 2) for i in range(90)] + [(2001, i, float(2 ** min(i, 1000)), i % 2) for i in range(90)]
    f = FD.make_folds(spark.createDataFrame(rows, "season_start long, team_id long, a double, won int"), ["a"], "won")
    got = FD.forest(f, FD.binned(f), 3, 1).toPandas()
    assert len(got) == 90 and set(np.round(got.y_prob * 3)) <= {0, 1, 2, 3}


def test_backtest_of_all_models(spark):
    t = spark.createDataFrame(_table(seasons=3), SCHEMA)
    p = ML.backtest(t, COLS, "won", models=("Baseline_BaseRate", "LogisticRegression"), groups=["checkpoint"])
    assert p.columns == ["checkpoint", "test_season", "team_id", "team_conference", "y_true", "model", "y_prob"]
    tested = t.where("won is not null and ((checkpoint < 60 and season_start > 2000) or season_start = 2002)").count()
    assert p.count() == 2 * tested and p.where("y_prob is null").count() == 0
    none = ML.backtest(t.where("season_start = 2000"), COLS, "won", groups=["checkpoint"])
    assert none.columns == p.columns and none.count() == 0
