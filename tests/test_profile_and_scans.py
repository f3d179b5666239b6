"""Correlation by masked moments, the season scan, ordered inserts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimshot.operators import merge as U
from rimshot.operators import profile as P
from rimshot.sources.tables import season_scan


def _pairwise(x):
    p = x.shape[1]
    out = {}
    for i in range(p):
        for j in range(p):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            ok = both.sum() > 1 and a.std() > 0 and b.std() > 0
            out[i, j] = (1.0 if i == j else np.corrcoef(a, b)[0, 1]) if ok else None
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_correlations_with_gaps(spark, parts):
    rng = np.random.default_rng(parts)
    x = rng.normal(size=(700, 6))
    x[:, 1] += 1e9 + x[:, 0]          # a great mean: products must not cancel
    x[:, 2] = x[:, 0] * 3
    x[:, 3] = 4.0
    x[:, 4] = np.nan
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = np.nan
    cols = list("abcdef")
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols)).repartition(parts)
    got = {(cols.index(r.feature_a), cols.index(r.feature_b)): r["corr"] for r in P.corr_matrix(df, cols).collect()}
    want = _pairwise(x)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-6), k


def test_correlations_of_many_columns_take_one_pass(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 300))
    cols = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in cols))
    m = P.corr_matrix(df, cols)
    assert m._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.feature_a, r.feature_b): r["corr"] for r in m.where("feature_a in ('c0', 'c7')").collect()}
    assert len(got) == 600 and got["c0", "c7"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 7])[0, 1])
    assert P.corr_matrix(df.where("c0 > 99"), cols).count() == 0


def test_season_scan_reads_a_part(spark, tmp_path):
    rng = random.Random(1)
    rows = [(g, f"2020-01-{1 + g % 28:02d}", 2000 + g % 5, g % 30, (g + 1) % 30, g % 2, rng.random(), rng.random()) for g in range(100)]
    schema = "game_id long, game_date string, season_start int, home_team_id long, away_team_id long, home_win int, f1 double, f2 double"
    path = str(tmp_path / "view")
    spark.createDataFrame(rows, schema).write.partitionBy("season_start").parquet(path)
    train, test = season_scan(spark, path, 2003, ["f1"])
    assert {r.game_id for r in train.collect()} == {r[0] for r in rows if r[2] < 2003}
    assert {r.game_id for r in test.collect()} == {r[0] for r in rows if r[2] == 2003}
    assert train.columns == ["game_id", "game_date", "season_start", "home_team_id", "away_team_id", "home_win", "f1"]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_start" in plan and "f2" not in plan
    assert season_scan(spark, path, 1990, ["f1"])[0].count() == 0


def test_insert_needs_an_order(spark):
    t = spark.createDataFrame([(1, "a")], "k long, v string")
    s = spark.createDataFrame([(2, "b", 2), (2, "c", 1), (2, "d", 1)], "k long, v string, seq int")
    assert sorted(map(tuple, U.insert_ignore(t, s, ["k"], ["seq"]).collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        U.insert_ignore(t, s, ["k"], [])
    assert sorted(map(tuple, U.insert_ignore(t, s, ["k"], [F.desc("seq")]).collect())) == [(1, "a"), (2, "b")]
