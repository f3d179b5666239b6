"""Small sides are sent to every task whatever Spark believes of their size, and frames see no more games than they hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rimshot.operators import features as FT
from rimshot.operators import models as ML
from rimshot.plans import q_models as QM


@pytest.fixture
def no_hints(spark):
    """What Spark would do if its estimates were large."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    rng = random.Random(5)
    rows = [(2020, None if t == 3 else t, None if g % 37 == 36 else dt.date(2020, 1, 1) + dt.timedelta(days=g // 4), g,
             rng.choice([0, 1, None]), rng.randint(-9, 9)) for t in range(4) for g in range(90 if t else 5)]
    return spark.createDataFrame(rows, "season_start int, team_id long, game_date date, game_id long, is_win int, point_diff int")


def test_sliced_rows_do_not_move_to_meet_their_slices(spark, no_hints):
    spec = {"w3": ("is_win", 3), "d10": ("point_diff", 10), "all": ("point_diff", None)}
    rows = _rows(spark)
    plain, cut = FT.rolling(rows, spec), FT.rolling(rows, spec, slice_rows=7)
    assert "SortMergeJoin" not in _plan(cut)
    show = lambda d: sorted(map(repr, d.select(*rows.columns, *[F.round(c, 9).alias(c) for c in spec]).collect()))
    assert show(cut) == show(plain)


def test_predictions_do_not_move_to_meet_their_temperature(spark, no_hints):
    rng = random.Random(7)
    rows = [(g, int(rng.random() < 0.3 + 0.4 * p), p) for g in ("a", "b") for p in (rng.random() for _ in range(60))]
    fitted = ML.fit_temperature(spark.createDataFrame(rows, "g string, y_true int, y_prob double"), ["g"])
    assert "SortMergeJoin" not in _plan(fitted)
    assert fitted.count() == 2


def test_checkpoint_rows_are_rolled_over_the_games_before_them(spark, monkeypatch):
    sf, seen, rolling = "/root/testdata/sf0.001", [], FT.rolling

    def watched(df, spec, **more):
        seen.append(df.groupBy("season_start", "team_id").count().agg(F.max("count")).first()[0])
        return rolling(df, spec, **more)

    spec = {"d": ("point_diff", None)}
    whole = FT.checkpoint_rows(FT.with_game_number(FT.rolling(QM.base_table(spark, sf), spec)), 2)
    want = {(r.season_start, r.team_id): r.d for r in whole.collect()}
    monkeypatch.setattr(QM.FT, "rolling", watched)
    got = {(r.season_start, r.team_id): r.avg_point_diff_s2d for r in QM.model_table(spark, sf, 2).collect()}
    assert got == pytest.approx(want) and want
    assert seen == [3]
