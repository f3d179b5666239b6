"""What jobs leave on disk, and for how long (findings of round 4)."""

import datetime as dt
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from rimshot import session as S
from rimshot.operators import models as ML
from rimshot.plans.catalog import queries


def _jobs(spark):
    """Folders of jobs under the checkpoint folder."""
    folder = S.checkpoint_dir(spark).removeprefix("file:")
    return glob.glob(os.path.join(folder, "job-*"))


@pytest.fixture
def checkpointed(spark, monkeypatch):
    """The columns of every frame that is checkpointed."""
    found, kind = [], type(spark.range(1))
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a, **k: found.append(set(df.columns)) or real(df, *a, **k))
    return found


def test_stored_frames_and_shuffle_files_go(spark):
    def grouped():
        return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("l"))

    def shuffles():
        top = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {f for d in top for f in glob.glob(os.path.join(d, "*", "shuffle_*"))}

    kept, before = S.stored(grouped()), _jobs(spark)  # no job: a checkpoint
    old = shuffles()
    with S.job(spark):
        one = S.stored(grouped())
        with S.job(spark):
            two = S.stored(one.where("k > 2"))
            assert two.count() == 4 and len(_jobs(spark)) == len(before) + 2
        three = S.settled(spark, lambda: S.stored(one).groupBy("k").count())
        assert len(_jobs(spark)) == len(before) + 1
        assert sorted(three.columns) == ["count", "k"] and three.count() == one.count() == 7
        assert three.schema["k"].dataType == one.schema["k"].dataType
        empty = S.stored(one.where("k > 9"))
        assert empty.columns == ["k", "l"] and empty.isEmpty()
        assert S.stored(spark.sql("select null as nothing")).count() == 1  # no type that parquet knows
        until = time.time() + 20  # executors are told without waiting for them
        while not shuffles() <= old and time.time() < until:
            time.sleep(0.1)
        assert shuffles() <= old
    assert _jobs(spark) == before and kept.count() == 7
    assert spark.conf.get(S.SHUFFLES_GO) == "false"
    with pytest.raises(ZeroDivisionError), S.job(spark):
        S.stored(kept)
        1 / 0
    assert _jobs(spark) == before and spark.conf.get(S.SHUFFLES_GO) == "false"


def test_folds_of_the_next_game_backtest_store_no_games(spark, checkpointed):
    """before, each fold stored its games three times."""
    rows = [(2000 + i // 300, dt.date(2000 + i // 300, 1, 1) + dt.timedelta(days=i % 300), i, (i * 7919 % 13 + i % 3) % 2,
             float(i * 31 % 17) if i % 11 else None, float(i * 7 % 5), float(i % 2)) for i in range(1200)]
    df = spark.createDataFrame([*rows, (2001, dt.date(2001, 1, 1), 5000, None, 1.0, 1.0, 1.0)],
                               "season_start long, game_date date, game_id long, home_win int, a double, b double, other double")
    sets = {"one": ["a"], "two": ["b", "a"]}
    assert ML.next_game_rows(df, sets).columns == ["season_start", "game_date", "game_id", "home_win", "a", "b"]
    with S.job(spark):
        df = S.stored(df)
        p = ML.next_game_backtest(df, sets, min_train=300, min_calibration=100)
        got = [r.asDict() for r in p.collect()]
    assert sorted((r["model"], r["test_season"], r["game_id"]) for r in got) == sorted(
        (m, s, i) for m in sets for s, _, i, *_ in rows if s > 2000)
    assert all(0 < r["y_prob_raw"] < 1 for r in got)
    # 300 games: the 60 of the calibration are too few in the first fold
    assert {s: {r["temperature"] is None for r in got if r["test_season"] == s} for s in (2001, 2002, 2003)} == {
        2001: {True}, 2002: {False}, 2003: {False}}
    assert not [c for c in checkpointed if {"a", "b"} & c]


def test_few_folds_at_once_on_many_games(spark, monkeypatch):
    found = []
    monkeypatch.setattr(ML, "ThreadPoolExecutor", lambda n, real=ML.ThreadPoolExecutor: found.append(n) or real(n))
    df = spark.range(90).select((F.col("id") % 3).alias("season_start"))
    for rows in (10**6, 300, 100, 10):
        monkeypatch.setattr(ML, "FOLD_ROWS", rows)
        assert ML._folds(df, "season_start", lambda g, s, train, test: (s, train.count(), test.count())) == [(1, 30, 30), (2, 60, 30)]
    assert found == [8, 3, 1, 1]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three seasons of games with their line items; a game that comes twice, one without an id, line items of no game."""
    top = tmp_path_factory.mktemp("tables")
    days = [dt.datetime(1995 + k % 3, 10, 1) + dt.timedelta(days=k * 7 % 150) for k in range(1200)]
    orders = [(k, k * 37 % 211, 1000.0 + k * 917 % 4099, days[k], "5-LOW" if k % 50 == 0 else "1-URGENT") for k in range(1200)]
    orders += [orders[77], (None, 3, 1234.0, days[5], "1-URGENT")]
    lines = [(k, k * 13 % 997 + i * 31, k * 17 % 89 + i, 1 + i, float(1 + (k * 7 + i * 11) % 50)) for k in range(1210) for i in range(4)]
    lines += [lines[500], (None, 1, 1, 1, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string") \
        .write.parquet(str(top / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double") \
        .write.parquet(str(top / "lineitem.parquet"))
    return str(top)


def _small_on_disk(spark, tables, name, checkpointed):
    """The rows of a query that stores nothing beyond its end but its few rows; no checkpoint holds games' features."""
    before = _jobs(spark)
    rows = queries()[name](spark, tables).collect()
    assert _jobs(spark) == before and spark.conf.get(S.SHUFFLES_GO) == "false"
    assert not [c for c in checkpointed if {"elo_diff", "efg_l10_diff", "efg_pct", "_roster"} & c]
    return rows


def test_next_game(spark, tables, checkpointed):
    """before, the games, their team rows and every fold's games stayed as checkpoints."""
    rows = _small_on_disk(spark, tables, "l10_next_game", checkpointed)
    assert {r["model"] for r in rows} == {"M3_adv_l10", "M4_adv_l10_l5_s2d", "M5_adv_l10_plus_s2d"}
    assert {r["test_season"] for r in rows} == {1997} and all(0 < r["logloss"] < 2 for r in rows)


def test_feature_set_comparison(spark, tables, checkpointed):
    """as for F1, with availability and travel among the features."""
    rows = _small_on_disk(spark, tables, "l09_feature_set_comparison", checkpointed)
    assert {(r["model"], r["test_season"]) for r in rows} == {("base", 1997), ("injury_travel", 1997)}
    assert len({r["logloss_raw"] for r in rows}) == 2


def test_next_game_calibration(spark, tables, checkpointed):
    """as for F1; every bin is there, and all games of the test season are in one."""
    rows = _small_on_disk(spark, tables, "l10_next_game_calibration", checkpointed)
    games = queries()["j09_full"](spark, tables).where("season_start = 1997 and home_win is not null")
    assert len(rows) == 10 and sum(r["n"] for r in rows) == games.count() > 0
