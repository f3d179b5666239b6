"""The daily load (X2) on small deliveries: corrections, splits, repeats, moved games, what is recomputed."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rimshot.streaming import daily as D


def _day(n):
    return dt.date(2020, 10, 1) + dt.timedelta(days=n)


def _log(game, home, away, hp, ap, day, season=2020):
    return [(game, season, _day(day), "Regular Season", home, hp, f"T{home} vs. T{away}", "W" if hp > ap else "L"),
            (game, season, _day(day), "Regular Season", away, ap, f"T{away} @ T{home}", "W" if ap > hp else "L")]


def _box(game, *teams, ast=20, season=2020):
    return [(game, season, t, 40, 80, 10, 30, 15, 20, 10, 30, ast, 12, 105) for t in teams]


def _land(spark, root, feed, files, first=0):
    """One file for each list of rows; delivery times ascend with ``first`` and the place in the list."""
    for i, rows in enumerate(files, first):
        path = os.path.join(root, "in", feed, f"f{i:03d}")
        spark.createDataFrame(rows, D.FEEDS[feed].schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(os.path.join(path, name), (1_700_000_000 + i, 1_700_000_000 + i))


def _run(spark, root, feeds, files_per_trigger=10, tables="tables"):
    D.daily_load_stream(spark, {f: os.path.join(root, "in", f, "f*") for f in feeds}, os.path.join(root, tables),
                        os.path.join(root, f"progress-{tables}"), files_per_trigger=files_per_trigger).awaitTermination()
    return os.path.join(root, tables)


def _rows(spark, tables, name, columns=None):
    df = spark.read.parquet(os.path.join(tables, name))
    df = df.drop("_at", "_file", "bucket") if columns is None else df.select(*columns)
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="rimshot-test-")


def test_the_last_delivery_wins(spark, root):
    _land(spark, root, "game_log", [_log(1, 10, 11, 100, 90, 1), _log(1, 10, 11, 104, 90, 1)])
    tables = _run(spark, root, ["game_log"], 1)
    assert _rows(spark, tables, "games", ["game_id", "home_points", "winner"]) == [(1, 104, 10)]
    # an older file that comes late changes nothing, whatever batch it is read in
    _land(spark, root, "game_log", [_log(1, 10, 11, 1, 90, 1)], first=-5)
    _run(spark, root, ["game_log"], 1)
    assert _rows(spark, tables, "games", ["game_id", "home_points", "winner"]) == [(1, 104, 10)]


def test_any_split_of_files_gives_the_same_tables(spark, root):
    log = [_log(g, 10 + g % 3, 20 + g % 4, 90 + g % 7, 91 + g % 5, g) for g in range(30)]
    box = [_box(g, 10 + g % 3, 20 + g % 4, ast=15 + g) for g in range(30)]
    _land(spark, root, "game_log", [[r for x in log[:12] for r in x] + log[20][:1], [r for x in log[12:] for r in x if r != log[20][0]],
                                    _log(3, 10, 23, 150, 94, 3) + _log(7, 11, 23, 70, 93, 25)])
    _land(spark, root, "team_box", [[r for x in box[15:] for r in x], [r for x in box[:15] for r in x], _box(4, 11, 20, ast=50)])
    _land(spark, root, "player_box", [[(1, 2020, 7, 10, "30:00", *range(1, 12))] * 2, [(1, 2020, 7, 11, "31:00", *range(1, 12))]])
    _land(spark, root, "standings", [[(2020, _day(5), 10, "East", 1, 3, 2, 1), (2020, _day(5), None, "East", 1, 3, 2, 1)],
                                     [(2020, _day(5), 10, "East", 1, 4, 2, 1)]])
    one, all_ = (_run(spark, root, list(D.FEEDS), n, f"t{n}") for n in (1, 10))
    for name in ("game_log", "team_box", "player_box", "standings", "games", "features"):
        assert _rows(spark, one, name) == _rows(spark, all_, name)
    assert len(_rows(spark, one, "games")) == 30 and len(_rows(spark, one, "features")) == 60
    assert _rows(spark, one, "player_box", ["player_id", "team_id"]) == [(7, 11)]
    assert _rows(spark, one, "standings", ["team_id", "wins"]) == [(10, 4)]
    assert spark.read.parquet(os.path.join(one, "rejected", "standings")).count() == 1
    points = {r.game_id: (r.home_points, r.game_date) for r in spark.read.parquet(os.path.join(one, "games")).collect()}
    assert points[3] == (150, _day(3)) and points[7] == (70, _day(25))


def test_rows_before_the_dirty_date_stay_as_they_are(spark, root):
    _land(spark, root, "game_log", [[r for g in range(12) for r in _log(g, 10, 11, 100 + g, 90, g)] + _log(50, 12, 13, 80, 70, 5)])
    _land(spark, root, "team_box", [[r for g in range(12) for r in _box(g, 10, 11)] + _box(50, 12, 13)])
    tables = _run(spark, root, ["game_log", "team_box"])
    features = os.path.join(tables, "features")
    marked = spark.read.parquet(features).withColumn("win_pct_l5", F.lit(7.0)).checkpoint()
    marked.write.mode("overwrite").partitionBy("season_start", "bucket").parquet(features)
    _land(spark, root, "team_box", [_box(6, 10, ast=99)], first=5)
    _run(spark, root, ["game_log", "team_box"])
    got = {(r.team_id, r.game_id): (r.win_pct_l5, r.avg_ast_l10) for r in spark.read.parquet(features).collect()}
    assert len(got) == 26
    for (team, game), (mark, ast) in got.items():
        dirty = game in range(6, 12)  # both sides of a touched game are looked at again, others are not
        assert (mark == 7.0) != dirty
        if team == 10 and game > 6:
            assert ast > 20
        elif game > 0 and game != 50:
            assert ast == 20


def test_a_moved_game_leaves_its_old_teams(spark, root):
    _land(spark, root, "game_log", [_log(1, 10, 11, 100, 90, 1) + _log(2, 10, 12, 80, 90, 2) + _log(3, 10, 12, 85, 80, 3),
                                    [(1, 2020, _day(1), "Regular Season", 10, 100, "T10 vs. T11", "W")]])
    _land(spark, root, "team_box", [_box(1, 10, 11) + _box(2, 10, 12) + _box(3, 10, 12)])
    tables = _run(spark, root, ["game_log", "team_box"], 1)
    assert {(r.team_id, r.game_id) for r in spark.read.parquet(os.path.join(tables, "features")).collect()} == {
        (10, 1), (11, 1), (10, 2), (12, 2), (10, 3), (12, 3)}
    # game 2 was really played a day later than game 3: L5 and the order of games change for both teams
    _land(spark, root, "game_log", [_log(2, 10, 12, 80, 90, 9)], first=9)
    _run(spark, root, ["game_log", "team_box"], 1)
    got = {(r.team_id, r.game_id): r.win_pct_s2d for r in spark.read.parquet(os.path.join(tables, "features")).collect()}
    assert got[10, 3] == 1.0 and got[10, 2] == 1.0 and got[12, 3] is None and got[12, 2] == 0.0


def test_a_batch_may_run_again(spark, root):
    load = D.DailyLoad(spark, os.path.join(root, "tables"))
    rows = spark.createDataFrame([r for g in range(4) for r in _log(g, 10, 11, 100 + g, 90, g)], D.FEEDS["game_log"].schema)
    box = spark.createDataFrame([r for g in range(4) for r in _box(g, 10, 11)], D.FEEDS["team_box"].schema)
    at = F.timestamp_seconds(F.lit(5))
    batch = (rows.select(F.lit("game_log").alias("_feed"), at.alias("_at"), F.lit("a").alias("_file"), "*")
             .unionByName(box.select(F.lit("team_box").alias("_feed"), at.alias("_at"), F.lit("b").alias("_file"), "*"), allowMissingColumns=True))
    for batch_id in (0, 0, 1):  # 0 again is skipped by the ledger; the same rows as batch 1 change nothing
        load.apply(batch, batch_id)
    tables = os.path.join(root, "tables")
    assert len(_rows(spark, tables, "game_log")) == 8 and len(_rows(spark, tables, "features")) == 8
    applied = spark.read.parquet(os.path.join(tables, "ledger", "applied"))
    assert {(r.batch, r._feed): r.n_rows for r in applied.collect()} == {(b, f): 8 for b in (0, 1) for f in ("game_log", "team_box")}
    load.apply(batch.where("false"), 2)
    assert not D.exists(spark, os.path.join(tables, "ledger", "applied", "batch=2"))


def test_a_batch_that_failed_half_way(spark, root, monkeypatch):
    """The games are replaced, the features are not yet: the next attempt knows the old team's days from the ledger."""
    first = _log(1, 10, 11, 100, 90, 1) + _log(2, 10, 12, 90, 80, 2)
    _land(spark, root, "game_log", [first])
    _land(spark, root, "team_box", [_box(1, 10, 11) + _box(2, 10, 12)])
    tables = _run(spark, root, ["game_log", "team_box"])
    _land(spark, root, "game_log", [_log(1, 10, 11, 100, 90, 6)], first=5)

    def fail(self, dirty):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(D.DailyLoad, "_features", fail)
        with pytest.raises(Exception):
            _run(spark, root, ["game_log", "team_box"])
    _run(spark, root, ["game_log", "team_box"])
    got = {(r.team_id, r.game_id): (r.game_date, r.win_pct_s2d) for r in spark.read.parquet(os.path.join(tables, "features")).collect()}
    assert got == {(10, 2): (_day(2), None), (12, 2): (_day(2), None), (10, 1): (_day(6), 1.0), (11, 1): (_day(6), None)}
