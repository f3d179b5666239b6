"""Small inputs on which an earlier version went wrong."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rimshot.functions import expressions as E
from rimshot.operators import merge as U
from rimshot.operators import models as ML
from rimshot.operators import normalise as N
from rimshot.operators.elo import elo
from rimshot.operators.results import pivot_games
from rimshot.sources import files as S
from rimshot.streaming import daily as D
from rimshot.streaming import jobs as J


def _tmp():
    return tempfile.mkdtemp(prefix="rimshot-test-")


def _book(ms, bid):
    return f'{{"timestamp": "{ms}", "bids": [{{"price": "{bid}", "size": "1"}}], "asks": []}}'


def _land(spark, folder, files, schema, fmt):
    for i, rows in enumerate(files):
        path = os.path.join(folder, f"f{i:03d}")
        spark.createDataFrame(rows, schema).coalesce(1).write.format(fmt).save(path)
        for name in os.listdir(path):   # file times in the order of the files
            os.utime(os.path.join(path, name), (1_700_000_000 + i, 1_700_000_000 + i))


DAY = 86_400_000


@pytest.mark.parametrize("files_per_trigger", [1, 10])
def test_quotes_may_be_late_and_repeated(spark, files_per_trigger):
    root = _tmp()
    t = 1_700_000_000_000
    # (snapshot, game, book): snapshot 2 comes before 1 in one file; a key again with another book; 50 days late rows
    files = [[(2, 1, _book(t, 0.2)), (1, 1, _book(t, 0.1))], [(3, 1, _book(t, 0.9)), (4, 2, _book(t + 60 * DAY, 0.4))],
             [(5, 3, _book(t + 10 * DAY, 0.5)), (6, 1, _book(t + DAY, 0.6))]]
    _land(spark, os.path.join(root, "in"), files, J.BOOK_FILE_SCHEMA, "json")
    for _ in range(2):   # a second run finds nothing new
        J.quote_stream(spark, os.path.join(root, "in", "f*"), os.path.join(root, "quotes"), os.path.join(root, "progress"),
                       files_per_trigger=files_per_trigger).awaitTermination()
    got = {(r.game_id, r.asof_ts): r.bid for r in spark.read.parquet(os.path.join(root, "quotes")).collect()}
    at = lambda ms: dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    assert got == {(1, at(t)): 0.1, (2, at(t + 60 * DAY)): 0.4, (3, at(t + 10 * DAY)): 0.5, (1, at(t + DAY)): 0.6}


def _log(game, team, pts, home, wl, season=2020, day=1):
    return (game, season, dt.date(2020, 10, day), "Regular Season", team, pts, f"T{team} {'vs.' if home else '@'} X", wl)


def test_unreadable_table_is_an_error(spark):
    root = _tmp()
    assert not D.exists(spark, os.path.join(root, "none"))
    os.makedirs(os.path.join(root, "games"))
    with open(os.path.join(root, "games", "part-0.parquet"), "w") as f:
        f.write("no parquet")
    assert D.exists(spark, os.path.join(root, "games"))
    with pytest.raises(Exception):
        spark.read.parquet(os.path.join(root, "games")).collect()


def test_repeated_source_keys(spark):
    t = spark.createDataFrame([(1, "a", "x", False)], "k long, v string, w string, is_manual_override boolean")
    s = spark.createDataFrame([(1, "B", "y", 1), (1, "C", None, 2), (2, "D", None, 1), (2, "E", "z", 2), (2, "F", None, 3)],
                              "k long, v string, w string, seq int")
    plain = t.select("k", "v")
    assert sorted(map(tuple, U.upsert(plain, s, ["k"], ["seq"]).collect())) == [(1, "C"), (2, "F")]
    got = sorted(map(tuple, U.guarded_upsert(t, s, ["k"], ["w"], order=["seq"]).collect()))
    assert got == [(1, "C", "y", False), (2, "F", "z", False)]
    assert sorted(map(tuple, U.patch(plain, s, ["k"], ["v"], order=["seq"]).collect())) == [(1, "C"), (2, "F")]


def test_unmarked_row_sets_no_winner(spark):
    log = spark.createDataFrame([_log(1, 10, 100, True, "L"), (1, 2020, dt.date(2020, 10, 1), "Regular Season", 11, 120, "unmarked", "W")], D.FEEDS["game_log"].schema)
    for mode in ("bulk", "daily"):
        r = pivot_games(log, mode).first()
        assert (r.home_team_id, r.away_team_id, r.winner) == (10, None, None)


def test_pivot_uses_one_exchange(spark):
    plan = pivot_games(spark.createDataFrame([_log(1, 10, 100, True, "L")], D.FEEDS["game_log"].schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_unlisted_season_type_never_wins(spark):
    log = spark.createDataFrame([("d1", "All-Star", 1), ("d1", "Playoffs", 2), ("d2", "All-Star", 3)], "game_date string, season_type string, game_id int")
    assert [r.game_id for r in S.first_nonempty_season_type(log, ["game_date"]).collect()] == [2]


def test_parts_without_player_ids_are_no_player_rows(spark):
    root = _tmp()
    texts = {"a.csv": "gameId,personId,points\n1,2,3\n", "b.csv": "gameId,teamId\n1,9\n", "c.csv": "", "d.csv": "GAME_ID,PLAYER_ID,PTS\n4,5,\"6,0\"\n"}
    for name, text in texts.items():
        with open(os.path.join(root, name), "w") as f:
            f.write(text)
    got = S.read_csv_parts(spark, os.path.join(root, "*.csv"))
    assert sorted((r.gameId or r.GAME_ID, r.personId or r.PLAYER_ID, r.points or r.PTS) for r in got.collect()) == [("1", "2", "3"), ("4", "5", "6,0")]
    assert S.read_csv_parts(spark, os.path.join(root, "[bc].csv")) is None


def test_parts_of_many_headers_are_one_scan(spark):
    """Quoted commas, quotes and line breaks; short and long records; one file scan however many headers."""
    root = _tmp()
    texts = {"a.csv": 'gameId,personId,name\n1,2,"A, ""the\nsecond"" B"\n3,4\n\n5,6,x,y\n',
             "b.csv": '"GAME_ID","PLAYER_ID",PTS\r\n0007,5,"6"\r\n', "c.csv": "personId,extra,gameId\n8,e,9\n",
             "d.csv": "name,gameId,personId,name\nfirst,10,11,second\n", "e.csv": "gameId,personId,name\n", "f.csv": "\n\n"}
    for name, text in texts.items():
        with open(os.path.join(root, name), "w", newline="") as f:
            f.write(text)
    got = S.read_csv_parts(spark, os.path.join(root, "*.csv"))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = sorted((r.gameId or r.GAME_ID, r.personId or r.PLAYER_ID, r.name, r.PTS, r.extra) for r in got.collect())
    assert rows == [("0007", "5", None, "6", None), ("1", "2", 'A, "the\nsecond" B', None, None), ("10", "11", "first", None, None),
                    ("3", "4", None, None, None), ("5", "6", "x", None, None), ("9", "8", None, None, "e")]


def test_schedule_takes_the_date_fields(spark):
    raw = spark.createDataFrame([("1", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", "7", "8"), ("2", None, "2024-01-03T00:00:00Z", "7", "8")],
                                "gameId string, gameDateEst string, gameDateUTC string, homeTeam_teamId string, awayTeam_teamId string")
    assert [r.game_date for r in N.schedule(raw, "2023-24").orderBy("game_id").collect()] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def test_advanced_stats_choose_a_frame(spark):
    rows = [(1, 0, "5", None, "1"), (1, 0, "6", None, "1"), (1, 0, "7", None, "1"), (1, 1, "5", None, "110"), (1, 1, "6", None, "90"),
            (2, 0, "5", None, "100"), (2, 0, None, None, "101"), (3, 0, None, "4", "99")]
    f = spark.createDataFrame(rows, "game_id long, frame_no int, teamId string, TEAM_ID string, offensiveRating string")
    got = sorted((r.game_id, r.team_id, r.off_rtg) for r in N.advanced_stats(f).collect())
    assert got == [(1, 5, 110.0), (1, 6, 90.0), (2, 5, 100.0)]


def test_medians_of_integer_and_empty_columns(spark):
    t = spark.createDataFrame([(1, None, 0), (2, None, 1), (None, None, 1), (2, None, 0), (1, None, 1)], "a int, b double, y int")
    med = ML.medians(t, ["a", "b"])
    assert med == {"a": 1.5, "b": None}
    assert [r.a for r in ML.impute(t, med).collect()][2] == 1.5
    tr, te = ML.prepare(t, t, ["a", "b"], "y", center=False, balanced=True)
    assert ML.score(ML.fit_lr(tr, ["a", "b"], "y", 1.0, "weight"), te, ["a", "b"]).count() == 5


def test_temperature_is_not_bounded(spark):
    rows = [("sharp", 0.5 + 0.001 * (1 if i % 100 else -1), 1) for i in range(200)] + [("flat", 0.9, i % 2) for i in range(100)]
    got = {r.g: r.temperature for r in ML.fit_temperature(spark.createDataFrame(rows, "g string, y_prob double, y_true int"), ["g"]).collect()}
    assert got["sharp"] < 0.01 and got["flat"] == float("inf")


def test_elo_groups_by_league(spark):
    rows = [(l, 2020, g, dt.date(2020, 10, g), a, b, 1, 1) for l in ("x", "y") for g, a, b in ((1, 1, 2), (2, 1, 3))]
    rows += [(l, s, g, d, b, a, 0, 0) for l, s, g, d, a, b, _, _ in rows]
    res = spark.createDataFrame(rows, "league string, season_start long, game_id long, game_date date, team_id long, opp_team_id long, is_home int, is_win int")
    got = elo(res, group_keys=("league", "season_start")).where("team_id = 1 and game_id = 2").select("league", "elo_pre").collect()
    assert sorted(map(tuple, got)) == [("x", 1510.0), ("y", 1510.0)]


def test_norm_text_trims_all_white_space(spark):
    df = spark.createDataFrame([("\t Hawks \n  Win\n",)], "s string")
    assert df.select(E.norm_text(F.col("s")).alias("x")).first().x == "hawks win"


def test_misspelt_column_is_an_error(spark):
    from rimshot.operators.quality import out_of_range
    with pytest.raises(ValueError):
        out_of_range(spark.range(1), ["fg_pct"])


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from rimshot.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_permutation_importance_finds_the_feature(spark):
    rows = [(i, i % 10 / 10.0, (i * 7 % 13) / 13.0, int(i % 10 >= 5)) for i in range(200)]
    t = spark.createDataFrame(rows, "team_id long, a double, b double, y int")
    m = ML.fit_lr(t, ["a", "b"], "y", 1.0)
    got = {r.feature: r.perm_importance_mean for r in ML.permutation_importance(m, t, ["a", "b"], "y", "team_id", repeats=3).collect()}
    assert got["a"] > 0.3 and abs(got["b"]) < 0.05


@pytest.mark.parametrize("name", ["l10_backtest_summary", "l10_backtest_fold_metrics", "l06_tree_models"])
def test_backtest_scores_all_models(spark, monkeypatch, name):
    from rimshot.plans import q_models

    asked = {}

    def backtest(t, *_, models=(), **__):
        asked.update(models=set(models), checkpoints={r.checkpoint for r in t.collect()})
        raise StopIteration

    monkeypatch.setattr(q_models, "wide_table", lambda *_: spark.createDataFrame([(20,), (40,), (60,)], "checkpoint int"))
    monkeypatch.setattr(q_models.ML, "backtest", backtest)
    with pytest.raises(StopIteration):
        getattr(q_models, name)(spark, "")
    assert asked["checkpoints"] == {20, 40, 60}
    assert asked["models"] == {"Baseline_BaseRate", *q_models.ML.BASELINES, "LogisticRegression", "RandomForest", "GradientBoosting"}
