"""Sinks, landed-file sources and gates on small hand-made inputs."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rimshot.operators import filters as FL
from rimshot.operators import normalise as N
from rimshot.operators.merge import replace_slice
from rimshot.sources import files as S


def _tmp():
    return tempfile.mkdtemp(prefix="rimshot-test-")


def test_replace_slice_overwrites_only_present_partitions(spark):
    path = os.path.join(_tmp(), "t")
    a = spark.createDataFrame([(2020, 20, 1, 0.5), (2021, 20, 1, 0.6)], "season_start int, checkpoint int, team_id int, p double")
    replace_slice(a, path, ["season_start", "checkpoint"])
    b = spark.createDataFrame([(2021, 20, 1, 0.9)], "season_start int, checkpoint int, team_id int, p double")
    replace_slice(b, path, ["season_start", "checkpoint"])
    got = {(r.season_start, r.p) for r in spark.read.parquet(path).collect()}
    assert got == {(2020, 0.5), (2021, 0.9)}


def test_sinks_partitioned_and_append(spark):
    root = _tmp()
    df = spark.createDataFrame([("e1", "lr", 2020, 0.1), ("e1", "rf", 2021, 0.2)], "experiment string, model string, test_season int, p double")
    S.write_partitioned(df, os.path.join(root, "preds"), ["experiment", "model", "test_season"])
    assert sorted(os.listdir(os.path.join(root, "preds", "experiment=e1"))) == ["model=lr", "model=rf"]
    S.write_append(df, os.path.join(root, "csv"))
    S.write_append(df, os.path.join(root, "csv"))
    assert S.read_csv(spark, os.path.join(root, "csv")).count() == 4
    S.write_overwrite(df, os.path.join(root, "o"))
    S.write_overwrite(df.limit(1), os.path.join(root, "o"))
    assert spark.read.parquet(os.path.join(root, "o")).count() == 1


def test_typed_empty_and_row_gate(spark):
    e = S.empty_like(spark, "game_id string, pts long")
    assert e.columns == ["game_id", "pts"] and not S.has_rows(e)
    assert S.has_rows(spark.range(3))


def test_csv_ids_keep_leading_zeros(spark):
    root = _tmp()
    with open(os.path.join(root, "g.csv"), "w") as fh:
        fh.write("GAME_ID,PTS\n0022300001,101\n")
    r = S.read_csv(spark, os.path.join(root, "g.csv"), "GAME_ID string, PTS long").collect()[0]
    assert r.GAME_ID == "0022300001"


def test_mapping_rows_alternate_columns(spark):
    df = spark.createDataFrame([(" 1 ", "a", None), ("2", " ", "b "), ("", "c", None), ("4", None, "  ")],
                               "game_id string, polymarket_slug string, slug string")
    assert sorted(S.mapping_rows(df).collect()) == [("1", "a"), ("2", "b")]


def test_first_nonempty_season_type(spark):
    log = spark.createDataFrame([(dt.date(2024, 4, 1), "PlayIn", 1), (dt.date(2024, 4, 1), "Playoffs", 2),
                                 (dt.date(2024, 4, 2), "Playoffs", 3)], "game_date date, season_type string, game_id int")
    got = sorted(r.game_id for r in S.first_nonempty_season_type(log, ["game_date"]).collect())
    assert got == [1, 3]


def test_season_split_and_gates(spark):
    df = spark.createDataFrame([(2020, 1), (2021, 2), (2022, 3)], "season_start int, x int")
    tr, te = FL.season_split(df, [2020, 2021], 2022)
    assert tr.count() == 2 and te.count() == 1
    with pytest.raises(ValueError):
        FL.season_split(df, [2019], 2022)
    assert FL.enough_rows(df, 3) and not FL.enough_rows(df, 4)
    w = FL.forward_window(spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 4, 5)], "game_date date"),
                          dt.date(2024, 1, 1), 3)
    assert w.count() == 2
    m = spark.createDataFrame([("lr", 1.0), ("rf", None), ("x", 1.0)], "model string, n double")
    assert FL.keep_models(m, ["lr", "rf"], ["n"]).count() == 1


def test_game_type_digit(spark):
    # the type digit is the 5th character of the 10-digit id (index 4)
    df = spark.createDataFrame([("200001",), ("0000400101",), (" 30000001 ",), ("abc",)], "game_id string")
    got = [r.game_id for r in FL.regular_or_playoff(df).collect()]
    assert got == ["200001", "0000400101"]


def test_required_columns_and_fill(spark):
    df = spark.createDataFrame([(True, None, None)], "flag boolean, is_home int, f double")
    out = N.fill_features(N.require_columns(df, ["flag", "is_home"]), ["f"]).collect()[0]
    assert (out.flag, out.is_home, out.f) == (1, 0, 0.0)
    with pytest.raises(ValueError):
        N.require_columns(df, ["missing"])


def test_team_dim_rename_keeps_present_columns(spark):
    raw = spark.createDataFrame([(1, "Hawks", "ATL", "x")], "id long, full_name string, abbreviation string, other string")
    out = N.rename_present(raw, N.TEAM_DIM_RENAMES, list(N.TEAM_DIM_RENAMES.values()))
    assert out.columns == ["team_id", "full_name", "abbreviation"]


def test_minutes_and_ids(spark):
    from rimshot.functions.expressions import minutes_played, normalize_game_id
    df = spark.createDataFrame([("34:30",), ("12",), (None,), ("DNP",)], "m string")
    assert [r.x for r in df.select(minutes_played(F.col("m")).alias("x")).collect()] == [34.5, 12.0, None, None]
    ids = spark.createDataFrame([("22300001",), (" 12345678901 ",), ("A1",)], "g string")
    assert [r.x for r in ids.select(normalize_game_id(F.col("g")).alias("x")).collect()] == \
        ["0022300001", "12345678901", "A1"]


def test_schedule_weeks(spark):
    df = spark.createDataFrame([("1", "Week 1", "2024-10-22T00:00:00Z", "2024-10-27"), ("x", None, "bad", None)],
                               "weekNumber string, weekName string, startDate string, endDate string")
    rows = N.schedule_weeks(df, "2024-25").collect()
    assert (rows[0].week_number, rows[0].start_date, rows[0].end_date) == (1, dt.date(2024, 10, 22), dt.date(2024, 10, 27))
    assert rows[1].week_number is None and rows[1].start_date is None


def test_slice_rows_is_a_half_open_range(spark):
    from rimshot.operators.ordering import slice_rows
    df = spark.range(0, 100).select((99 - F.col("id")).alias("k"))
    got = sorted(r.k for r in slice_rows(df, ["k"], 10, 20).collect())
    assert got == list(range(10, 20))


def test_new_files_are_read(spark):
    from rimshot.sources.tables import read_table
    root = _tmp()
    spark.range(3).write.parquet(os.path.join(root, "t.parquet"))
    assert read_table(spark, root, "t").count() == 3
    spark.range(2).write.mode("append").parquet(os.path.join(root, "t.parquet"))
    assert read_table(spark, root, "t").count() == 5
