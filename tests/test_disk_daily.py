"""The daily load on disk (finding F3 of round 4): one store of a batch, partitions merged in groups."""

import os

import pytest
from pyspark.sql import functions as F

from rimshot.operators.merge import last_per_key
from rimshot.plans.catalog import queries
from rimshot.streaming import daily as D
from tests.test_disk import _jobs, checkpointed, tables  # noqa: F401


def _box(game, player, points, season=2020):
    return (game, season, player, 10, "30:00", *range(1, 11), points)


def _batch(spark, rows, at):
    return spark.createDataFrame(rows, D.FEEDS["player_box"].schema).select(
        F.lit("player_box").alias("_feed"), F.timestamp_seconds(F.lit(at)).alias("_at"), F.lit(f"file {at}").alias("_file"), "*")


def _table(spark, root):
    df = spark.read.parquet(os.path.join(root, "player_box"))
    return sorted((r["season_start"], r["game_id"], r["player_id"], r["pts"], r["_file"]) for r in df.collect())


@pytest.mark.parametrize("most", [D.MERGE_ROWS, 25, 1])
def test_partitions_are_merged_in_groups(spark, tmp_path, monkeypatch, checkpointed, most):  # noqa: F811
    """Before, all partitions of a batch went through one exchange, and the batch and each table were checkpointed."""
    monkeypatch.setattr(D, "MERGE_ROWS", most)
    groups, real = [], D.Warehouse._merge
    monkeypatch.setattr(D.Warehouse, "_merge", lambda w, name, rows, keys, parts: groups.append(len(parts)) or real(w, name, rows, keys, parts))
    load, root, before = D.DailyLoad(spark, str(tmp_path / "t")), str(tmp_path / "t"), _jobs(spark)
    first = [_box(g, p, g + p, 2018 + g % 3) for g in range(24) for p in range(3)]
    load.apply(_batch(spark, [*first, first[0], _box(3, 1, 99, 2018), _box(5, None, 1)], 10), 0)
    told = {(2018 + g % 3, g, p): (g + p, "file 10") for g in range(24) for p in range(3)} | {(2018, 3, 1): (99, "file 10")}
    assert _table(spark, root) == sorted((*k, *v) for k, v in told.items())
    # the next batch meets partitions that are there and, in a new season, some that are not
    load.apply(_batch(spark, [_box(4, 2, 50, 2019), _box(7, 0, 51, 2021), _box(8, 0, 52, 2021), _box(9, 5, 53, 2021)], 20), 1)
    told |= {(2019, 4, 2): (50, "file 20"), (2021, 7, 0): (51, "file 20"), (2021, 8, 0): (52, "file 20"), (2021, 9, 5): (53, "file 20")}
    assert _table(spark, root) == sorted((*k, *v) for k, v in told.items())
    # an older delivery that comes late changes nothing, but for a key that is not there yet
    load.apply(_batch(spark, [_box(4, 2, 0, 2019), _box(4, 9, 1, 2019)], 5), 2)
    assert _table(spark, root) == sorted((*k, *v) for k, v in (told | {(2019, 4, 9): (1, "file 5")}).items())
    assert len(groups) == 3 if most > 100 else len(groups) > 4 and (most > 1) == (max(groups) > 1)
    assert not [c for c in checkpointed if "minutes" in c] and _jobs(spark) == before


def test_the_last_row_of_a_key(spark):
    """A row and the columns of its order are in the maximum once; before, the row was in it twice."""
    rows = [(1, None, "a", 1.0), (1, 2, "b", None), (1, 2, "b", 3.0), (2, None, None, 5.0), (2, None, "c", 4.0), (None, 1, "d", 1.0)]
    df = spark.createDataFrame(rows, "k int, _o1 int, x string, v double")

    def got(**order):
        out = last_per_key(df, ["k"], **order)
        assert out.columns == ["k", "_o1", "x", "v"]
        return sorted(map(tuple, out.collect()), key=str)

    assert got() == sorted([(1, 2, "b", 3.0), (2, None, "c", 4.0), (None, 1, "d", 1.0)], key=str)
    assert got(order=["v"]) == sorted([(1, 2, "b", 3.0), (2, None, None, 5.0), (None, 1, "d", 1.0)], key=str)
    assert got(order=[-F.coalesce("v", F.lit(9.0)), "_o1"]) == sorted([(1, None, "a", 1.0), (2, None, "c", 4.0), (None, 1, "d", 1.0)], key=str)
    assert got(order=["k", F.col("_o1").isNull(), "v"]) == sorted([(1, None, "a", 1.0), (2, None, None, 5.0), (None, 1, "d", 1.0)], key=str)
    plan = last_per_key(df.where("v > 0"), ["k"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "max(struct(" in plan


def test_landing_and_batch_go(spark, tables, checkpointed):  # noqa: F811
    """x02_daily_player_box: all player rows are there, and none of its steps leaves a copy."""
    before = _jobs(spark)
    got = queries()["x02_daily_player_box"](spark, tables)
    raw = queries()["a03_duplicate_player_rows"](spark, tables)
    assert got.count() == got.select("season_start", "game_id", "player_id").distinct().count() > 4000 and raw.count() > 0
    assert _jobs(spark) == before and not [c for c in checkpointed if "minutes" in c]
