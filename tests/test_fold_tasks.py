"""Folds of a small table: its jobs have tasks by its rows, not by the partitions of the plan behind it."""

from rimshot.operators import folds as FD


def test_small_table_of_many_partitions(spark):
    rows = [(2000 + i % 4, i, float(i % 7), i // 4 % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "season_start long, team_id long, a double, label int").repartition(40)
    folds = FD.make_folds(df, ["a"], "label")
    assert folds.rows.rdd.getNumPartitions() == folds.base.rdd.getNumPartitions() == 1
    assert folds.base.count() == 120 and folds.size == [30, 60, 90]
