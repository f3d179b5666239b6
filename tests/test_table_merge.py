"""Merges into stored tables: what is pruned, what is rewritten, and the same result as the merge of whole frames."""

import os

from pyspark.sql import functions as F

from rimshot.operators import merge as U
from rimshot.operators import table_merge as TM
from rimshot.session import scratch_path


def _table(spark, rows, schema="part int, k long, v string"):
    path = scratch_path(spark, "table")
    spark.createDataFrame(rows, schema).repartition("part").write.partitionBy("part").parquet(path)
    return path


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("part", "k", "v").collect()), key=str)


def test_only_touched_partitions_are_read_and_written(spark):
    rows = [(p, p * 1000 + i, f"v{i}") for p in range(8) for i in range(50)]
    path = _table(spark, rows)
    before = _files(path)
    source = spark.createDataFrame([(3, 3007, "new"), (3, 3999, "more"), (9, 9000, "own")], "part int, k long, v string")
    folders = TM.merge_table(spark, path, source, ["k"], ["part"], lambda t, s: U.upsert(t, s, ["k"]))
    assert [os.path.basename(f) for f in folders] == ["part=3"]
    read = TM.read_folders(spark, path, folders, spark.read.parquet(path).schema)
    assert read.inputFiles() and all("/part=3/" in f for f in read.inputFiles())
    after = _files(path)
    assert {f: t for f, t in before.items() if "/part=3/" not in f}.items() <= after.items()
    want = {r[1]: r for r in rows} | {3007: (3, 3007, "new"), 3999: (3, 3999, "more"), 9000: (9, 9000, "own")}
    assert _rows(spark, path) == sorted(want.values(), key=str)


def test_ranges_and_filter_prune_the_scan(spark):
    path = _table(spark, [(0, i, "v") for i in range(20_000)])
    target = spark.read.parquet(path)
    source = spark.createDataFrame([(5000 + 7 * i,) for i in range(100)], "k long")
    left = TM.candidates(target.select("k"), source, ["k"])
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,5000)" in plan and "LessThanOrEqual(k,5693)" in plan and "v" not in left.columns
    kept = {r.k for r in left.collect()}
    assert {5000 + 7 * i for i in range(100)} <= kept and len(kept) < 110
    full = TM.bloom(target.select("k"), ["k"], 128)  # more keys than bits: everything passes
    assert target.where(TM.may_contain(full, ["k"], 128)).count() == 20_000


def test_moved_rows_null_keys_and_empty_sources(spark):
    rows = [(1, 1, "a"), (2, 2, "b"), (2, None, "n"), (None, 5, "p"), (4, 4, "d")]
    path = _table(spark, rows)
    assert TM.merge_table(spark, path, spark.createDataFrame([], "part int, k long, v string"), ["k"], ["part"],
                          lambda t, s: U.upsert(t, s, ["k"])) == []
    assert _rows(spark, path) == sorted(rows, key=str)
    source = spark.createDataFrame([(2, 1, "moved"), (2, None, "m")], "part int, k long, v string")
    TM.merge_table(spark, path, source, ["k"], ["part"], lambda t, s: U.upsert(t, s, ["k"]))
    assert not os.path.exists(os.path.join(path, "part=1"))  # its only row is in another partition now
    want = [(2, 1, "moved"), (2, 2, "b"), (2, None, "n"), (2, None, "m"), (None, 5, "p"), (4, 4, "d")]
    assert _rows(spark, path) == sorted(want, key=str)
    patch = spark.createDataFrame([(4, "D"), (77, "new")], "k long, v string")  # no partition columns
    TM.merge_table(spark, path, patch, ["k"], ["part"], lambda t, s: U.patch(t, s, ["k"], ["v"]))
    assert _rows(spark, path) == sorted([*want[:-1], (4, 4, "D"), (None, 77, "new")], key=str)


def test_guarded_upsert_of_a_table_equals_that_of_the_frame(spark):
    schema = "part int, k long, v string, is_manual_override boolean"
    rows = [(i % 5, i, f"v{i}", i % 3 == 0) for i in range(40)]
    path = _table(spark, rows, schema)
    source = spark.createDataFrame([(i % 5, i, None if i % 2 else "s", 1) for i in range(10, 60, 5)], "part int, k long, v string, seq int")
    how = lambda t, s: U.guarded_upsert(t, s, ["k"], ["v"], order=["seq"])
    want = how(spark.createDataFrame(rows, schema), source)
    folders = TM.merge_table(spark, path, source, ["k"], ["part"], how)
    assert len(folders) == 1
    cols = ["part", "k", "v", "is_manual_override"]
    assert sorted(map(tuple, spark.read.parquet(path).select(*cols).collect()), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)
    assert spark.read.parquet(path).where(F.col("k") == 10).first().v == "s"


def test_partition_values_with_odd_signs(spark):
    rows = [("Regular Season", 1, "a"), ("50% + x/y", 2, "b"), ("c:d", 3, "c")]
    path = _table(spark, rows, "part string, k long, v string")
    source = spark.createDataFrame([(i, v.upper()) for _, i, v in rows[:2]], "k long, v string")
    assert len(TM.merge_table(spark, path, source, ["k"], ["part"], lambda t, s: U.patch(t, s, ["k"], ["v"]))) == 2
    assert _rows(spark, path) == sorted([(p, k, v.upper() if k < 3 else v) for p, k, v in rows], key=str)
