"""Arithmetic shuffles: bijections, spread, and what permutation importance makes of them."""

import pytest
from pyspark.sql import functions as F

from rimshot.functions.shuffles import WALK, rectangle, shuffled
from rimshot.operators import models as ML


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 30, 31, 97, 1600, 5003])
def test_shuffles_are_bijections(spark, n):
    a, b = rectangle(n)
    assert a * b >= n and (a * b - n < a or n == 1) and (n > WALK ** 2 or a <= WALK)
    got = spark.range(n).select("id", *[shuffled(F.col("id"), n, F.lit(k)).alias(f"k{k}") for k in range(4)]).toPandas()
    for k in range(4):
        assert sorted(got[f"k{k}"]) == list(range(n))
    if n > 30:
        assert len({tuple(got[f"k{k}"]) for k in range(4)}) == 4


def test_shuffles_are_even(spark):
    """Over many keys each place takes each number about equally often."""
    n, keys = 7, 6000
    got = (spark.range(keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
           .groupBy("i", shuffled(F.col("i"), n, F.col("id")).alias("at")).count().collect())
    assert len(got) == n * n and all(abs(r["count"] - keys / n) < 0.2 * keys / n for r in got)


def test_permuted_rows_keep_their_values(spark):
    t = spark.createDataFrame([(i, float(i), float(-i), i % 2) for i in range(40)], "id long, a double, b double, y int").repartition(3)
    rows = ML.permuted(t, ["a", "b"], "id", repeats=5).collect()
    assert len(rows) == 40 * 2 * 5
    for f, other in (("a", "b"), ("b", "a")):
        for rep in range(5):
            mine = [r for r in rows if r._feature == f and r._rep == rep]
            assert sorted(r[f] for r in mine) == sorted((1 if f == "a" else -1) * float(i) for i in range(40))
            assert all(r[other] == (1 if other == "a" else -1) * r.id for r in mine)
            assert sum(abs(r[f]) != r.id for r in mine) > 20
