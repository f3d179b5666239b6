"""Sums that do not depend on the order, and rounding by way of decimals."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rimshot.functions.exact import exact_avg, exact_sum
from rimshot.operators import metrics as M
from rimshot.plans.catalog import round_doubles, rounded_by_decimals


def _sum(spark, values, parts=1):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return df.agg(exact_sum("x").alias("s"), exact_avg("x").alias("a")).first()


def test_sum_is_rounded_once(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 1) for _ in range(500)] + [-rng.uniform(0, 1e9) for _ in range(200)] + [1e9, 2.0 ** 39, -2.0 ** 39]
    want = float(sum(Fraction(math.floor(v * 2 ** 60), 2 ** 60) for v in values))
    assert all(_sum(spark, rng.sample(values, len(values)), parts).s == want for parts in (1, 3, 8))
    assert _sum(spark, [0.1] * 10).s == float(sum([Fraction(0.1)] * 10))


def test_sum_of_odd_values(spark):
    assert _sum(spark, [None, None]).s is None and _sum(spark, []).a is None
    assert _sum(spark, [1.5, None, -0.25]) == (1.25, 0.625)
    assert _sum(spark, [1e300, 1.0, -1e300]).s in (1.0, 0.0) and _sum(spark, [math.inf, 1.0]).s == math.inf
    assert math.isnan(_sum(spark, [math.nan, 1.0]).s) and math.isnan(_sum(spark, [math.inf, -math.inf]).s)
    assert _sum(spark, [-1e-30, 0.5]).s == 0.5


def test_metrics_in_any_order(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 2), rng.random() if i % 3 else rng.randint(0, 10) / 10, rng.randint(0, 1)) for i in range(3000)]
    seen = set()
    for k in range(4):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "g int, y_prob double, y_true int").repartition(1 + 3 * k)
        cal = M.calibration(df, ["g"])
        seen.add((str(sorted(M.fold_metrics(df, ["g"]).collect())), str(sorted(cal.collect())), str(sorted(M.ece(cal, ["g"]).collect()))))
    assert len(seen) == 1


def test_halves_round_alike(spark):
    import duckdb

    rng = random.Random(2)
    halves = [(rng.randint(0, 10 ** 8) * 10 + 5) / 10 ** 7 for _ in range(3000)]
    values = halves + [math.nextafter(h, 0) for h in halves] + [math.nextafter(h, 9) for h in halves] + [-h for h in halves]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.x for r in round_doubles(df).orderBy("i").collect()]
    con = duckdb.connect()
    con.register("t", df.toPandas())
    want = [r[0] for r in con.execute(rounded_by_decimals("select round(x, 6) from t order by i")).fetchall()]
    assert got == want and got[:3000] == got[3000:6000] == got[6000:9000]
    odd = spark.createDataFrame([(math.inf,), (math.nan,), (None,), (1e300,)], "x double")
    assert str([r.x for r in round_doubles(odd).collect()]) == "[inf, nan, None, 1e+300]"


@pytest.mark.parametrize("sql, want", [
    ("select round(f(a, 2) + (b), 6) as x, round(y, 3), my_round(z, 6)",
     "select cast(round(cast(f(a, 2) + (b) as decimal(38, 12)), 6) as double) as x, round(y, 3), my_round(z, 6)"),
    ("round(abs(round(a, 6)), 6)", "cast(round(cast(abs(cast(round(cast(a as decimal(38, 12)), 6) as double)) as decimal(38, 12)), 6) as double)"),
])
def test_oracles_round_decimals(sql, want):
    assert rounded_by_decimals(sql) == want
