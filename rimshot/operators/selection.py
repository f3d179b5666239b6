"""Exact values at given ranks without a sort: the range of each wanted rank is narrowed by histograms.

A pass counts, for every open range, the values in ``BUCKETS`` equal parts of it, with the least and the greatest value
of each part. The part that holds a rank becomes its next range, cut down to these two values; a range of one value is
done. When few different values are left in the open ranges, they are ordered as they are. A pass is one grouped sum with
a partial aggregate before the exchange, so a key that holds most rows is spread over all tasks, and nothing is sorted,
range-partitioned or stored but one row for each wanted rank. Wide ranges are cut on a logarithmic scale.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.session import checkpoint_dir

BUCKETS = 512
WIDE = 1e9  # half the width of a range that is cut on a logarithmic scale
FEW = 10_000  # different values in a range that are ordered as they are
DRIVER_RANKS = 200  # so many ranks' parts come to the driver: at most FEW rows for each range
MOST_RANKS = 50_000  # ranks that the driver holds between two passes


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _bucket(value: Column, lo: Column, hi: Column) -> Column:
    """The part of [lo, hi] that a value lies in. All steps are monotone, so parts are intervals; halves keep the
    difference of very great values finite."""
    def part(f):
        half = f(hi) / 2 - f(lo) / 2
        return F.floor((f(value) / 2 - f(lo) / 2) / F.when(half > 0, half) * BUCKETS).cast("int")

    at = F.when(hi / 2 - lo / 2 > WIDE, part(lambda x: F.signum(x) * F.log1p(F.abs(x)))).otherwise(part(lambda x: x))
    return F.coalesce(F.least(at, F.lit(BUCKETS - 1)), F.lit(0))


def at_ranks(counts: DataFrame, keys: list[str], value: str, n: str, wanted: DataFrame) -> DataFrame:
    """(keys, name, value): for each row (keys, name, rank) of ``wanted`` the value at that rank (from 0) among the
    key's values in ``counts`` (keys, value, n), each counted n times.

    ``counts`` may hold a value in several rows and is read once a pass; values are doubles without NaN and infinities.
    Ranks that a key does not have give no row.
    """
    checkpoint_dir(counts.sparkSession)
    ks = [f"_k{i}" for i in range(len(keys))]
    data = counts.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(value).cast("double").alias("_v"), F.col(n).alias("_n"))
    data = data.where(F.col("_v").isNotNull())
    whole = data.groupBy(*ks).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_n").alias("all"), F.count(F.lit(1)).alias("rows"))
    want = wanted.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], "name", F.col("rank").cast("long").alias("rank"))
    state = (want.join(whole, _same(want, whole, ks)).where((F.col("rank") >= 0) & (F.col("rank") < F.col("all")))
             .select(*[want[k] for k in ks], "name", "rank", "lo", "hi", "rows"))
    state, ranks, rows = _kept(state)
    if ranks <= DRIVER_RANKS:
        found = _few_ranks(data, ks, state)
        return found.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "name", F.col("_v").alias(value))
    done = []
    while True:
        done.append(state.where("lo = hi").select(*ks, "name", F.col("lo").alias("_v")))
        if not ranks:
            break
        state = state.where("lo < hi")
        ranges = state.select(*[F.col(k).alias(f"{k}r") for k in ks], "lo", "hi").distinct()
        if ranks <= MOST_RANKS:
            ranges = F.broadcast(ranges)
        on = _inside(ks)
        place = [*ks, "lo", "hi"]
        each = _parts(data.join(ranges, on), place, rows)
        # at most BUCKETS, or FEW, rows a range
        upto = F.sum("here").over(Window.partitionBy(*place).orderBy("from").rowsBetween(Window.unboundedPreceding, 0))
        each = each.withColumn("upto", upto)
        hit = (_same(state, each, place) & (state["rank"] < each["upto"]) & (state["rank"] >= each["upto"] - each["here"]))
        state = state.join(each, hit).select(
            *[state[k] for k in ks], state["name"], (state["rank"] - (each["upto"] - each["here"])).alias("rank"),
            each["from"].alias("lo"), each["to"].alias("hi"), each["rows"])
        state, ranks, rows = _kept(state)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "name", F.col("_v").alias(value))


def _inside(ks: list[str]) -> Column:
    on = F.col("_v").between(F.col("lo"), F.col("hi"))
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}r"))
    return on


def _parts(inside: DataFrame, place: list[str], rows: int) -> DataFrame:
    """(place, from, to, here, rows) of the parts of each range, or of its values where they are few."""
    if rows <= FEW:
        return inside.groupBy(*place, F.col("_v").alias("from")).agg(F.sum("_n").alias("here")).withColumns(
            {"to": F.col("from"), "rows": F.lit(1).cast("long")})
    return (inside.groupBy(*place, _bucket(F.col("_v"), F.col("lo"), F.col("hi")).alias("b"))
            .agg(F.sum("_n").alias("here"), F.min("_v").alias("from"), F.max("_v").alias("to"), F.count(F.lit(1)).alias("rows")))


def _few_ranks(data: DataFrame, ks: list[str], state: DataFrame) -> DataFrame:
    """The passes for at most ``DRIVER_RANKS`` ranks: the parts of their ranges, at most ``BUCKETS`` or ``FEW`` each, come
    to the driver, so that a pass is one exchange."""
    spark = data.sparkSession
    kinds = ", ".join(f"{k}r {t}" for k, t in state.dtypes if k in ks)
    todo, done = [], []
    for r in state.collect():
        todo.append((tuple(r[k] for k in ks), r["name"], r["rank"], r["lo"], r["hi"], r["rows"]))
    while todo:
        done += [(*key, name, lo) for key, name, _, lo, hi, _ in todo if lo == hi]
        todo = [t for t in todo if t[3] < t[4]]
        if not todo:
            break
        places = list({(*key, lo, hi) for key, _, _, lo, hi, _ in todo})
        ranges = F.broadcast(spark.createDataFrame(places, f"{kinds}, lo double, hi double" if ks else "lo double, hi double"))
        found: dict[tuple, list] = {}
        for r in _parts(data.join(ranges, _inside(ks)), [*ks, "lo", "hi"], max(t[5] for t in todo)).collect():
            found.setdefault((tuple(r[k] for k in ks), r["lo"], r["hi"]), []).append(r)
        for parts in found.values():
            parts.sort(key=lambda r: r["from"])
        narrower = []
        for key, name, rank, lo, hi, _ in todo:
            for part in found[key, lo, hi]:
                if rank < part["here"]:
                    narrower.append((key, name, rank, part["from"], part["to"], part["rows"]))
                    break
                rank -= part["here"]
        todo = narrower
    return spark.createDataFrame(done, state.select(*ks, "name", F.col("lo").alias("_v")).schema)


def _kept(state: DataFrame) -> tuple[DataFrame, int, int]:
    """The ranks of a pass evaluated once: (them, how many are open, the most different values in a range). Up to
    ``MOST_RANKS`` rows are held by the driver; more are written to the shared folder."""
    spark = state.sparkSession
    rows = state.limit(MOST_RANKS + 1).collect()
    if len(rows) <= MOST_RANKS:
        open_ = [r["rows"] for r in rows if r["lo"] < r["hi"]]
        return spark.createDataFrame(rows, state.schema), len(open_), max(open_, default=0)
    path = f"{checkpoint_dir(spark).rstrip('/')}/ranks-{uuid.uuid4().hex}"
    state.write.parquet(path)
    state = spark.read.schema(state.schema).parquet(path)
    left = state.where("lo < hi").agg(F.count(F.lit(1)).alias("ranks"), F.max("rows").alias("rows")).first()
    return state, left["ranks"], left["rows"] or 0


_GREATEST = 1.7976931348623157e308


def quantiles(counts: DataFrame, keys: list[str], value: str, qs: dict[str, float], n: str = "_n") -> DataFrame:
    """Exact quantiles per group with linear interpolation (numpy / pandas default) from (keys, value, n) counts:
    ``h = (N - 1) q`` lies between two ranks. Nulls and NaN do not count, infinities are the greatest numbers; a group
    without values has no row."""
    v = F.col(value).cast("double")
    known = (counts.where(v.isNotNull() & ~F.isnan(v))
             .select(*keys, F.greatest(F.least(v, F.lit(_GREATEST)), F.lit(-_GREATEST)).alias(value), n))
    h = {name: (F.col("_total") - 1) * F.lit(float(q)) for name, q in qs.items()}
    ranks = F.array(*[F.struct(F.lit(f"{name}_{part}").alias("name"), rank(h[name]).cast("long").alias("rank"))
                      for name in qs for part, rank in (("lo", F.floor), ("hi", F.ceil))])
    total = known.groupBy(*keys).agg(F.sum(n).alias("_total")).checkpoint()
    found = at_ranks(known, keys, value, n, total.select(*keys, F.explode(ranks).alias("_r")).select(*keys, "_r.*"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == f"{name}_{part}", F.col(value))).alias(f"_{name}_{part}")
                                      for name in qs for part in ("lo", "hi")])
    out = []
    for name in qs:
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (h[name] - F.floor(h[name]))).alias(name))
    return wide.join(total, _same(wide, total, keys)).select(*[wide[k] for k in keys], *out)


CUTS = 64
FEW_VALUES = 20_000  # different values of a column that are ordered on the driver


def row_at(df: DataFrame, order: list[str], rank: int) -> dict | None:
    """The values of ``order`` of the row at ``rank`` (from 0) in the total order of these columns (numbers, dates or
    strings, nulls first), or None. Column by column: the values of the first are counted, the rank's value is found,
    and the rows that have it go on to the next. ``df`` is read a few times a column and should be stored."""
    found: dict = {}
    for i, c in enumerate(order):
        hit = _value_at(df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, rank)
        if hit is None:
            return None
        found[c], below, n = hit
        rank -= below
        df = df.where(F.col(c).eqNullSafe(F.lit(found[c]).cast(dict(df.dtypes)[c])))
        rest = order[i + 1:]
        if rest and n <= FEW_VALUES:  # the rows with the values so far
            rows = sorted(df.select(*rest).collect(), key=lambda r: [(False,) if v is None else (True, v) for v in r])
            return {**found, **rows[rank].asDict()}
    return found


def _value_at(counted: DataFrame, c: str, rank: int) -> tuple | None:
    """(value, rows below it, rows with it) of the value that holds ``rank`` in a table (value, _n) of different values. Tables of
    many values are cut at about ``CUTS`` of them, chosen by hash, and the part that holds the rank is cut again."""
    below, turn = 0, 0
    kind = dict(counted.dtypes)[c]
    while True:
        rows = counted.limit(FEW_VALUES + 1).collect()
        if len(rows) <= FEW_VALUES:
            for r in sorted(rows, key=lambda r: (False,) if r[c] is None else (True, r[c])):
                if rank < below + r["_n"]:
                    return r[c], below, r["_n"]
                below += r["_n"]
            return None
        turn += 1
        some = counted.where(F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(max(1, counted.count() // CUTS))) == 0)
        cuts = sorted(r[c] for r in some.select(c).limit(4 * CUTS).collect() if r[c] is not None)
        edges = F.array(*[F.lit(x).cast(kind) for x in cuts]) if cuts else F.array().cast(f"array<{kind}>")
        part = F.when(F.col(c).isNull(), -1).otherwise(F.size(F.filter(edges, lambda e: e < F.col(c))))
        for r in sorted(counted.groupBy(part.alias("_p")).agg(F.sum("_n").alias("_n")).collect()):
            if rank < below + r["_n"]:
                counted = counted.where(part == r["_p"])
                break
            below += r["_n"]
        else:
            return None
