"""Global ordering without a single-partition window (W11 time split, O3 slices, O1/O2 sorts).

``global_row_number`` numbers rows 1..n in a total order the way a
``row_number() over (order by ...)`` would, but without funnelling every row
through one task: the data is range-partitioned on the order (a distributed
sort), each partition counts its rows, the tiny per-partition count table
gives each partition its offset, and rows are numbered inside their
partition in sorted order. Only the count table (one row per partition)
is broadcast; its size is bounded by the partition count, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.operators.selection import row_at
from rimshot.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id in the upper bits, row index in the lower 33


def global_row_number(df: DataFrame, order: list[str | Column], num_partitions: int | None = None,
                      out: str = "row_num", total: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order`` (which must be a total order).

    With ``total`` set, the row count of the whole frame is added under that name.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled from the input, whose row order after a shuffle is
    # not reproducible; a reliable checkpoint pins one partition assignment so the
    # per-partition counts and the row positions come from the same stored rows
    # (and a lost executor re-reads them instead of re-sampling).
    d = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id())).checkpoint(eager=True)
    d = d.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a window over it is a window over a few hundred rows
    offs = counts.select("_pid", (F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(F.lit(0))).alias("_total"))
    res = (d.join(F.broadcast(offs), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local") + 1))
    if total:
        res = res.withColumnRenamed("_total", total)
    return res.drop("_pid", "_mid", "_local", "_off", "_total")


def time_split(df: DataFrame, order: list[str], frac: float = 0.8, out: str = "split", is_stored: bool = False) -> DataFrame:
    """Chronological split; the first ``cut = max(min(int(n*frac), n-1), 1)`` rows are 'fit', the rest 'calib'.

    ``df`` is stored (unless it is read from a stored frame), the row at the cut is found by selection, without a sort,
    and every row is compared with it."""
    checkpoint_dir(df.sparkSession)
    if not is_stored:
        df = df.checkpoint()
    n = df.count()
    cut = row_at(df, order, max(min(int(n * frac), n - 1), 1) - 1) if n else None
    if cut is None:
        return df.withColumn(out, F.lit("fit"))
    mine = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    kinds = dict(df.dtypes)
    edge = F.struct(*[F.struct(F.lit(cut[c] is not None), F.lit(cut[c]).cast(kinds[c])) for c in order])
    return df.withColumn(out, F.when(mine <= edge, "fit").otherwise("calib"))


def slice_rows(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """O3: rows at positions [start, end) (0-based) of the total order."""
    numbered = global_row_number(df, order, out="_rn")
    return numbered.where((F.col("_rn") > start) & (F.col("_rn") <= end)).drop("_rn")


def value_counts(df: DataFrame, keys: list[str], value: str, out: str = "_n") -> DataFrame:
    """(keys, value as double, count): what quantiles and other statistics of a group need, reduced map-side."""
    return df.select(*keys, F.col(value).cast("double").alias(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(out))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def keyed_prefix_sums(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
                      num_partitions: int | None = None) -> DataFrame:
    """``df`` with, per key in ``order``, inclusive running sums ``_s_<c>`` of the integer columns ``cols``, without
    a window over a whole key.

    Rows are range-partitioned on (keys, order), so a hot key is spread over many partitions (the partition
    assignment is pinned with a reliable checkpoint). Running sums are computed per (partition, key) slice; each
    slice's totals form a table of at most (partitions x keys per partition) rows, whose running sum over partition
    order gives every slice its offset.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = (df.select(*df.columns, *[F.col(c).cast("long").alias(f"_x_{c}") for c in cols])
           .repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
           .withColumn("_pid", F.spark_partition_id())).checkpoint(eager=True)
    local_w = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(f"_x_{c}").over(local_w).alias(f"_l_{c}") for c in cols])
    tot = d.groupBy("_pid", *keys).agg(*[F.sum(f"_x_{c}").alias(f"_t_{c}") for c in cols])
    prev = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{c}").over(prev), F.lit(0)).alias(f"_o_{c}") for c in cols])
    j = local.join(offs, _same(local, offs, ["_pid", *keys]))
    return j.select(*[local[c] for c in df.columns], *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"_s_{c}") for c in cols])


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """The ``k`` first rows per group under ``order`` (which must be total), ranked 1..k. Spark cuts every group to
    k rows within each input partition before the shuffle (window group limit), so no task holds a hot group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
