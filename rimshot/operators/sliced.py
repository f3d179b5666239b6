"""Ordered work per key in slices, so that a key with very many rows is spread over many tasks.

A key's rows are cut into slices along the first order column: a slice ends when it has about ``SLICE_ROWS`` rows,
counted from a small table (key, first order column) -> rows. Windows then run per (key, slice). What a slice needs
from those before it is brought to it: copies of the last few rows (the halo of a bounded frame) and running totals
(for frames that begin with the key). Where every key has one slice there is nothing to bring, and the windows are
the plain ones: one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.session import checkpoint_dir, stored

SLICE_ROWS = 4096
FEW_ROWS = 200_000  # so many (key, first order column) rows are sent to every task; more are joined by an exchange


def _on(left: DataFrame, right: DataFrame, pairs: dict[str, str]):
    cond = None
    for a, b in pairs.items():
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def spread(df: DataFrame, keys: list[str], order: list[str], halo: int = 0, sums: tuple[str, ...] = (),
           calendar: DataFrame | None = None, slice_rows: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, ``_halo`` (whether the row is a copy for a later slice) and the totals of all slices
    before: ``_before`` (rows) and, for each of ``sums``, ``_sum_<c>`` and ``_cnt_<c>`` (of its values).

    Rows of one value of the first order column stay in one slice. Null keys are a key like any other.
    ``calendar`` may name a cheaper frame with the keys and the first order column that holds every row of ``df``
    at least (slices are only as fine as counted there). A slice has about ``slice_rows`` rows (``SLICE_ROWS`` if not
    given). One grouped count runs while the plan is built.
    """
    by = order[0]
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    checkpoint_dir(df.sparkSession)
    counts = (calendar if calendar is not None else df).groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy(by)
    cut = counts.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(by).alias("_by"), F.floor(
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / (slice_rows or SLICE_ROWS)).alias("_slice"))
    later = cut.where("_slice > 0").checkpoint()
    n_later = later.count()
    if not n_later:
        zero = F.lit(0).cast("long")
        return df.select("*", zero.alias("_slice"), F.lit(False).alias("_halo"), zero.alias("_before"),
                         *[zero.alias(f"_sum_{c}") for c in sums], *[zero.alias(f"_cnt_{c}") for c in sums])
    # what is known of slices has a row for each of ``later`` at most, and rows of ``df`` need not move to meet it
    small = F.broadcast if n_later <= FEW_ROWS else (lambda d: d)
    placed = df.join(small(later), _on(df, later, {**names, by: "_by"}), "left").select(df["*"], F.coalesce("_slice", F.lit(0)).alias("_slice"))
    placed = stored(placed)
    big = later.select(*names.values()).distinct()
    several = placed.join(small(big), _on(placed, big, names), "left_semi")
    days = stored(several.groupBy(*keys, "_slice", by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums], *[F.count(c).alias(f"_c_{c}") for c in sums]))
    total = days.groupBy(*keys, "_slice").agg(
        F.sum("_n").alias("_n"), *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in sums], *[F.sum(f"_c_{c}").alias(f"_c_{c}") for c in sums])
    slices = Window.partitionBy(*keys).orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(
        *[F.col(k).alias(n) for k, n in names.items()], F.col("_slice").alias("_at"), F.sum("_n").over(earlier).alias("_before"),
        *[F.sum(f"_s_{c}").over(earlier).alias(f"_sum_{c}") for c in sums],
        *[F.sum(f"_c_{c}").over(earlier).alias(f"_cnt_{c}") for c in sums]).where("_at > 0")
    parts = placed.withColumn("_halo", F.lit(False))
    if halo:
        # the next slices, as far as fewer than ``halo`` rows lie between
        following = total.select(
            *[F.col(k).alias(n) for k, n in names.items()], F.col("_slice").alias("_at"),
            F.collect_list(F.struct("_slice", "_n")).over(slices.rowsBetween(1, halo)).alias("_next"))
        targets = following.select(*names.values(), "_at", F.posexplode("_next").alias("_i", "_t"), "_next").select(
            *names.values(), "_at", F.col("_t._slice").alias("_target"),
            F.aggregate(F.slice("_next", 1, F.col("_i")), F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_between"))
        # the last rows of a slice lie in its last dates; only the rows of these are ranked
        rest = Window.partitionBy(*keys, "_slice").orderBy(by).rowsBetween(1, Window.unboundedFollowing)
        last = (days.withColumn("_after", F.coalesce(F.sum("_n").over(rest), F.lit(0))).where(F.col("_after") < halo)
                .select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_slice").alias("_at"), F.col(by).alias("_by")))
        late = several.join(small(last), _on(several, last, {**names, "_slice": "_at", by: "_by"}), "left_semi")
        back = Window.partitionBy(*keys, "_slice").orderBy(*[F.col(o).desc_nulls_last() for o in order])
        ends = late.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= halo)
        near = F.broadcast(targets) if n_later * halo <= FEW_ROWS else targets  # a slice has ``halo`` targets at most
        copies = ends.join(near, _on(ends, targets, {**names, "_slice": "_at"})).where(F.col("_between") + F.col("_back") <= halo)
        parts = parts.unionByName(copies.select(*[ends[c] for c in df.columns], F.col("_target").alias("_slice"), F.lit(True).alias("_halo")))
    if sums:  # dealt out first, so that the totals of a slice, which are the same in all its rows, are not
        parts = parts.repartition(*keys, "_slice")
    out = parts.join(small(before), _on(parts, before, {**names, "_slice": "_at"}), "left")
    return out.select(parts["*"], F.coalesce("_before", F.lit(0)).alias("_before"),
                      *[F.coalesce(F.col(f"_sum_{c}"), F.lit(0)).alias(f"_sum_{c}") for c in sums],
                      *[F.coalesce(F.col(f"_cnt_{c}"), F.lit(0)).alias(f"_cnt_{c}") for c in sums])


def slice_window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_slice").orderBy(*order)
