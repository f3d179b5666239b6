"""Merge semantics on immutable tables.

Core Spark has no MERGE for parquet, so each merge is a join that produces
the new table state; the caller writes it (``replace_slice`` overwrites only
the partitions present in the frame). Every merge is one shuffle on the key:
anti join + union for upserts, full outer join for column-wise merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions.expressions import normalize_game_id


def _first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep one row per key: the first by ``order``, and of equal ones the first by the remaining columns, nulls first."""
    if not order:
        raise ValueError("which row of a key is the first needs an order")
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """One row per key: the last by ``order`` (columns; later deliveries greater), ties and no order by the
    greatest remaining columns, nulls lowest. A grouped maximum of the order and the row, so copies are reduced before
    the shuffle and a row is in it once."""
    order = list(order or [])
    place = {o: f"_o{i}" for i, o in enumerate(order) if isinstance(o, str)}
    rest = [c for c in df.columns if c not in keys and c not in place]
    place |= {c: f"_r{i}" for i, c in enumerate(rest)}
    row = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)],
                   *[F.col(c).alias(place[c]) for c in rest])
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(
        *keys, *[F.col(f"_row.{place[c]}").alias(c) for c in df.columns if c not in keys])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of ``source`` replace target rows with the same key (all non-key columns); new keys insert.

    Of several source rows with one key the last by ``order`` counts, as in row-by-row upserts."""
    new = last_per_key(source, keys, order).select(*target.columns)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``ON CONFLICT DO NOTHING``: only source keys absent from the target are added, the first row of each by
    ``order``, the order in which rows would have been inserted."""
    new = _first_per_key(source, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def guarded_upsert(target: DataFrame, source: DataFrame, keys: list[str], coalesce_cols: list[str],
                   lock_col: str = "is_manual_override", order: list | None = None) -> DataFrame:
    """Upsert where ``coalesce_cols`` keep the old value when the new one is null, and a target
    row whose lock is true is left untouched (a null lock counts as unlocked). New rows get lock false.

    Of several source rows with one key the last by ``order`` gives each column; a coalesced column takes its
    last value that is not null, as applying the rows one after another would."""
    source = _applied_in_order(source, keys, coalesce_cols, order)
    t = target.withColumn("_tgt_flag", F.lit(True)).alias("t")
    s = source.withColumn("_src_flag", F.lit(True)).alias("s")
    j = t.join(s, keys, "full_outer")
    in_s = F.col("s._src_flag").isNotNull()
    in_t = F.col("t._tgt_flag").isNotNull()
    update = in_s & ~F.col(f"t.{lock_col}").eqNullSafe(F.lit(True))
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c == lock_col:
            cols.append(F.when(in_t, F.col(f"t.{c}")).otherwise(F.lit(False)).alias(c))
        elif c in source.columns:
            new = F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")) if c in coalesce_cols else F.col(f"s.{c}")
            cols.append(F.when(update, new).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}"))
    return j.select(*cols)


def _applied_in_order(source: DataFrame, keys: list[str], coalesce_cols: list[str], order: list | None) -> DataFrame:
    rest = [c for c in source.columns if c not in keys]
    by = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order or [])], *rest)
    cols = [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), by) if c in coalesce_cols else by)["v"].alias(c)
            for c in rest]
    return source.groupBy(*keys).agg(*cols)


def placeholder_dim(facts: DataFrame, dim: DataFrame, key: str, name_col: str, active_col: str) -> DataFrame:
    """Dimension rows for fact keys the dimension lacks: name 'UNKNOWN_<id>', inactive."""
    missing = facts.select(key).where(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")
    ph = missing.select(key, F.concat(F.lit("UNKNOWN_"), F.col(key).cast("string")).alias(name_col),
                        F.lit(False).alias(active_col))
    for c in dim.columns:
        if c not in ph.columns:
            ph = ph.withColumn(c, F.lit(None).cast(dict(dim.dtypes)[c]))
    return dim.unionByName(ph.select(*dim.columns))


def pending(work: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Work items not loaded yet, keys compared after E8 normalisation on both sides."""
    w = work.withColumn("_k", normalize_game_id(F.col(key)))
    d = done.select(normalize_game_id(F.col(done_key or key)).alias("_k")).distinct()
    return w.join(d, "_k", "left_anti").drop("_k")


def patch(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str], order: list | None = None) -> DataFrame:
    """Matched rows take the listed columns from the source (others kept); unmatched source rows insert.

    Of several source rows with one key the last by ``order`` counts. Null keys match nothing: such target rows
    stay and such source rows insert."""
    known = source.where(" and ".join(f"`{k}` is not null" for k in keys))
    source = last_per_key(known, keys, order).unionByName(
        source.where(" or ".join(f"`{k}` is null" for k in keys)), allowMissingColumns=True)
    s = source.withColumn("_src_flag", F.lit(True)).alias("s")
    t = target.withColumn("_tgt_flag", F.lit(True)).alias("t")
    j = t.join(s, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in cols and c in source.columns:
            out.append(F.when(F.col("s._src_flag").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            fallback = F.col(f"s.{c}") if c in source.columns else F.lit(None)
            out.append(F.when(F.col("t._tgt_flag").isNotNull(), F.col(f"t.{c}")).otherwise(fallback).alias(c))
    return j.select(*out)


def with_audit(df: DataFrame, *cols: str) -> DataFrame:
    """U8: audit timestamps (left out of compared output)."""
    for c in cols:
        df = df.withColumn(c, F.current_timestamp())
    return df


def replace_slice(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet") -> None:
    """Overwrite only the partitions present in ``df`` (delete-slice-then-append)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).format(fmt).save(path))
