"""Merges into a partitioned Parquet table that read and rewrite only the partitions they touch.

``merge`` has the merges on frames; here the target is a folder, and most of it is never read:

1. **Ranges.** The least and the greatest value of each key in the source (one row for the driver) become range filters
   of the target's scan, so Parquet skips row groups outside them.
2. **Bloom filter.** The source's keys set bits of a filter of fixed size, built by a grouped ``bit_or``; target rows
   whose key has an unset bit are dropped in the scan's stage, before any exchange. A source with more keys than the
   filter was made for only fills it up: fewer rows are dropped, none wrongly.
3. **Touched partitions.** What is left, only keys and the file's name, is matched with the source exactly. The folders
   of the matching files, and those of the partitions that new rows belong to, are the touched ones.
4. **Merge and rewrite.** Only these folders are read, merged with the source by any merge of ``merge``, stored by
   ``checkpoint()``, and replaced. A partition that loses its last row goes.

Null keys match nothing, so they prune like keys that are not in the source.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rimshot.operators.merge import replace_slice
from rimshot.session import checkpoint_dir

BLOOM_BITS = 1 << 18  # 4096 longs in the plan; about 1 % of other keys pass with 27,000 keys
HASHES = 4


def _bits(keys: list[str], bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *[F.col(k) for k in keys]), F.lit(bits)) for i in range(HASHES)])


def bloom(source: DataFrame, keys: list[str], bits: int = BLOOM_BITS) -> list[int]:
    """The words of 64 bits of a Bloom filter of the source's keys."""
    words = (source.select(F.explode(_bits(keys, bits)).alias("bit"))
             .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("bits")))
    out = [0] * ((bits + 63) // 64)
    for r in words.collect():  # one row for each word at most
        out[r["word"]] = r["bits"]
    return out


def may_contain(words: list[int], keys: list[str], bits: int = BLOOM_BITS) -> Column:
    """Whether a row's keys can be among those that the filter was made of."""
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one constant

    def is_set(bit: Column) -> Column:
        word = F.get(table, F.shiftright(bit, 6).cast("int"))
        return F.getbit(word, F.pmod(bit, F.lit(64)).cast("int")) == 1

    return F.forall(_bits(keys, bits), is_set)


def candidates(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``target`` whose keys lie in the source's ranges and pass its Bloom filter."""
    ends = source.agg(*[f(k).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if any(e is None for e in ends):  # no source row has all keys
        return target.where(F.lit(False))
    kinds = dict(target.dtypes)
    ranges = [F.col(k).between(F.lit(ends[f"lo_{i}"]).cast(kinds[k]), F.lit(ends[f"hi_{i}"]).cast(kinds[k])) for i, k in enumerate(keys)]
    return target.where(reduce(lambda a, b: a & b, ranges)).where(may_contain(bloom(source, keys), keys))


def _folders(df: DataFrame) -> DataFrame:
    # the path is given as a URI, so signs such as spaces in a partition's value are encoded
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select(F.regexp_replace(path, "/[^/]+$", "").alias("folder"))


def touched_folders(target: DataFrame, source: DataFrame, keys: list[str]) -> list[str]:
    """The partition folders that hold a key of ``source``. One name a partition comes to the driver, which lists the
    table's partitions in any case."""
    kinds = dict(target.dtypes)
    source = source.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys])
    known = candidates(target.select(*keys, "_metadata"), source, keys)
    return _names(known.join(source, keys, "left_semi"))


def _names(df: DataFrame) -> list[str]:
    return sorted(r["folder"] for r in _folders(df.select("_metadata")).distinct().collect())


def folders_of(target: DataFrame, rows: DataFrame, partition_cols: list[str]) -> list[str]:
    """The folders of the partitions that ``rows`` belong to, of those that the table has."""
    kinds, out = dict(target.dtypes), set()
    values = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in partition_cols]).distinct().collect()
    for start in range(0, len(values), 500):
        mine = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c]).cast(kinds[c])) for c in partition_cols])
                for r in values[start: start + 500]]
        out |= set(_names(target.where(reduce(lambda a, b: a | b, mine))))
    return sorted(out)


def read_folders(spark: SparkSession, path: str, folders: list[str], schema: StructType) -> DataFrame:
    """The rows of some partition folders of the table at ``path``."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def merge_table(spark: SparkSession, path: str, source: DataFrame, keys: list[str], partition_cols: list[str],
                merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
    """Merge ``source`` into the Parquet table at ``path``, partitioned by ``partition_cols``; returns the folders that
    were read and rewritten.

    ``merge`` takes (rows of the touched partitions, source) and returns their new rows, such as ``upsert``,
    ``guarded_upsert`` or ``patch`` with their arguments. New rows may lie in partitions that the table does not have
    yet; existing partitions that they lie in are touched as well. An empty source changes nothing.
    """
    checkpoint_dir(spark)
    source = source.checkpoint()
    if source.isEmpty():
        return []
    table = spark.read.parquet(path)
    schema = table.schema
    folders = touched_folders(table, source, keys)
    if all(c in source.columns for c in partition_cols):
        folders = sorted({*folders, *folders_of(table, source, partition_cols)})
    while True:
        merged = merge(read_folders(spark, path, folders, schema), source).select(*schema.names).checkpoint()
        filled = folders_of(table, merged, partition_cols)
        if set(filled) <= set(folders):
            break
        folders = sorted({*folders, *filled})
    if not merged.isEmpty():
        replace_slice(merged, path, partition_cols)
    for folder in set(folders) - set(filled):  # lost their last row
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return folders
