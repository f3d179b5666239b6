"""Each row of a table together with the next row of the descending order, by one shuffle and no global sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimshot.llm.worker import small_batches


def with_next(df: DataFrame, key: str, value: str, work: Callable, schema: str) -> DataFrame:
    """``work`` over iterators of (key, value, next value), by descending key; after the last row comes the first.

    Ranges of the key are cut at approximate quantiles. A range gets, besides its own rows, a copy of the row that
    opens the range after it, so every task sees the successor of its last row. Null keys come last; equal keys
    are ordered by value, descending, so repeated rows follow each other.
    """
    spark = df.sparkSession
    small_batches(spark)
    source = df.select(F.col(key).cast("long").alias("k"), F.col(value).alias("v"))
    wanted = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = source.stat.approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    # range 0 holds the largest keys; nulls stand below all
    place = F.lit(0)
    if cuts:
        place = F.when(F.col("k").isNull(), F.lit(len(cuts))).otherwise(
            F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("k"))))
    placed = source.select(place.cast("int").alias("range"), "k", "v")
    # the first row of each range, without its text: as many rows as there are ranges come to the driver
    heads = sorted((r["range"], r["k"]) for r in placed.groupBy("range").agg(F.max("k").alias("k")).collect())
    if not heads:
        return spark.createDataFrame([], schema)
    # a range's first row also goes to the range before it; that of the first range to the last
    moves = spark.createDataFrame([(r, k, heads[i - 1][0]) for i, (r, k) in enumerate(heads)], "r int, head long, target int")
    opening = placed.join(F.broadcast(moves), (F.col("range") == F.col("r")) & F.col("k").eqNullSafe(F.col("head")))
    # of equal keys the one with the largest value opens the range
    edges = (opening.groupBy("target", "k").agg(F.max("v").alias("v"))
             .select(F.col("target").alias("range"), "k", "v", F.lit(1).alias("edge")))
    rows = placed.select("range", "k", "v", F.lit(0).alias("edge")).unionByName(edges)
    dealt = (rows.repartitionById(heads[-1][0] + 1, F.col("range"))
             .sortWithinPartitions(F.col("edge"), F.col("k").desc_nulls_last(), F.col("v").desc_nulls_last()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_with_next():
            held = None
            for batch in batches:
                for k, v, edge in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if held is not None:
                        yield (*held, v)
                    held = None if edge else (k, v)

        return work(rows_with_next())

    return dealt.select("k", "v", "edge").mapInArrow(run, schema)
