"""Incremental loads as Structured Streaming jobs.

X1: order-book snapshots land as JSON files; each becomes a quote (S6). Every micro-batch is merged into the quote
table with insert-ignore (U2): the first row per key within the batch, then only keys that the table does not hold.
The table is partitioned by the quote's date and a batch reads the dates it touches only, so a quote may come as
late as it likes, and no state is kept in the stream.

X2, the daily load of all feeds, is in ``rimshot.streaming.daily``.

Both keep their progress in a checkpoint location and can run with ``availableNow`` (process what landed, then
stop) or a processing-time trigger. A batch that is run again after a failure changes nothing that it already did.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.operators.market import book_quotes
from rimshot.operators.merge import _first_per_key
from rimshot.session import checkpoint_dir
from rimshot.streaming.daily import exists

BOOK_FILE_SCHEMA = "snapshot_id long, game_id long, book string"
QUOTE_KEYS = ["asof_ts", "game_id"]


def quote_stream(spark: SparkSession, landing: str, table: str, checkpoint: str,
                 available_now: bool = True, files_per_trigger: int = 1):
    """Landed book snapshots -> quotes, added to ``table`` (partitioned by ``quote_date``) with insert-ignore.

    Of several snapshots with one key in a batch the least ``snapshot_id`` counts; a stored quote is never replaced.
    """
    src = (spark.readStream.schema(BOOK_FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
                .json(landing))
    quotes = book_quotes(src)

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = _first_per_key(batch, QUOTE_KEYS, [F.col("snapshot_id")]).withColumn("quote_date", F.to_date("asof_ts"))
        if exists(spark, table):
            checkpoint_dir(spark)
            new = new.checkpoint()
            # the dates of one batch of files; the scan of the stored quotes is pruned to them
            dates = [r.quote_date for r in new.select("quote_date").distinct().collect()]
            held = spark.read.parquet(table).where(F.col("quote_date").isin(dates)).select(*QUOTE_KEYS)
            new = new.join(held, QUOTE_KEYS, "left_anti")
        new.write.mode("append").partitionBy("quote_date").parquet(table)

    w = quotes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


LANDED_ROWS = 1_000_000  # rows of a landed table for each file that a delivery is cut into


def files_of(df: DataFrame) -> int:
    """Into how many files a delivery of the stored ``df`` is cut: one for each ``LANDED_ROWS`` of all its rows."""
    return max(1, -(-df.count() // LANDED_ROWS))


def land_in_time_order(df: DataFrame, folder: str, ts_col: str, n_chunks: int, fmt: str = "json",
                       files: int | None = None, by: tuple = ()) -> None:
    """Landing helper: write ``df`` as ``n_chunks`` event-time ranges, one after another, so the file
    stream (which orders new files by modification time) sees them in time order. ``chunk`` (0-based)
    may be supplied by the caller to place rows explicitly; otherwise it is the time range of ``ts_col``.
    With ``files`` each chunk is cut into so many files by the hash of ``by``; rows that are equal there share one.
    Chunks without rows are left out then, so that batches of ``files`` files are deliveries."""
    if "chunk" not in df.columns:
        ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              F.col(ts_col).cast("timestamp_ntz"))
        lo, hi = df.agg(F.min(ms), F.max(ms)).first()
        df = df.withColumn("chunk", F.floor((ms - F.lit(lo)) * n_chunks / F.lit(hi - lo + 1)).cast("int"))
    found = range(n_chunks)
    if files and files > 1:
        found = sorted(r["chunk"] for r in df.select("chunk").distinct().collect() if r["chunk"] is not None)
    for i in found:
        part = df.where(F.col("chunk") == i).drop("chunk")
        if files:
            part = part.repartition(files, *by)
        part.write.mode("overwrite").format(fmt).save(os.path.join(folder, f"chunk-{i:05d}"))
