"""Session construction, the shared checkpoint folder, and frames that are stored for as long as a job needs them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every rimshot job relies on. AQE re-plans joins and coalesces
# shuffle partitions at run time; skew-join splitting handles hot keys
# (one team-season or one market holding a large share of rows).
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is known to be small: dimension tables are a few
    # thousand rows; anything bigger goes through a sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "rimshot", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone.
    Only on a local master (tests) a scratch folder is made where it is unset; elsewhere a folder of one machine
    would lose what other machines need, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="rimshot-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint directory (landing areas of test loads)."""
    base = checkpoint_dir(spark)
    base = base[len("file:"):] if base.startswith("file:") else base
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


# Shuffle files go when the execution that wrote them has ended, not when the driver's JVM happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDER: ContextVar[str | None] = ContextVar("folder of the innermost job", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Work whose ``stored`` frames go when it ends, and whose shuffle files go as soon as an execution has ended.

    What the work returns must not be read from a ``stored`` frame later on: it is small and checkpointed, or ``settled``.
    """
    folder, before = scratch_path(spark, "job"), spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        spark.conf.set(SHUFFLES_GO, before)
        remove(spark, folder)


def stored(df: DataFrame) -> DataFrame:
    """``df`` evaluated once: as parquet for the innermost ``job``, or as a reliable checkpoint where there is none."""
    return _stored(df, _FOLDER.get())


def _stored(df: DataFrame, folder: str | None) -> DataFrame:
    if folder is None or "void" in dict(df.dtypes).values():
        checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    path = os.path.join(folder, uuid.uuid4().hex[:12])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` builds, ``stored``; what was stored on the way to it goes."""
    folder = _FOLDER.get()
    with job(spark):
        return _stored(make(), folder)
