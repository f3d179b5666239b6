"""The daily load of all feeds as one Structured Streaming job.

Feeds are folders of landed files: the game log, team and player box scores, and standings. One stream reads them all;
every micro-batch goes through ``foreachBatch``:

1. **Versioned rows.** Each row carries its delivery (the file's time and path). A table holds, for each key, the row
   of the last delivery, with that delivery. Merging is the maximum by delivery, so it does not depend on how files
   fall into batches, a late older file changes nothing, and a batch that is run again changes nothing.
2. **Partitions.** Tables are partitioned by season and a bucket of the key's hash. A batch reads and replaces only the
   partitions of its keys; a partition is stored elsewhere before it is replaced, unless nothing of the table was read.
   What a batch stores, and the shuffle files of each of its steps, go as soon as they are not needed (``session.job``).
3. **Dirty keys.** The games that a batch touches (by log or team box) are pivoted again (A2). Their team-seasons, as
   they were and as they are now, are dirty from the earliest touched date on. They are written to the ledger before
   the games change, so a batch that failed half-way passes on what it had found.
4. **Features.** For the dirty team-seasons the rolling features (W1-W3 over J1) are computed again; rows before the
   dirty date, and those of other teams, are carried over as they are.
5. **Ledger.** A batch ends with its entry in ``ledger/applied`` (rows by feed). A batch with an entry is skipped.

Rows without one of their keys go to ``rejected``. An empty batch does nothing (S14).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.operators.features import ROLLING_SPEC, rolling
from rimshot.operators.merge import last_per_key, replace_slice
from rimshot.operators.results import features_base, pivot_games, team_game_results
from rimshot.session import checkpoint_dir, job, remove, stored

DELIVERY = ["_at", "_file"]
BUCKETS = 4
MERGE_ROWS = 16_000_000  # rows of a batch that are merged at once, or those of one partition if these are more


@dataclass(frozen=True)
class Feed:
    """Columns of a feed's files, its keys (after the season, to which a key belongs), and the key that is bucketed."""

    schema: str
    keys: tuple[str, ...]
    bucket: str

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


_BOX = "fgm long, fga long, fg3m long, fg3a long, ftm long, fta long, oreb long, dreb long, ast long, turnovers long, pts long"
FEEDS = {
    "game_log": Feed("game_id long, season_start long, game_date date, season_type string, team_id long, pts long, "
                     "matchup string, wl string", ("season_start", "game_id", "team_id"), "game_id"),
    "team_box": Feed(f"game_id long, season_start long, team_id long, {_BOX}", ("season_start", "game_id", "team_id"), "game_id"),
    "player_box": Feed(f"game_id long, season_start long, player_id long, team_id long, minutes string, {_BOX}",
                       ("season_start", "game_id", "player_id"), "game_id"),
    "standings": Feed("season_start long, run_date date, team_id long, conference string, division long, wins long, losses long, "
                      "playoff_rank long", ("season_start", "run_date", "team_id"), "team_id"),
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, on any file system; what cannot be asked is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Warehouse:
    """The folders of one load and what is read from and written to them."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.buckets)).cast("int")

    def read(self, name: str, parts: list[tuple[int, int]] | None = None, seasons: list[int] | None = None) -> DataFrame | None:
        """A table, or only its partitions (season, bucket) or seasons; None if there is none yet."""
        if not exists(self.spark, self.path(name)):
            return None
        df = self.spark.read.parquet(self.path(name))
        df = df.withColumn("season_start", F.col("season_start").cast("long"))
        if parts is not None:
            df = self.of(df, parts)
        return df if seasons is None else df.where(F.col("season_start").isin(seasons))

    def of(self, df: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
        """The rows of these partitions."""
        return df.where(reduce(lambda a, b: a | b, [(F.col("season_start") == s) & (F.col("bucket") == b) for s, b in parts], F.lit(False)))

    def folder(self, name: str, part: tuple[int, int]) -> str:
        return self.path(f"{name}/season_start={part[0]}/bucket={part[1]}")

    def parts(self, df: DataFrame) -> list[tuple[int, int]]:
        """The partitions that hold rows of ``df``: at most the seasons of a batch times the buckets."""
        return sorted(tuple(r) for r in df.select("season_start", "bucket").distinct().collect())

    def replace(self, name: str, df: DataFrame, parts: list[tuple[int, int]]) -> None:
        """Replace these partitions by the rows of ``df``; those for which it has none go."""
        with job(self.spark):
            df = stored(df)
            left = self.parts(df)
            if left:
                replace_slice(df, self.path(name), ["season_start", "bucket"])
        for part in set(parts) - set(left):
            remove(self.spark, self.folder(name, part))

    def merge(self, name: str, rows: DataFrame, keys: list[str]) -> list[tuple[int, int]]:
        """Versioned rows into a table: of each key the last delivery stays. Partitions are merged one after another, as
        many at once as have ``MERGE_ROWS`` rows, so that the files of an exchange do not grow with the batch."""
        found = {(r["season_start"], r["bucket"]): r["n"] for r in
                 rows.groupBy("season_start", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        groups, n = [], 0
        for part in sorted(found):
            if not groups or n + found[part] > MERGE_ROWS:
                groups.append([])
                n = 0
            groups[-1].append(part)
            n += found[part]
        for some in groups:
            self._merge(name, self.of(rows, some) if len(groups) > 1 else rows, keys, some)
        return sorted(found)

    def _merge(self, name: str, rows: DataFrame, keys: list[str], parts: list[tuple[int, int]]) -> None:
        there = [p for p in parts if exists(self.spark, self.folder(name, p))]
        if there:
            rows = rows.unionByName(self.read(name, there).select(*rows.columns))
        kept = last_per_key(rows, keys, DELIVERY).select(*rows.columns)  # ties of one delivery by the greatest remaining columns
        if there:
            self.replace(name, kept, parts)
        else:  # new partitions: none is read while it is written, and all of them have rows
            replace_slice(kept, self.path(name), ["season_start", "bucket"])


def landed(spark: SparkSession, folders: dict[str, str], files_per_trigger: int) -> DataFrame:
    """One stream of all feeds' rows: ``_feed``, the delivery, and the columns of every feed (null in the others)."""
    parts = []
    for name, folder in folders.items():
        parts.append(spark.readStream.schema(FEEDS[name].schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).select(
            F.lit(name).alias("_feed"), F.col("_metadata.file_modification_time").alias("_at"),
            F.col("_metadata.file_path").alias("_file"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _team_days(games: DataFrame) -> DataFrame:
    sides = F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")
    return games.select("season_start", "game_date", sides).where(F.col("team_id").isNotNull())


class DailyLoad:
    """What one batch does; ``spec`` are the rolling features that are kept up to date."""

    def __init__(self, spark: SparkSession, root: str, spec: dict | None = None, buckets: int = BUCKETS):
        self.w = Warehouse(spark, root, buckets)
        self.spark, self.spec = spark, spec or ROLLING_SPEC

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        checkpoint_dir(self.spark)
        entry = self.w.path(f"ledger/applied/batch={batch_id}")
        if not exists(self.spark, entry):
            with job(self.spark), job(batch.sparkSession):  # a stream works in a session of its own
                self._apply(stored(batch), batch_id, entry)

    def _apply(self, batch: DataFrame, batch_id: int, entry: str) -> None:
        if batch.isEmpty():
            return
        names = [r["_feed"] for r in batch.select("_feed").distinct().collect()]
        rows = {name: self._valid(batch, name, batch_id) for name in names}
        for name in names:
            self.w.merge(name, rows[name], list(FEEDS[name].keys))
        games = [rows[n].select("season_start", "game_id") for n in ("game_log", "team_box") if n in rows]
        touched = reduce(DataFrame.unionByName, games).distinct().checkpoint() if games else None
        if touched is not None and not touched.isEmpty():
            self._features(self._games(touched, batch_id))
        (batch.groupBy("_feed").agg(F.count(F.lit(1)).alias("n_rows"), F.max("_at").alias("last_delivery"))
         .coalesce(1).write.mode("overwrite").parquet(entry))

    def _valid(self, batch: DataFrame, name: str, batch_id: int) -> DataFrame:
        feed = FEEDS[name]
        rows = batch.where(F.col("_feed") == name).select(*feed.columns, *DELIVERY)
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in feed.keys])
        bad = rows.where(~whole)
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(self.w.path(f"rejected/{name}/batch={batch_id}"))
        return rows.where(whole).withColumn("bucket", self.w.bucket(feed.bucket))

    def _games(self, touched: DataFrame, batch_id: int) -> DataFrame:
        """Touched games pivoted again and replaced; (season_start, team_id, since) that are dirty by it."""
        touched = touched.withColumn("bucket", self.w.bucket("game_id"))
        parts = self.w.parts(touched)
        log = self.w.read("game_log", parts)
        on = ["season_start", "game_id"]
        new = held = None
        if log is not None:
            new = pivot_games(log.join(touched.select(*on), on, "left_semi"), mode="daily").withColumn("bucket", self.w.bucket("game_id"))
        held = self.w.read("games", parts)
        days = [_team_days(g) for g in (new, held and held.join(touched.select(*on), on, "left_semi")) if g is not None]
        ledger = self.w.path(f"ledger/dirty/batch={batch_id}")
        if not exists(self.spark, f"{ledger}/_SUCCESS"):
            schema = "season_start long, team_id long, since date"
            dirty = (reduce(DataFrame.unionByName, days).groupBy("season_start", "team_id").agg(F.min("game_date").alias("since"))
                     if days else self.spark.createDataFrame([], schema))
            dirty.coalesce(1).write.mode("overwrite").parquet(ledger)
        if new is not None:
            if held is not None:
                new = new.unionByName(held.join(touched.select(*on), on, "left_anti").select(*new.columns))
            self.w.replace("games", new, parts)
        return self.spark.read.parquet(ledger)

    def _features(self, dirty: DataFrame) -> None:
        """Rolling features of dirty team-seasons from their dirty date on; all other rows stay as they are."""
        dirty = dirty.withColumn("bucket", self.w.bucket("team_id")).checkpoint()
        parts = self.w.parts(dirty)
        seasons = sorted({s for s, _ in parts})
        games, box = self.w.read("games", seasons=seasons), self.w.read("team_box", seasons=seasons)
        if not parts or games is None or box is None:
            return
        on = ["season_start", "team_id"]
        results = team_game_results(games).join(dirty.select(*on), on, "left_semi")
        stats = box.withColumn("reb", F.col("oreb") + F.col("dreb"))
        base = stored(features_base(results, stats))
        fresh = (rolling(base, self.spec).join(dirty.select(*on, "since"), on).where(F.col("game_date") >= F.col("since"))
                 .select("season_start", "game_id", "game_date", "team_id", "opp_team_id", "is_home", "is_win", *self.spec)
                 .withColumn("bucket", self.w.bucket("team_id")))
        held = self.w.read("features", parts)
        if held is not None:
            kept = (held.join(dirty.select(*on, "since"), on, "left")
                    .where(F.col("since").isNull() | (F.col("game_date") < F.col("since"))))
            fresh = fresh.unionByName(kept.select(*fresh.columns))
        self.w.replace("features", fresh, parts)


def daily_load_stream(spark: SparkSession, folders: dict[str, str], root: str, checkpoint: str, spec: dict | None = None,
                      buckets: int = BUCKETS, available_now: bool = True, files_per_trigger: int = 10):
    """Feed name -> folder of landed files (any of ``FEEDS``); tables ``game_log``, ``team_box``, ``player_box``,
    ``standings``, ``games`` and ``features`` under ``root``. Of several rows of one key the last delivered counts."""
    load = DailyLoad(spark, root, spec, buckets)
    w = landed(spark, folders, files_per_trigger).writeStream.foreachBatch(load.apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
