"""Landed-file sources (S1, S2, S5, S8, S13-S16) and sinks.

Input is files that earlier extract jobs landed (CSV parts, JSON payloads,
partitioned directories). Reads use explicit schemas where the layout is
known; mixed-header CSV parts are read in one scan, and each record takes its
columns from its own file's header, so they are matched by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, paths, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. With a schema, ids stay text (inference would drop leading zeros)."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(paths)


#: Column groups of a box-score part: the ids under either feed's names.
PLAYER_IDS = (("gameId", "GAME_ID"), ("personId", "PLAYER_ID"))
TEAM_IDS = (("gameId", "GAME_ID"), ("teamId", "TEAM_ID"))


def _header_names(line: str) -> list[str]:
    return [c.strip().strip('"') for c in line.lstrip("\ufeff").strip().split(",")]


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (line, file), a file's in order, the first of every file."""
    seen: set[str] = set()
    for batch in batches:
        files = batch.column(1).dictionary_encode()
        new = [i for i, f in enumerate(files.dictionary.to_pylist()) if f not in seen]
        if new:
            seen.update(files.dictionary.take(pa.array(new)).to_pylist())
            yield batch.take(pa.array([pc.index(files.indices, i).as_py() for i in new]))


def read_csv_parts(spark: SparkSession, pattern_or_paths, required_all: tuple[tuple[str, ...], ...] = PLAYER_IDS) -> DataFrame | None:
    """S2 + T4: many CSV parts with possibly different headers -> one frame by column name.

    A part counts if its header has, of every group in ``required_all``, at least one name; empty files and others
    are skipped. One pass over the parts as text takes every file's first line, and the distinct headers (feed
    versions, not files) come to the driver. Then one scan reads all parts, however many headers there are: as records
    by position, so quoted values may hold commas, doubled quotes and line breaks. Each record is paired with its own
    file's header, and a column takes the value at the place where that header has its name, else null. Of names that
    a header repeats the first counts. All columns are text (typing happens in normalisation, P10).

    A record may span lines, so a part is read by one task; parts are as large as one landing of a feed.
    """
    lines = spark.read.text(pattern_or_paths).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # the first line of the file's first block, which one task reads in order
    first = (lines.where(F.col("_start") == 0).select("value", "_file").mapInArrow(_first_lines, "_head string, _file string")
             .where(F.trim("_head") != "").checkpoint())
    headers = sorted(r["_head"] for r in first.select("_head").distinct().collect())
    names = {h: _header_names(h) for h in headers}
    good = [h for h in headers if all(any(c in names[h] for c in group) for group in required_all)]
    if not good:
        return None
    width = max(len(names[h]) for h in good)
    places = [f"_c{i}" for i in range(width)]
    records = (spark.read.schema(", ".join(f"{c} string" for c in places))
               .options(header=False, multiLine=True, escape='"', mode="PERMISSIVE").csv(pattern_or_paths)
               .select(F.array(*places).alias("_values"), F.col("_metadata.file_path").alias("_path")))
    version = spark.createDataFrame([(h, i, names[h]) for i, h in enumerate(good)], "_head string, _version int, _names array<string>")
    of_file = first.join(F.broadcast(version), "_head").select("_file", "_version", "_names")  # a row for each feed version
    rows = records.join(of_file, F.col("_path") == F.col("_file"))
    # the header line itself, where it stands; most rows already differ from it in their first value
    plain = lambda v: F.trim(F.regexp_replace(v, "^\ufeff", ""))
    body = rows.where(~(plain(F.get("_values", F.lit(0))).eqNullSafe(F.get("_names", F.lit(0)))
                        & F.transform(F.slice("_values", 1, F.size("_names")), plain).eqNullSafe(F.col("_names"))))
    columns = list(dict.fromkeys(c for h in good for c in names[h]))

    def value(column: str):
        at = [names[h].index(column) if column in names[h] else None for h in good]
        return F.get("_values", F.get(F.array(*[F.lit(i).cast("int") for i in at]), F.col("_version")))

    return body.select(*[value(c).alias(c) for c in columns])


SCOREBOARD_SCHEMA = ("struct<scoreboard:struct<gameDate:string, games:array<struct<gameId:string, gameStatus:int, "
                     "gameStatusText:string, homeTeam:struct<teamId:bigint, teamTricode:string>, "
                     "awayTeam:struct<teamId:bigint, teamTricode:string>, "
                     "arena:struct<arenaName:string, arenaCity:string, arenaState:string>>>>>")


def scoreboard_games(docs: DataFrame, col: str = "doc") -> DataFrame:
    """Scoreboard JSON -> one row per game (games without an id skipped), nested fields flattened."""
    d = docs.select(F.from_json(F.col(col), SCOREBOARD_SCHEMA).alias("_d"))
    g = d.select(F.col("_d.scoreboard.gameDate").alias("game_date_text"),
                 F.explode(F.coalesce(F.col("_d.scoreboard.games"), F.array())).alias("_g"))
    g = g.where(F.col("_g.gameId").isNotNull() & (F.trim(F.col("_g.gameId")) != ""))
    return g.select(
        F.col("_g.gameId").alias("game_id"), F.to_date("game_date_text").alias("game_date"),
        F.col("_g.gameStatus").alias("game_status"), F.col("_g.gameStatusText").alias("game_status_text"),
        F.col("_g.homeTeam.teamId").alias("home_team_id"), F.col("_g.homeTeam.teamTricode").alias("home_team_tricode"),
        F.col("_g.awayTeam.teamId").alias("away_team_id"), F.col("_g.awayTeam.teamTricode").alias("away_team_tricode"),
        F.col("_g.arena.arenaName").alias("arena_name"), F.col("_g.arena.arenaCity").alias("arena_city"),
        F.col("_g.arena.arenaState").alias("arena_state"))


def mapping_rows(df: DataFrame) -> DataFrame:
    """(game_id, slug) from a mapping file: trimmed, slug from 'polymarket_slug' or 'slug', blanks dropped."""
    def t(c):
        return F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    out = df.select(t("game_id").alias("game_id"), F.coalesce(t("polymarket_slug"), t("slug")).alias("slug"))
    return out.where(F.col("game_id").isNotNull() & F.col("slug").isNotNull())


def empty_like(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """A typed empty frame when nothing landed (downstream plans keep their schema)."""
    return spark.createDataFrame([], schema)


def has_rows(df: DataFrame) -> bool:
    """Row-presence gate: run the next stage only when the frame has rows (reads at most one row)."""
    return not df.isEmpty()


def split_good_bad(df: DataFrame, rules: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Rows failing any rule go to a quarantine frame with the first failing rule as ``reason``."""
    reason = None
    for name, bad in rules.items():
        reason = F.when(bad, F.lit(name)) if reason is None else reason.when(bad, F.lit(name))
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


SEASON_TYPE_PRIORITY = ["Regular Season", "PlayIn", "Playoffs"]


def landed_game_log(spark: SparkSession, base: str, fmt: str = "csv") -> DataFrame:
    """The landed log under ``base/season=.../season_type=...``; partition values become columns."""
    r = spark.read.option("basePath", base)
    if fmt == "csv":
        r = r.option("header", True)
    return r.format(fmt).load(base)


def first_nonempty_season_type(log: DataFrame, by: list[str], priority=SEASON_TYPE_PRIORITY) -> DataFrame:
    """S16 daily rule: per ``by`` key, keep the rows of the highest-priority season type that has any; types
    that are not listed never count.

    The best priority per key is a grouped min (reduced map-side to one row per key) joined back
    on the key, so no task buffers a whole key, and AQE's skew-join splitting covers a hot day."""
    pr = F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("season_type")), F.lit(0))
    x = log.withColumn("_p", pr).where(F.col("_p").isNotNull())
    best = x.groupBy(*by).agg(F.min("_p").alias("_best"))
    return x.join(best, list(by)).where(F.col("_p") == F.col("_best")).drop("_p", "_best")


def write_overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite sink."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, cols: list[str], fmt: str = "parquet") -> None:
    """One directory per experiment/model/test season (partition columns)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).format(fmt).save(path)


def write_append(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append sink; every CSV part carries its header."""
    w = df.write.mode("append").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
