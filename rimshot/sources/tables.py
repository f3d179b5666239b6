"""Parquet table access for the landed warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one parquet table; selecting columns here lets the scan read only those."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


#: What every row of a model's data set is told by (fixed values).
GAME_KEYS = ("game_id", "game_date", "season_start", "home_team_id", "away_team_id", "home_win")


def season_scan(spark: SparkSession, view: str, test_season: int, columns: list[str], season: str = "season_start",
                keys: tuple[str, ...] = GAME_KEYS) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a landed data set: the rows of all earlier seasons, and those of ``test_season``, with the
    keys and the wanted columns. The season filter and the columns reach the scan, so a data set that is partitioned
    by season is read in part."""
    rows = spark.read.parquet(view).select(*dict.fromkeys([*keys, *columns]))
    return rows.where(F.col(season) < test_season), rows.where(F.col(season) == test_season)
