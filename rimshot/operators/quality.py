"""Data-quality queries: every function returns the bad rows only (pass = empty).

J2-J5 orphans and cross-table consistency, A3 duplicates, F7 completeness,
F8 ranges, A4-A7 schedule report. All are anti joins, inner joins or one
grouped aggregate; joins shuffle on the join key only, or broadcast a side that
Spark has measured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimshot.functions.expressions import round_half_up


def orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Distinct fact keys with no dimension row. A null key counts as an orphan.

    ``left_anti`` keeps rows whose key is null (the equality is unknown, so no
    match), which is exactly ``LEFT JOIN ... WHERE dim.key IS NULL``.
    The fact side is reduced to distinct keys first, so only keys shuffle.
    """
    dk = dim_key or key
    d = dim.select(F.col(dk).alias("_dk")).distinct()
    keys = fact.select(key).distinct()
    return keys.join(d, F.col(key) == F.col("_dk"), "left_anti")


def game_orphans(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Games whose home or away team is missing from the team dimension (or null)."""
    ids = teams.select("team_id").distinct()
    h = ids.select(F.col("team_id").alias("_h"))
    a = ids.select(F.col("team_id").alias("_a"))
    j = (games.join(h, games.home_team_id == h._h, "left")
              .join(a, F.col("away_team_id") == a._a, "left"))
    return j.where(F.col("_h").isNull() | F.col("_a").isNull()).select(games.columns)


def wrong_row_count(games: DataFrame, box: DataFrame, expected: int = 2) -> DataFrame:
    """Games whose joined box-row count is not ``expected``; games with no box row are not reported.

    Same result as ``games JOIN box ON game_id GROUP BY game_id HAVING count(*) <> 2``
    but both sides are counted per game first (map-side partial counts), so the
    join moves one row per game instead of every box row: rows = n_games * n_box.
    """
    g = games.groupBy("game_id").agg(F.count(F.lit(1)).alias("_gn"))
    b = box.groupBy("game_id").agg(F.count(F.lit(1)).alias("_bn"))
    return (g.join(b, "game_id")
             .select("game_id", (F.col("_gn") * F.col("_bn")).alias("team_rows"))
             .where(F.col("team_rows") != expected))


def score_mismatch(games: DataFrame, box: DataFrame) -> DataFrame:
    """Games whose home or away points differ from the team box totals."""
    hb = box.select(F.col("game_id").alias("_hg"), F.col("team_id").alias("_ht"), F.col("pts").alias("tgs_home_pts"))
    ab = box.select(F.col("game_id").alias("_ag"), F.col("team_id").alias("_at"), F.col("pts").alias("tgs_away_pts"))
    j = (games.join(hb, (games.game_id == hb._hg) & (games.home_team_id == hb._ht))
              .join(ab, (F.col("game_id") == ab._ag) & (F.col("away_team_id") == ab._at)))
    return j.where((F.col("home_points") != F.col("tgs_home_pts")) | (F.col("away_points") != F.col("tgs_away_pts"))) \
            .select("game_id", "home_team_id", "home_points", "tgs_home_pts",
                    "away_team_id", "away_points", "tgs_away_pts")


DEALT_ROWS = 500_000  # rows for each task that counts keys


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` dealt out by key to a task for each ``DEALT_ROWS`` of ``rows``; as it is if one task holds them."""
    if rows <= DEALT_ROWS:
        return df
    return df.repartition(max(-(-rows // DEALT_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def duplicates(df: DataFrame, keys: list[str], rows: int = 0) -> DataFrame:
    """A3: keys that occur more than once, with their count. Partial counts combine map-side, where a task holds each
    key of all its rows; so with more ``rows`` (about how many there are) than one task is to hold, the rows, whose keys
    are mostly single, are dealt out by key to as many tasks as they need, and counted there only."""
    return dealt(df.select(*keys), keys, rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """rows with a null in any core column."""
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.where(cond)


def out_of_range(df: DataFrame, pct_cols: list[str] = (), count_cols: list[str] = ()) -> DataFrame:
    """F8: a percentage outside [0, 1] or a negative counting stat; nulls pass (three-valued logic). A column that
    the frame lacks is an error."""
    absent = [c for c in (*pct_cols, *count_cols) if c not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    conds = [(F.col(c) < 0) | (F.col(c) > 1) for c in pct_cols]
    conds += [F.col(c) < 0 for c in count_cols]
    return df.where(reduce(lambda a, b: a | b, conds))


def schedule_counts(schedule: DataFrame, season: str = "season_start") -> DataFrame:
    """A4: per-season completeness of the schedule."""
    return schedule.groupBy(season).agg(
        F.count(F.lit(1)).alias("games"),
        F.countDistinct("game_id").alias("distinct_game_ids"),
        F.sum(F.when(F.col("game_id").isNull(), 1).otherwise(0)).cast("bigint").alias("null_game_id"),
        F.sum(F.when(F.col("home_team_id").isNull() | F.col("away_team_id").isNull(), 1).otherwise(0))
         .cast("bigint").alias("null_team_ids"),
        F.sum(F.when(F.col("game_date").isNull(), 1).otherwise(0)).cast("bigint").alias("null_game_date"))


def team_games_distribution(schedule: DataFrame, season: str = "season_start", expected: int = 82) -> DataFrame:
    """A5: games per team (home counts + away counts), then min/max/avg (2 decimals, half-up) per season.

    A null team id is its own group, as in SQL GROUP BY.
    """
    home = schedule.groupBy(season, F.col("home_team_id").alias("team_id")).agg(F.count(F.lit(1)).alias("n"))
    away = schedule.groupBy(season, F.col("away_team_id").alias("team_id")).agg(F.count(F.lit(1)).alias("n"))
    per_team = home.unionByName(away).groupBy(season, "team_id").agg(F.sum("n").alias("games"))
    return per_team.groupBy(season).agg(
        F.min("games").alias("min_games"), F.max("games").alias("max_games"),
        round_half_up(F.avg("games"), 2).alias("avg_games"),
        F.sum(F.when(F.col("games") == expected, 1).otherwise(0)).cast("bigint").alias("teams_at_expected"),
        F.count(F.lit(1)).alias("teams"))


def duplicate_schedule_ids(schedule: DataFrame, season: str = "season_start", top: int = 20) -> DataFrame:
    """Repeated (season, game_id), the ``top`` most frequent (ties by season, game_id)."""
    d = (schedule.where(F.col("game_id").isNotNull())
                 .groupBy(season, "game_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    return d.orderBy(F.desc("n"), season, "game_id").limit(top)


def status_mix(schedule: DataFrame, season: str = "season_start") -> DataFrame:
    """Games per (season, status)."""
    return schedule.groupBy(season, "game_status_text").agg(F.count(F.lit(1)).alias("n"))
