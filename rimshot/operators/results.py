"""Game results: raw log -> game rows (A1, A2, J8), game -> team rows (T1, F1), base features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions.expressions import win_flag

REGULAR = "Regular Season"


def team_game_results(games: DataFrame, season_type: str | None = REGULAR) -> DataFrame:
    """T1 + F1: each game becomes two team rows (home first); a tie or missing score is a loss for both.

    One scan of ``games`` feeds both sides through ``inline(array(home, away))``
    instead of a UNION ALL that would read the table twice.
    """
    g = games.where(F.col("season_type") == season_type) if season_type else games

    def side(team, opp, tp, op, is_home):
        return F.struct(F.col(team).alias("team_id"), F.col(opp).alias("opp_team_id"),
                        F.lit(is_home).alias("is_home"), F.col(tp).alias("team_points"),
                        F.col(op).alias("opp_points"))

    rows = g.select(
        "season_start", "season_type", "game_id", "game_date",
        F.inline(F.array(side("home_team_id", "away_team_id", "home_points", "away_points", 1),
                         side("away_team_id", "home_team_id", "away_points", "home_points", 0))))
    return rows.withColumn("is_win", win_flag("team_points", "opp_points"))


BASE_STATS = ("fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct",
              "oreb", "dreb", "reb", "ast", "stl", "blk", "turnovers", "pf", "pts", "plus_minus")


def features_base(results: DataFrame, stats: DataFrame) -> DataFrame:
    """J1 + P15: team rows joined to their box score on (game_id, team_id); point_diff added.

    Box-score columns that the stats table lacks are simply not carried
    (the reference's "keep the columns that exist").
    """
    keep = [c for c in BASE_STATS if c in stats.columns]
    s = stats.select("game_id", "team_id", *keep)
    r = results.select("season_start", "game_id", "game_date", "team_id", "opp_team_id", "is_home", "is_win",
                       (F.col("team_points") - F.col("opp_points")).alias("point_diff"))
    return r.join(s, ["game_id", "team_id"], "inner")


def pivot_games(log: DataFrame, mode: str = "bulk") -> DataFrame:
    """Raw game log (two team rows per game) -> one game row.

    ``mode='bulk'``: duplicate team rows are dropped (first in date order) and a
    game needs two distinct teams; with more than two only the first two teams
    by (game_date, team_id) are kept. ``mode='daily'``: the game must have exactly two raw rows.
    Home is the row whose matchup contains 'vs.', away the row with '@'; the
    winner is the team with WL = 'W'. Should two rows carry the same marker,
    the higher team_id wins; a row without a marker takes no side and sets no winner. Both windows and the
    groupBy of the bulk mode run on one exchange by game_id.
    """
    log = log.withColumn("_home", F.col("matchup").contains("vs.")) \
             .withColumn("_away", ~F.col("_home") & F.col("matchup").contains("@"))
    if mode == "bulk":
        # first row per (game, team) in date order, then the first two teams of the game;
        # both windows share the game_id partitioning with the groupBy below (one exchange)
        log = log.repartition("game_id")
        wt = Window.partitionBy("game_id", "team_id").orderBy("game_date", "matchup", "pts", "wl")
        one = log.withColumn("_rt", F.row_number().over(wt)).where("_rt = 1").drop("_rt")
        wg = Window.partitionBy("game_id").orderBy("game_date", "team_id")
        log = one.withColumn("_rg", F.row_number().over(wg)).where("_rg <= 2").drop("_rg")
    agg = log.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("season_start", F.struct("game_date", "team_id")).alias("season_start"),
        F.min("game_date").alias("game_date"),
        F.min_by("season_type", F.struct("game_date", "team_id")).alias("season_type"),
        F.max(F.when(F.col("_home"), F.col("team_id"))).alias("home_team_id"),
        F.max(F.when(F.col("_away"), F.col("team_id"))).alias("away_team_id"),
        F.max_by(F.when(F.col("_home"), F.col("pts")), F.when(F.col("_home"), F.col("team_id"))).alias("home_points"),
        F.max_by(F.when(F.col("_away"), F.col("pts")), F.when(F.col("_away"), F.col("team_id"))).alias("away_points"),
        F.max(F.when((F.col("wl") == "W") & (F.col("_home") | F.col("_away")), F.col("team_id"))).alias("winner"),
    )
    # bulk: one row for each of the first two teams is left
    return agg.where(F.col("_n") == 2).select(
        "game_id", "season_start", "game_date", "home_team_id", "away_team_id", "home_points", "away_points",
        "winner",
        (F.col("season_type") == "PlayIn").alias("play_in_flag"),
        (F.col("season_type") == "Playoffs").alias("playoff_flag"),
        "season_type")
