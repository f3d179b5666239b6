"""Queries: game -> team rows (T1), base features (J1), game-log pivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimshot.operators.results import features_base, pivot_games, team_game_results
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.oracle_sql import register
from rimshot.sources import fixtures as fx

register("f_game_log_dirty", """
with l as (select * exclude (matchup), case when game_id % 11 = 0 and wl = 'W' then 'unmarked' else matchup end as matchup
           from f_game_log)
select * from l
union all
select * from l where game_id % 7 = 0""", ("f_game_log",))


def game_log_dirty(spark, sf_dir):
    """The raw game log with every seventh game's rows landed twice (a re-delivered file) and the winner's row of
    every eleventh game without a home or away marker."""
    log = fx.game_log(spark, sf_dir).withColumn("matchup", F.when(
        (F.col("game_id") % 11 == 0) & (F.col("wl") == "W"), "unmarked").otherwise(F.col("matchup")))
    return log.unionByName(log.where(F.col("game_id") % 7 == 0))


@query("t01_team_game_results", """
select season_start, season_type, game_id, game_date, team_id, opp_team_id, is_home, team_points, opp_points, is_win
from f_results""")
def t01_team_game_results(spark, sf_dir):
    return team_game_results(fx.games(spark, sf_dir))


@query("j01_features_base", """
select season_start, game_id, game_date, team_id, opp_team_id, is_home, is_win, point_diff,
       fgm, fga, round(fg_pct, 6) as fg_pct, fg3m, fg3a, round(fg3_pct, 6) as fg3_pct, ftm, fta,
       round(ft_pct, 6) as ft_pct, oreb, dreb, reb, ast, turnovers, pts
from f_base""")
def j01_features_base(spark, sf_dir):
    g = fx.games(spark, sf_dir)
    return round_doubles(features_base(team_game_results(g), fx.team_stats(spark, sf_dir)))


_PIVOT_SELECT = """
select game_id, min(season_start) as season_start, min(game_date) as game_date,
       max(case when matchup like '%vs.%' then team_id end) as home_team_id,
       max(case when matchup like '%@%' and matchup not like '%vs.%' then team_id end) as away_team_id,
       max(case when matchup like '%vs.%' then pts end) as home_points,
       max(case when matchup like '%@%' and matchup not like '%vs.%' then pts end) as away_points,
       max(case when wl = 'W' and (matchup like '%vs.%' or matchup like '%@%') then team_id end) as winner,
       min(season_type) = 'PlayIn' as play_in_flag,
       min(season_type) = 'Playoffs' as playoff_flag,
       min(season_type) as season_type
"""


@query("a01_pivot_games_bulk", _PIVOT_SELECT + """
from (select distinct * from f_game_log_dirty) d
group by game_id having count(distinct team_id) >= 2""")
def a01_pivot_games_bulk(spark, sf_dir):
    return pivot_games(game_log_dirty(spark, sf_dir), mode="bulk")


@query("a02_pivot_games_daily", _PIVOT_SELECT + """
from f_game_log_dirty
group by game_id having count(*) = 2""")
def a02_pivot_games_daily(spark, sf_dir):
    return pivot_games(game_log_dirty(spark, sf_dir), mode="daily")
