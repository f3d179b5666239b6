"""Queries: Elo history (W12), oracle = recursive CTE carrying the season's rating list.

Team ids of the fixtures are 0..29, so the oracle's rating list is indexed by team_id + 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rimshot.operators.elo import elo
from rimshot.operators.results import team_game_results
from rimshot.plans.catalog import query
from rimshot.plans.oracle_sql import CTES, register
from rimshot.sources import fixtures as fx

register("f_elo", """
with recursive
p as (select season_start, game_id, min(game_date) as game_date,
             max(case when is_home = 1 then team_id end) as home_id,
             max(case when is_home = 0 then team_id end) as away_id,
             max(case when is_home = 1 then is_win end) as res_home,
             max(case when is_home = 0 then is_win end) as res_away
      from f_results group by season_start, game_id having count(*) = 2),
g as (select p.*, row_number() over (partition by season_start order by game_date, game_id) as k from p),
s as (
  select season_start, cast(0 as bigint) as k, list_transform(range(30), lambda i: 1500e0) as r,
         cast(null as bigint) as game_id, cast(null as double) as hpre, cast(null as double) as hpost,
         cast(null as double) as apre, cast(null as double) as apost
  from (select distinct season_start from g) seasons
  union all
  select season_start, k, list_transform(range(30), lambda i: case when i = home_id then hpost
                                                         when i = away_id then apost else r[i + 1] end),
         game_id, hpre, hpost, apre, apost
  from (select s.season_start, g.k, s.r, g.game_id, g.home_id, g.away_id,
               s.r[g.home_id + 1] as hpre, s.r[g.away_id + 1] as apre,
               s.r[g.home_id + 1] + 20e0 * (g.res_home - 1e0 / (1e0 + pow(10e0, -(s.r[g.home_id + 1] - s.r[g.away_id + 1]) / 400e0))) as hpost,
               s.r[g.away_id + 1] + 20e0 * (g.res_away - (1e0 - 1e0 / (1e0 + pow(10e0, -(s.r[g.home_id + 1] - s.r[g.away_id + 1]) / 400e0)))) as apost
        from s join g on g.season_start = s.season_start and g.k = s.k + 1) step
)
select g.season_start, g.game_id, g.game_date, g.home_id as team_id, g.away_id as opp_team_id, 1 as is_home,
       s.hpre as elo_pre, s.hpost as elo_post, g.res_home as result, 20e0 as k_factor
from s join g on s.season_start = g.season_start and s.k = g.k
union all
select g.season_start, g.game_id, g.game_date, g.away_id, g.home_id, 0, s.apre, s.apost, g.res_away, 20e0
from s join g on s.season_start = g.season_start and s.k = g.k""", ("f_results",))

register("f_elo_leagues", CTES["f_elo"][0].replace(
    "p as (select season_start,", "p as (select season_start * 10 + game_id % 2 as season_start,"), ("f_results",))

ELO_SQL = """
select season_start, game_id, game_date, team_id, opp_team_id, is_home, round(elo_pre, 4) as elo_pre,
       round(elo_post, 4) as elo_post, result, k_factor from f_elo"""


@query("w12_elo_history", ELO_SQL)
def w12_elo_history(spark, sf_dir):
    h = elo(team_game_results(fx.games(spark, sf_dir)))
    return h.select("season_start", "game_id", "game_date", "team_id", "opp_team_id", "is_home",
                    F.round("elo_pre", 4).alias("elo_pre"), F.round("elo_post", 4).alias("elo_post"),
                    "result", "k_factor")


@query("w12_elo_two_leagues", """
select season_start // 10 as season_start, season_start % 10 as league, game_id, game_date, team_id, opp_team_id, is_home,
       round(elo_pre, 4) as elo_pre, round(elo_post, 4) as elo_post, result, k_factor from f_elo_leagues""")
def w12_elo_two_leagues(spark, sf_dir):
    """W12 with a second group key: games are dealt to two leagues, each with ratings of its own in every season."""
    res = team_game_results(fx.games(spark, sf_dir)).withColumn("league", F.col("game_id") % 2)
    h = elo(res, group_keys=("league", "season_start"))
    return h.select("season_start", "league", "game_id", "game_date", "team_id", "opp_team_id", "is_home",
                    F.round("elo_pre", 4).alias("elo_pre"), F.round("elo_post", 4).alias("elo_post"),
                    "result", "k_factor")
