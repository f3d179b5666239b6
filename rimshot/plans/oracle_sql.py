"""DuckDB oracle: the fixture derivations and operator semantics written as plain SQL.

These strings are an independent statement of each operator, used only to
check the Spark results; no Spark code reads them. ``with_ctes`` prepends
exactly the fixture CTEs a statement needs (in dependency order).
"""

from __future__ import annotations

import re

# name -> (sql body, dependencies)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "f_games": ("""
select o_orderkey as game_id,
       cast(case when month(o_orderdate) >= 9 then year(o_orderdate) else year(o_orderdate) - 1 end as bigint) as season_start,
       cast(o_orderdate as date) as game_date,
       o_custkey % 30 as home_team_id,
       (o_custkey % 30 + 1 + o_orderkey % 29) % 30 as away_team_id,
       85 + cast(floor(o_totalprice) as bigint) % 47 as home_points,
       85 + cast(floor(o_totalprice / 7) as bigint) % 43 as away_points,
       case o_orderpriority when '5-LOW' then 'Playoffs'
            when '4-NOT SPECIFIED' then 'PlayIn' else 'Regular Season' end as season_type
from orders""", ()),
    "f_game_log": ("""
select game_id, season_start, game_date, season_type, home_team_id as team_id, home_points as pts,
       concat('T', cast(home_team_id as varchar), ' vs. T', cast(away_team_id as varchar)) as matchup,
       case when home_points > away_points then 'W' else 'L' end as wl from f_games
union all
select game_id, season_start, game_date, season_type, away_team_id, away_points,
       concat('T', cast(away_team_id as varchar), ' @ T', cast(home_team_id as varchar)),
       case when away_points > home_points then 'W' else 'L' end from f_games""", ("f_games",)),
    "f_player_raw": ("""
select l.l_orderkey as game_id, g.season_start, g.season_type, g.game_date,
       case when l.l_linenumber % 2 = 1 then g.home_team_id else g.away_team_id end as team_id,
       l.l_linenumber * 100 + l.l_partkey % 40 as player_id,
       concat(cast(cast(l.l_quantity as bigint) % 48 as varchar), ':', lpad(cast(l.l_suppkey % 60 as varchar), 2, '0')) as minutes,
       cast(l.l_quantity as bigint) % 15 as fgm,
       cast(l.l_quantity as bigint) % 15 + l.l_partkey % 11 as fga,
       l.l_suppkey % 5 as fg3m, l.l_suppkey % 5 + l.l_partkey % 6 as fg3a,
       l.l_partkey % 7 as ftm, l.l_partkey % 7 + l.l_suppkey % 4 as fta,
       l.l_suppkey % 4 as oreb, l.l_partkey % 9 as dreb, l.l_partkey % 8 as ast, l.l_suppkey % 6 as turnovers,
       2 * (cast(l.l_quantity as bigint) % 15) + l.l_suppkey % 5 + l.l_partkey % 7 as pts
from lineitem l join f_games g on l.l_orderkey = g.game_id""", ("f_games",)),
    "f_team_box": ("""
select game_id, team_id, season_start, season_type, game_date,
       cast(sum(fgm) as bigint) as fgm, cast(sum(fga) as bigint) as fga,
       cast(sum(fg3m) as bigint) as fg3m, cast(sum(fg3a) as bigint) as fg3a,
       cast(sum(ftm) as bigint) as ftm, cast(sum(fta) as bigint) as fta,
       cast(sum(oreb) as bigint) as oreb, cast(sum(dreb) as bigint) as dreb,
       cast(sum(ast) as bigint) as ast, cast(sum(turnovers) as bigint) as turnovers,
       cast(sum(pts) as bigint) as pts
from f_player_raw group by game_id, team_id, season_start, season_type, game_date""", ("f_player_raw",)),
    "f_team_stats": ("""
select *, oreb + dreb as reb,
       case when fga > 0 then 1e0 * fgm / fga end as fg_pct,
       case when fg3a > 0 then 1e0 * fg3m / fg3a end as fg3_pct,
       case when fta > 0 then 1e0 * ftm / fta end as ft_pct
from f_team_box""", ("f_team_box",)),
    "f_teams": ("""
select distinct team_id, concat('T', cast(team_id as varchar)) as tricode,
       case when team_id % 2 = 0 then 'East' else 'West' end as conference,
       team_id % 6 as division,
       2.5e1 + 8e-1 * team_id as lat, -1.2e2 + 1.6e0 * team_id as lon
from f_game_log""", ("f_game_log",)),
    "f_results": ("""
select season_start, season_type, game_id, game_date, home_team_id as team_id, away_team_id as opp_team_id,
       1 as is_home, home_points as team_points, away_points as opp_points,
       case when home_points > away_points then 1 else 0 end as is_win
from f_games where season_type = 'Regular Season'
union all
select season_start, season_type, game_id, game_date, away_team_id, home_team_id,
       0, away_points, home_points,
       case when away_points > home_points then 1 else 0 end
from f_games where season_type = 'Regular Season'""", ("f_games",)),
    "f_base": ("""
select r.season_start, r.game_id, r.game_date, r.team_id, r.opp_team_id, r.is_home, r.is_win,
       r.team_points - r.opp_points as point_diff,
       s.fgm, s.fga, s.fg_pct, s.fg3m, s.fg3a, s.fg3_pct, s.ftm, s.fta, s.ft_pct,
       s.oreb, s.dreb, s.reb, s.ast, s.turnovers, s.pts
from f_results r join f_team_stats s on r.game_id = s.game_id and r.team_id = s.team_id""",
               ("f_results", "f_team_stats")),
    "f_rolling": ("""
select b.*,
       avg(is_win) over (w rows between 5 preceding and 1 preceding) as win_pct_l5,
       avg(is_win) over (w rows between 10 preceding and 1 preceding) as win_pct_l10,
       avg(point_diff) over (w rows between 10 preceding and 1 preceding) as avg_point_diff_l10,
       avg(pts) over (w rows between 10 preceding and 1 preceding) as avg_pts_l10,
       avg(turnovers) over (w rows between 10 preceding and 1 preceding) as avg_tov_l10,
       avg(reb) over (w rows between 10 preceding and 1 preceding) as avg_reb_l10,
       avg(ast) over (w rows between 10 preceding and 1 preceding) as avg_ast_l10,
       avg(is_win) over (w rows between unbounded preceding and 1 preceding) as win_pct_s2d,
       avg(point_diff) over (w rows between unbounded preceding and 1 preceding) as avg_point_diff_s2d
from f_base b
window w as (partition by season_start, team_id order by game_date, game_id)""", ("f_base",)),
    "f_standings": ("""
select season_start, team_id, conference, division, wins, losses, point_diff,
       row_number() over (partition by season_start, conference order by wins desc, point_diff desc, team_id) as playoff_rank,
       dense_rank() over (partition by season_start, conference order by wins desc) as dense_seed
from (select l.season_start, l.team_id, t.conference, t.division,
             cast(sum(case when l.wl = 'W' then 1 else 0 end) as bigint) as wins,
             cast(sum(case when l.wl = 'W' then 0 else 1 end) as bigint) as losses,
             cast(sum(case when g.home_team_id = l.team_id then g.home_points - g.away_points
                           else g.away_points - g.home_points end) as bigint) as point_diff
      from f_game_log l join f_games g on l.game_id = g.game_id join f_teams t on l.team_id = t.team_id
      where l.season_type = 'Regular Season'
      group by l.season_start, l.team_id, t.conference, t.division) s""", ("f_game_log", "f_games", "f_teams")),
    "f_labels": ("""
select season_start, team_id, conference, playoff_rank as conf_seed,
       case when playoff_rank <= 6 then 1 else 0 end as made_top6_conf,
       case when playoff_rank <= 10 then 1 else 0 end as made_top10_conf,
       case when playoff_rank <= 8 then 1 else 0 end as made_playoffs
from f_standings""", ("f_standings",)),
    "f_games_dirty": ("""
select game_id, season_start, game_date,
       case when game_id % 101 = 0 then home_team_id + 1000 else home_team_id end as home_team_id,
       case when game_id % 89 = 0 then null else away_team_id end as away_team_id,
       case when game_id % 97 = 0 then null else home_points end as home_points, away_points, season_type
from f_games
union all
select game_id, season_start, game_date, home_team_id, away_team_id, home_points, away_points, season_type
from f_games where game_id % 113 = 0""", ("f_games",)),
    "f_stats_dirty": ("""
select case when player_id % 31 = 0 then game_id + 100000000 else game_id end as game_id,
       case when l.fga = 0 and player_id % 2 = 0 then null else team_id end as team_id, player_id, season_start,
       case when player_id % 23 = 0 then 1e0 * (fgm + fga + 1) / (fga + 1)
            when fga = 0 then null else 1e0 * fgm / fga end as fg_pct,
       case when player_id % 29 = 0 then -pts else pts end as pts
from f_player_raw l""", ("f_player_raw",)),
    "f_schedule": ("""
select season_start, case when game_id % 211 = 0 then null else game_id end as game_id, game_date,
       home_team_id, case when game_id % 307 = 0 then null else away_team_id end as away_team_id,
       case when game_id % 10 = 0 then 'Scheduled' when game_id % 50 = 1 then 'PPD' else 'Final' end as game_status_text
from f_games where season_type = 'Regular Season'""", ("f_games",)),
    "f_book_levels": ("""
select l_orderkey as game_id, case when l_linestatus = 'O' then 'bid' else 'ask' end as side,
       case when l_linestatus = 'O' then 4.5e-1 + 5e-3 * l_linenumber else 4.9e-1 + 5e-3 * l_linenumber end as price,
       l_quantity as size
from lineitem""", ()),
}


def register(name: str, body: str, deps: tuple[str, ...]) -> None:
    CTES[name] = (body, deps)


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in CTES[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it references (``f_*`` names)."""
    used = [n for n in CTES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    parts = [f"{n} as ({CTES[n][0]}\n)" for n in _order(used)]
    head = sql.lstrip()
    m = re.match(r"(?i)with\s+recursive\s", head)
    if m:
        return "with recursive " + ",\n".join(parts) + ",\n" + head[m.end():].lstrip()
    if re.match(r"(?i)with\s", head):
        return "with " + ",\n".join(parts) + ",\n" + head[4:].lstrip()
    return "with " + ",\n".join(parts) + "\n" + sql
