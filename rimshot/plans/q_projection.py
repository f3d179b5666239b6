"""Queries: team state at checkpoints (W17) and the season projection (M1-M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimshot.operators import projection as P
from rimshot.operators.elo import elo
from rimshot.operators.results import team_game_results
from rimshot.plans import q_elo  # noqa: F401  (registers the f_elo oracle CTE)
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.oracle_sql import register
from rimshot.sources import fixtures as fx

N_DRAWS = 200   # draws of the kept m05 query; exact expected wins need none (m01_expected_wins)


def _mix_sql(x: str) -> str:
    """The projection's 32-bit mixer (see rimshot.operators.projection) written in DuckDB SQL."""
    x0 = f"(({x}) % 4294967296)"
    x1 = f"((xor({x0} >> 16, {x0}) * 73244475) % 4294967296)"
    x2 = f"((xor({x1} >> 16, {x1}) * 73244475) % 4294967296)"
    return f"xor({x2} >> 16, {x2})"


def _expand_mix(sql: str) -> str:
    out, i = [], 0
    while True:
        j = sql.find("MIX(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + _mix_sql(sql[j + 4:k - 1]))
        i = k


register("f_cutoffs", """
select season_start, gn as checkpoint, max(game_date) as cutoff
from (select season_start, game_date,
             row_number() over (partition by season_start, team_id order by game_date, game_id) as gn from f_results) x
where gn in (20, 40, 60) group by season_start, gn""", ("f_results",))

register("f_state", """
with m as (select distinct r.season_start, r.team_id, c.checkpoint, c.cutoff
           from f_results r join f_cutoffs c on r.season_start = c.season_start),
w as (select m.season_start, m.checkpoint, m.team_id, cast(sum(r.is_win) as bigint) as wins_cp
      from m join f_results r on r.season_start = m.season_start and r.team_id = m.team_id and r.game_date <= m.cutoff
      group by 1, 2, 3),
e as (select season_start, checkpoint, team_id, elo_post as elo_cp from (
        select m.season_start, m.checkpoint, m.team_id, h.elo_post,
               row_number() over (partition by m.season_start, m.checkpoint, m.team_id
                                  order by h.game_date desc, h.game_id desc) as rk
        from m join f_elo h on h.season_start = m.season_start and h.team_id = m.team_id and h.game_date <= m.cutoff) z
      where rk = 1)
select m.season_start, m.checkpoint, m.team_id, t.conference, m.cutoff,
       coalesce(w.wins_cp, 0) as wins_cp, coalesce(e.elo_cp, 1500e0) as elo_cp
from m left join w using (season_start, checkpoint, team_id) left join e using (season_start, checkpoint, team_id)
left join f_teams t on t.team_id = m.team_id""", ("f_results", "f_cutoffs", "f_elo", "f_teams"))


def _state(spark, sf_dir):
    g = fx.games(spark, sf_dir)
    res = team_game_results(g)
    cut = P.checkpoint_cutoffs(res)
    st = P.team_state(res, elo(res), fx.teams(spark, sf_dir), cut)
    return g, cut, st


@query("w17_team_state", """
select season_start, checkpoint, team_id, conference, cutoff, wins_cp, round(elo_cp, 4) as elo_cp from f_state""")
def w17_team_state(spark, sf_dir):
    _, _, st = _state(spark, sf_dir)
    return st.withColumn("elo_cp", F.round("elo_cp", 4))


register("f_chances", """
with g as (select c.season_start, c.checkpoint, f.game_id, f.home_team_id, f.away_team_id
           from f_games f join f_cutoffs c on f.season_start = c.season_start
           where f.season_type = 'Regular Season' and f.game_date > c.cutoff)
select g.*, 1e0 / (1e0 + exp(-(h.elo_cp - a.elo_cp) * 0.005756462732485115 / 2)) as p_home_win
from g join f_state h on (h.season_start, h.checkpoint, h.team_id) = (g.season_start, g.checkpoint, g.home_team_id)
       join f_state a on (a.season_start, a.checkpoint, a.team_id) = (g.season_start, g.checkpoint, g.away_team_id)""",
         ("f_games", "f_cutoffs", "f_state"))


@query("m01_game_probabilities", """
select season_start, checkpoint, game_id, home_team_id, away_team_id, round(p_home_win, 6) as p_home_win from f_chances""")
def m01_game_probabilities(spark, sf_dir):
    """J7 + M1: the home side's chance in every remaining game of each checkpoint."""
    g, cut, st = _state(spark, sf_dir)
    p = P.game_probabilities(P.remaining_games(g, cut), st)
    return round_doubles(p.select("season_start", "checkpoint", "game_id", "home_team_id", "away_team_id", "p_home_win"))


@query("m01_expected_wins", """
with c as (select season_start, checkpoint, unnest([home_team_id, away_team_id]) as team_id,
                  unnest([p_home_win, 1 - p_home_win]) as chance from f_chances)
select s.season_start, s.checkpoint, s.team_id, any_value(s.conference) as conference, any_value(s.wins_cp) as wins_cp,
       count(chance) as games_left, round(any_value(s.wins_cp) + coalesce(sum(chance), 0), 6) as exp_wins
from f_state s left join c using (season_start, checkpoint, team_id) group by s.season_start, s.checkpoint, s.team_id""")
def m01_expected_wins(spark, sf_dir):
    """Expected wins without draws: wins so far and the chances of the games that remain."""
    g, cut, st = _state(spark, sf_dir)
    return round_doubles(P.expected_wins(g, st, cut))


@query("m05_season_projection", _expand_mix(f"""
with g as (select c.season_start, c.checkpoint, f.game_id, f.home_team_id, f.away_team_id
           from f_games f join f_cutoffs c on f.season_start = c.season_start
           where f.season_type = 'Regular Season' and f.game_date > c.cutoff),
p0 as (select g.*, 1e0 / (1e0 + exp(-(0e0 + 0.005756462732485115 * (hs.elo_cp - aws.elo_cp)))) as p_raw
       from g left join f_state hs on hs.season_start = g.season_start and hs.checkpoint = g.checkpoint and hs.team_id = g.home_team_id
              left join f_state aws on aws.season_start = g.season_start and aws.checkpoint = g.checkpoint and aws.team_id = g.away_team_id),
p1 as (select p0.*, least(greatest(p_raw, 1e-15), 1 - 1e-15) as q from p0),
p as (select p1.*, 1e0 / (1e0 + exp(-(ln(q / (1 - q)) / 2e0))) as p_home_win from p1),
d as (select p.*, unnest(range({N_DRAWS})) as draw from p),
h0 as (select d.*, cast(42 + season_start * 100 + checkpoint as bigint) as h from d),
h1 as (select * replace (MIX(h) as h) from h0),
h2 as (select * replace (MIX(h + draw) as h) from h1),
h3 as (select * replace (MIX(h + game_id % 4294967296) as h) from h2),
h4 as (select * replace (MIX(h + (game_id >> 32)) as h) from h3),
u as (select h4.*, case when h / 4294967296e0 < p_home_win then 1 else 0 end as home_win from h4),
sides as (select season_start, checkpoint, draw, home_team_id as team_id, home_win as w from u
          union all select season_start, checkpoint, draw, away_team_id, 1 - home_win from u),
sim as (select season_start, checkpoint, draw, team_id, sum(w) as sim_wins from sides group by 1, 2, 3, 4),
base as (select s.*, unnest(range({N_DRAWS})) as draw from f_state s),
tot as (select b.*, b.wins_cp + coalesce(sim.sim_wins, 0) as wins
        from base b left join sim using (season_start, checkpoint, draw, team_id)),
seeded as (select tot.*, row_number() over (partition by season_start, checkpoint, draw, conference
                                            order by wins desc, elo_cp desc, team_id) as seed from tot)
select concat(cast(season_start as varchar), '-', lpad(cast((season_start + 1) % 100 as varchar), 2, '0')) as season,
       season_start, checkpoint, team_id, conference,
       round(avg(case when seed <= 6 then 1e0 else 0e0 end), 6) as p_top6,
       round(avg(case when seed <= 10 then 1e0 else 0e0 end), 6) as p_top10,
       round(avg(case when seed <= 10 then 1e0 else 0e0 end), 6) as p_playoffs,
       round(avg(wins), 6) as exp_wins, round(avg(seed), 6) as exp_conf_seed,
       {N_DRAWS} as n_sims, cast(42 + season_start * 100 + checkpoint as bigint) as seed,
       0e0 as alpha, round(cast(0.005756462732485115 as double), 6) as beta
from seeded group by season_start, checkpoint, team_id, conference"""))
def m05_season_projection(spark, sf_dir):
    """M1-M6: every season x checkpoint projected with N_DRAWS draws."""
    return round_doubles(P.season_projection(fx.games(spark, sf_dir), fx.teams(spark, sf_dir), N_DRAWS))
