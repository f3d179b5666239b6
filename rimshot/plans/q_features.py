"""Queries: rolling features (W1-W4, A21), checkpoints (W6, W7, J11), labels (W8, A9, F2),
rest/travel (W14, W15), advanced metrics (W13) and game-level matchups (J9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.operators import features as FT
from rimshot.operators.labels import season_labels, seeds
from rimshot.operators.results import features_base, team_game_results
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans import q_elo  # noqa: F401  (registers the f_elo oracle CTE)
from rimshot.plans.oracle_sql import register
from rimshot.session import settled
from rimshot.sources import fixtures as fx

ROLL_COLS = list(FT.ROLLING_SPEC)


def base_table(spark, sf_dir):
    g = fx.games(spark, sf_dir)
    return features_base(team_game_results(g), fx.team_stats(spark, sf_dir))


def calendar(spark, sf_dir):
    """Every team's games with their dates: a cheap superset of the rows of all feature tables."""
    return team_game_results(fx.games(spark, sf_dir)).select("season_start", "team_id", "game_date")


def rolled_table(spark, sf_dir, slice_rows=None):
    return FT.rolling(base_table(spark, sf_dir), calendar=calendar(spark, sf_dir), slice_rows=slice_rows)


def labels_table(spark, sf_dir):
    return season_labels(seeds(fx.standings(spark, sf_dir), "row_number"))


_R = ", ".join(f"round({c}, 6) as {c}" for c in ROLL_COLS)


@query("w01_rolling_features", f"""
select season_start, game_id, game_date, team_id, opp_team_id, is_home, is_win, point_diff, pts, {_R}
from f_rolling""")
def w01_rolling_features(spark, sf_dir):
    r = rolled_table(spark, sf_dir)
    return round_doubles(r.select("season_start", "game_id", "game_date", "team_id", "opp_team_id", "is_home",
                                  "is_win", "point_diff", "pts", *ROLL_COLS))


@query("f02_training_model", f"""
select r.season_start, r.game_id, r.game_date, r.team_id, r.is_home, r.is_win, r.point_diff, {_R}, l.made_playoffs
from f_rolling r left join f_labels l on r.season_start = l.season_start and r.team_id = l.team_id
where r.win_pct_l10 is not null and r.avg_point_diff_l10 is not null""")
def f02_training_model(spark, sf_dir):
    t = FT.training_rows(rolled_table(spark, sf_dir), labels_table(spark, sf_dir))
    return round_doubles(t.select("season_start", "game_id", "game_date", "team_id", "is_home", "is_win",
                                  "point_diff", *ROLL_COLS, "made_playoffs"))


@query("w04_leakage_mae", """
with x as (
  select season_start, team_id, game_date, game_id,
         avg(is_win) over (w rows between 10 preceding and 1 preceding) as pre_l10,
         avg(is_win) over (w rows between 9 preceding and current row) as post_l10
  from f_base window w as (partition by season_start, team_id order by game_date, game_id)),
y as (select x.*, lag(post_l10) over (partition by season_start, team_id order by game_date, game_id) as post_l10_prev
      from x)
select season_start, count(*) as n_rows, cast(count(pre_l10) as bigint) as n_compared,
       round(avg(abs(pre_l10 - post_l10_prev)), 6) as mae_pre_vs_post
from y group by season_start""")
def w04_leakage_mae(spark, sf_dir):
    """W4 + A21: the pre-game L10 of game m+1 must equal the post-game L10 of game m (MAE 0)."""
    b = base_table(spark, sf_dir)
    cal = calendar(spark, sf_dir)
    pre = FT.rolling(b, {"pre_l10": ("is_win", 10)}, pre=True, calendar=cal)
    post = FT.rolling(pre, {"post_l10": ("is_win", 10)}, pre=False, calendar=cal)
    from rimshot.operators.sliced import slice_window, spread
    keys, order = list(FT.SEASON_KEYS), list(FT.GAME_ORDER)
    x = spread(post, keys, order, halo=1, calendar=cal).withColumn("post_l10_prev", F.lag("post_l10").over(slice_window(keys, order))).where("not _halo")
    return round_doubles(x.groupBy("season_start").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("pre_l10").cast("bigint").alias("n_compared"),
        F.avg(F.abs(F.col("pre_l10") - F.col("post_l10_prev"))).alias("mae_pre_vs_post")))


@query("w07_checkpoints", f"""
with n as (select r.*, row_number() over (partition by season_start, team_id order by game_date, game_id) as team_game_number
           from f_rolling r),
     c as (select 20 as checkpoint union all select 40 union all select 60)
select c.checkpoint, n.season_start, n.game_id, n.team_id, n.team_game_number, t.conference, t.division,
       {", ".join(f"round(n.{x}, 6) as {x}" for x in ROLL_COLS)}
from n join c on n.team_game_number = c.checkpoint + 1
left join f_teams t on n.team_id = t.team_id""")
def w07_checkpoints(spark, sf_dir):
    """W6 + W7 + J11: state before game N+1 for N in 20/40/60, with conference and division."""
    numbered = FT.with_game_number(rolled_table(spark, sf_dir), calendar=calendar(spark, sf_dir))
    cp = FT.checkpoint_rows(numbered, (20, 40, 60))
    cp = FT.attach_conference(cp, fx.teams(spark, sf_dir))
    return round_doubles(cp.select("checkpoint", "season_start", "game_id", "team_id", "team_game_number",
                                   "conference", "division", *ROLL_COLS))


@query("w08_seeds", """
select season_start, team_id, conference, wins, losses, point_diff, playoff_rank as seed_row_number,
       dense_seed as seed_dense_rank,
       case when playoff_rank <= 6 then 1 else 0 end as made_top6_conf,
       case when playoff_rank <= 10 then 1 else 0 end as made_top10_conf,
       case when playoff_rank <= 8 then 1 else 0 end as made_playoffs
from f_standings""")
def w08_seeds(spark, sf_dir):
    st = fx.standings(spark, sf_dir).select("season_start", "team_id", "conference", "wins", "losses", "point_diff")
    strict = seeds(st, "row_number").withColumnRenamed("conf_seed", "seed_row_number")
    both = seeds(strict, "dense_rank").withColumnRenamed("conf_seed", "seed_dense_rank")
    lab = season_labels(both.withColumn("conf_seed", F.col("seed_row_number")))
    return both.join(lab.select("season_start", "team_id", "made_top6_conf", "made_top10_conf", "made_playoffs"),
                     ["season_start", "team_id"])


@query("a09_label_base_rates", """
select method, round(avg(case when seed <= 6 then 1e0 else 0e0 end), 6) as top6_rate,
       round(avg(case when seed <= 10 then 1e0 else 0e0 end), 6) as top10_rate,
       max(seed) as max_seed, count(*) as team_seasons
from (select 'row_number' as method, playoff_rank as seed from f_standings
      union all select 'dense_rank', dense_seed from f_standings) s
group by method""")
def a09_label_base_rates(spark, sf_dir):
    """A9 + W8: label base rates under strict vs dense seeding (dense inflates the labels)."""
    st = fx.standings(spark, sf_dir).select("season_start", "team_id", "conference", "wins", "point_diff")
    rn = seeds(st, "row_number").select(F.lit("row_number").alias("method"), F.col("conf_seed").alias("seed"))
    dr = seeds(st, "dense_rank").select(F.lit("dense_rank").alias("method"), F.col("conf_seed").alias("seed"))
    s = rn.unionByName(dr)
    return round_doubles(s.groupBy("method").agg(
        F.avg(F.when(F.col("seed") <= 6, 1.0).otherwise(0.0)).alias("top6_rate"),
        F.avg(F.when(F.col("seed") <= 10, 1.0).otherwise(0.0)).alias("top10_rate"),
        F.max("seed").alias("max_seed"), F.count(F.lit(1)).alias("team_seasons")))


register("f_rest", """
with v as (select r.*, case when is_home = 1 then team_id else opp_team_id end as venue_team_id from f_results r),
x as (select v.*, t.lat, t.lon, o.lat as own_lat, o.lon as own_lon
      from v left join f_teams t on t.team_id = v.venue_team_id left join f_teams o on o.team_id = v.team_id),
y as (select x.*, date_diff('day', lag(game_date) over w, game_date) as rest_days,
             coalesce(lag(lat) over w, own_lat) as plat, coalesce(lag(lon) over w, own_lon) as plon
      from x window w as (partition by season_start, team_id order by game_date, game_id)),
z as (select y.*, 2 * 3958.8 * asin(least(1e0, sqrt(power(sin((radians(lat) - radians(plat)) / 2), 2)
             + cos(radians(plat)) * cos(radians(lat)) * power(sin((radians(lon) - radians(plon)) / 2), 2)))) as miles
      from y)
select season_start, game_id, game_date, team_id, is_home, cast(rest_days as bigint) as rest_days,
       case when rest_days <= 1 then 1 else 0 end as is_b2b, miles as travel_miles,
       case when miles > 0 then 1 else 0 end as traveled
from z""", ("f_results", "f_teams"))


@query("w14_rest_travel", "select * replace (round(travel_miles, 6) as travel_miles) from f_rest")
def w14_rest_travel(spark, sf_dir):
    """W14 + W15: rest days, back-to-back flag and miles travelled per team game."""
    r = FT.rest_travel(team_game_results(fx.games(spark, sf_dir)), fx.teams(spark, sf_dir))
    return round_doubles(r.select("season_start", "game_id", "game_date", "team_id", "is_home",
                                  F.col("rest_days").cast("bigint").alias("rest_days"), "is_b2b",
                                  F.col("travel_miles"), "traveled"))


ADV_OUT = list(FT.advanced_rolling_spec())

register("f_adv_roll", """
with a as (select b.*, fga + 0.44e0 * fta - oreb + turnovers as poss,
                  case when fga + 0.44e0 * fta - oreb + turnovers <> 0
                       then 1e2 * pts / (fga + 0.44e0 * fta - oreb + turnovers) end as off_rtg
           from f_base b),
m as (select a.*, o.off_rtg as def_rtg, a.off_rtg - o.off_rtg as net_rtg, (a.poss + o.poss) / 2 as pace,
             case when a.fga <> 0 then (a.fgm + 5e-1 * a.fg3m) / a.fga end as efg_pct,
             case when 2e0 * (a.fga + 0.44e0 * a.fta) <> 0 then a.pts / (2e0 * (a.fga + 0.44e0 * a.fta)) end as ts_pct,
             case when a.poss <> 0 then a.turnovers / a.poss end as tov_pct,
             case when a.oreb + o.dreb <> 0 then 1e0 * a.oreb / (a.oreb + o.dreb) end as oreb_pct,
             case when a.dreb + o.oreb <> 0 then 1e0 * a.dreb / (a.dreb + o.oreb) end as dreb_pct
      from a left join a o on a.game_id = o.game_id and a.opp_team_id = o.team_id)
select season_start, game_id, team_id, """ + ", ".join(
    f"avg({c}) over (w rows between {n or 'unbounded'} preceding and 1 preceding) as {o}"
    for o, (c, n) in FT.advanced_rolling_spec().items()) + """
from m window w as (partition by season_start, team_id order by game_date, game_id)""", ("f_base",))


@query("w13_advanced_rolling", "select season_start, game_id, team_id, "
       + ", ".join(f"round({c}, 6) as {c}" for c in ADV_OUT) + " from f_adv_roll")
def w13_advanced_rolling(spark, sf_dir):
    """L5/L10/season-to-date means of possession-based efficiency metrics."""
    adv = FT.advanced_metrics(base_table(spark, sf_dir))
    r = FT.rolling(adv, FT.advanced_rolling_spec(), calendar=calendar(spark, sf_dir))
    return round_doubles(r.select("season_start", "game_id", "team_id", *ADV_OUT))


MATCHUP_FEATURES = ["win_pct_l10", "avg_point_diff_l10", "win_pct_s2d", "avg_point_diff_s2d"]


@query("j09_matchup", """
select season_start, game_id, game_date, max(case when is_home = 1 then is_win end) as home_is_win,
""" + ",\n".join(
    f"       round(max(case when is_home = 1 then {f} end) - max(case when is_home = 0 then {f} end), 6) as {f}_diff"
    for f in MATCHUP_FEATURES) + """
from f_rolling group by season_start, game_id, game_date""")
def j09_matchup(spark, sf_dir):
    """Game-level rows, home minus away for each rolling feature."""
    return round_doubles(FT.matchup(rolled_table(spark, sf_dir), MATCHUP_FEATURES))


register("f_core", """
with p as (select season_start, team_id, game_id, player_id, minutes,
                  row_number() over (partition by game_id, player_id order by team_id, fgm, fga, fg3m, fg3a, ftm, fta,
                                     oreb, dreb, ast, turnovers, pts, minutes) as rn from f_player_raw),
n as (select season_start, team_id, game_id,
             row_number() over (partition by season_start, team_id order by game_date, game_id) as gn from f_results),
pm as (select n.season_start, n.team_id, p.player_id, n.gn,
              coalesce(cast(regexp_extract(trim(p.minutes), '^(\\d+)', 1) as double)
                       + coalesce(cast(nullif(regexp_extract(trim(p.minutes), '^\\d+:(\\d+)', 1), '') as double), 0e0) / 60e0, 0e0) as m
       from p join n on p.game_id = n.game_id and p.team_id = n.team_id and p.season_start = n.season_start
       where p.rn = 1),
x as (select pm.*, k from pm, (select unnest(range(1, 11)) as k) ks),
per as (select season_start, team_id, gn + k as target, player_id, sum(m) as min10,
               sum(case when k <= 5 then m else 0e0 end) as min5,
               sum(case when k <= 5 and m > 0 then 1 else 0 end) as games5 from x group by 1, 2, 3, 4),
top as (select *, row_number() over (partition by season_start, team_id, target order by min10 desc, player_id) as r
        from per),
team as (select season_start, team_id, target, cast(sum(games5) as bigint) as core_games5, sum(min5) as core_min5
         from top where r <= 8 group by 1, 2, 3)
select n.season_start, n.team_id, n.game_id, n.gn as team_game_number,
       coalesce(t.core_games5, 0) as core_games5, coalesce(t.core_min5, 0e0) as core_min5
from n left join team t on n.season_start = t.season_start and n.team_id = t.team_id and n.gn = t.target""", ("f_player_raw", "f_results"))


@query("w16_core_availability", "select * replace (round(core_min5, 6) as core_min5) from f_core")
def w16_core_availability(spark, sf_dir):
    """Core-player appearances and minutes over the previous five games (injury proxy)."""
    from rimshot.operators.normalise import dedup_first
    raw = fx.player_raw(spark, sf_dir)
    order = ["team_id", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "ast", "turnovers", "pts",
             "minutes"]
    players = dedup_first(raw, ["game_id", "player_id"], order)
    r = FT.core_availability(players, team_game_results(fx.games(spark, sf_dir)))
    return round_doubles(r)


ADV_DIFFS = {"net_rtg": "net_rtg", "efg": "efg_pct", "ts": "ts_pct", "tov": "tov_pct", "oreb": "oreb_pct", "dreb": "dreb_pct",
             "pace": "pace", "poss": "poss"}
NEXT_GAME_DIFFS = {"elo_diff": "elo_pre", "rest_adv_days": "rest_days", "win_pct_l10_diff": "win_pct_l10",
                   "margin_l10_diff": "avg_point_diff_l10",
                   **{f"{k}_{n}_diff": f"{c}_{n}" for n in ("l10", "l5", "s2d") for k, c in ADV_DIFFS.items()},
                   "core_games_last5_adv": "core_games5", "core_minutes_last5_adv": "core_min5",
                   "travel_miles_adv": "travel_miles", "is_travel_game_adv": "traveled"}


def next_game_table(spark, sf_dir):
    """One row per game: home minus away of the Elo rating before the game, the rolling form and efficiency, rest,
    travel and core-player availability; back-to-back flags of both sides; ``home_win``.

    Elo, rest and availability are settled one after another, so that the shuffle files of one are gone before the next
    begins. Then all rows are dealt out once, by game: the team's rows take from the others what these have of the same
    game and team (the greatest value, as is taken of a side's rows in the end), and the sides are set against each other.
    """
    from rimshot.operators.elo import elo
    from rimshot.operators.normalise import dedup_first
    res = team_game_results(fx.games(spark, sf_dir))
    cal = res.select("season_start", "team_id", "game_date")
    spec = {**FT.advanced_rolling_spec(), "win_pct_l10": ("is_win", 10), "avg_point_diff_l10": ("point_diff", 10)}
    order = ["team_id", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "ast", "turnovers", "pts", "minutes"]
    players = dedup_first(fx.player_raw(spark, sf_dir), ["game_id", "player_id"], order)
    keys = ["game_id", "team_id"]
    others = [settled(spark, make) for make in (
        lambda: elo(res).select(*keys, "elo_pre"),
        lambda: FT.rest_travel(res, fx.teams(spark, sf_dir)).select(*keys, "rest_days", "is_b2b", "travel_miles", "traveled"),
        lambda: FT.core_availability(players, res).select(*keys, "core_games5", "core_min5"))]
    base = FT.advanced_metrics(base_table(spark, sf_dir)).select(
        "season_start", *keys, "game_date", "is_home", *dict.fromkeys(c for c, _ in spec.values()))
    rows = FT.rolling(base, spec, calendar=cal).withColumn("_own", F.lit(True))
    for other in others:
        rows = rows.unionByName(other.where("game_id is not null and team_id is not null"), allowMissingColumns=True)
    same = Window.partitionBy(*keys)
    team = rows.repartition("game_id").withColumns(
        {c: F.max(c).over(same) for other in others for c in other.columns if c not in keys}).where("_own")
    home = F.col("is_home") == 1
    side = lambda c, at_home: F.max(F.when(home if at_home else ~home, F.col(c)))
    return team.groupBy("season_start", "game_id", "game_date").agg(
        side("team_id", True).alias("home_team_id"), side("team_id", False).alias("away_team_id"),
        side("is_win", True).alias("home_win"), side("is_b2b", True).alias("home_is_b2b"), side("is_b2b", False).alias("away_is_b2b"),
        *[(side(c, True) - side(c, False)).cast("double").alias(out) for out, c in NEXT_GAME_DIFFS.items()])


@query("j09_full", """
with t as (select b.season_start, b.game_id, b.game_date, b.team_id, b.is_home, b.is_win, e.elo_pre, a.* exclude (season_start, game_id, team_id),
                  r.win_pct_l10, r.avg_point_diff_l10, s.rest_days, s.is_b2b, s.travel_miles, s.traveled, c.core_games5, c.core_min5
           from f_base b left join f_elo e using (game_id, team_id) left join f_adv_roll a using (game_id, team_id)
           left join f_rolling r using (game_id, team_id) left join f_rest s using (game_id, team_id)
           left join f_core c using (game_id, team_id))
select season_start, game_id, game_date, max(case when is_home = 1 then team_id end) as home_team_id,
       max(case when is_home = 0 then team_id end) as away_team_id, max(case when is_home = 1 then is_win end) as home_win,
       max(case when is_home = 1 then is_b2b end) as home_is_b2b, max(case when is_home = 0 then is_b2b end) as away_is_b2b,
       """ + ", ".join(
    f"round(cast(max(case when is_home = 1 then {c} end) - max(case when is_home = 0 then {c} end) as double), {4 if o == 'elo_diff' else 6}) as {o}"
    for o, c in NEXT_GAME_DIFFS.items()) + """
from t group by season_start, game_id, game_date""")
def j09_full(spark, sf_dir):
    """J9 over Elo, W13, W14-W16: the table that the next-game models learn from."""
    return round_doubles(next_game_table(spark, sf_dir).withColumn("elo_diff", F.round("elo_diff", 4)))


@query("w05_form_timeline", """
select season_start, team_id, game_id, game_date, gn as team_game_number, is_win, point_diff,
       round(win_pct_l10, 6) as win_pct_l10, round(win_pct_s2d, 6) as win_pct_s2d
from (select r.*, row_number() over (partition by season_start, team_id order by game_date, game_id) as gn
      from f_rolling r) x where gn <= 30""")
def w05_form_timeline(spark, sf_dir):
    """First 30 games of every team-season with running form."""
    t = FT.form_timeline(rolled_table(spark, sf_dir), 30)
    return round_doubles(t.select("season_start", "team_id", "game_id", "game_date", "team_game_number", "is_win",
                                  "point_diff", "win_pct_l10", "win_pct_s2d"))


@query("w01_rolling_features_hot_key_safe", f"""
select season_start, game_id, game_date, team_id, opp_team_id, is_home, is_win, point_diff, pts, {_R}
from f_rolling""")
def w01_rolling_features_hot_key_safe(spark, sf_dir):
    """W1-W3 with slices of a few rows each, as a team-season that holds a large share of all rows would have."""
    r = rolled_table(spark, sf_dir, slice_rows=7)
    return round_doubles(r.select("season_start", "game_id", "game_date", "team_id", "opp_team_id", "is_home",
                                  "is_win", "point_diff", "pts", *ROLL_COLS))
