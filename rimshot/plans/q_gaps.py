"""Queries: sinks and gates (S10-S14, U4, F3, F4, F9, O3), dimensions (S9, P1, P2), weeks (P8), model inputs (P13,
P14), the latest standings snapshot (J11), calibration with empty bins (Q5)."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from rimshot.functions import expressions as E
from rimshot.operators import features as FT
from rimshot.operators import filters as FL
from rimshot.operators import metrics as M
from rimshot.operators import normalise as N
from rimshot.operators import quality as QL
from rimshot.operators.elo import elo
from rimshot.operators.merge import replace_slice
from rimshot.operators.ordering import slice_rows
from rimshot.operators.results import team_game_results
from rimshot.plans import q_elo  # noqa: F401  (registers the f_elo oracle CTE)
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.q_metrics import GAME_FOLD, _BIN_SQL, preds_game
from rimshot.session import scratch_path
from rimshot.sources import files as S
from rimshot.sources import fixtures as fx
from rimshot.sources.tables import season_scan

_COLS = ["game_id", "season_start", "home_points", "away_points"]


def _games(spark, sf_dir):
    return fx.games(spark, sf_dir).select(*_COLS, "season_type")


@query("s10_overwrite_sink", "select game_id, season_start, home_points, away_points from f_games where season_type = 'Playoffs'")
def s10_overwrite_sink(spark, sf_dir):
    """The second write replaces the first."""
    path = os.path.join(scratch_path(spark, "s10"), "games")
    g = _games(spark, sf_dir)
    S.write_overwrite(g.select(*_COLS), path)
    S.write_overwrite(g.where("season_type = 'Playoffs'").select(*_COLS), path)
    return spark.read.parquet(path)


@query("s11_partitioned_sink", """
select game_id, home_points + case when season_type = 'Playoffs' then 100 else 0 end as home_points, away_points,
       cast(season_start as integer) as season_start, season_type from f_games""")
def s11_partitioned_sink(spark, sf_dir):
    """A second write replaces the partitions that it has (the playoffs) and leaves the others."""
    path = scratch_path(spark, "s11")
    g = _games(spark, sf_dir)
    S.write_partitioned(g, path, ["season_start", "season_type"])
    S.write_partitioned(g.where("season_type = 'Playoffs'").withColumn("home_points", F.col("home_points") + 100), path,
                        ["season_start", "season_type"])
    return spark.read.parquet(path).select("game_id", "home_points", "away_points", F.col("season_start").cast("int").alias("season_start"), "season_type")


@query("s12_append_sink", """
select cast(game_id as varchar) as game_id, cast(home_points as varchar) as home_points from f_games
union all select cast(game_id as varchar), cast(home_points as varchar) from f_games where season_type = 'PlayIn'""")
def s12_append_sink(spark, sf_dir):
    """S1 + S12: CSV parts with a header each, appended and read back as text."""
    path = scratch_path(spark, "s12")
    g = _games(spark, sf_dir)
    S.write_append(g.select("game_id", "home_points"), path)
    S.write_append(g.where("season_type = 'PlayIn'").select("game_id", "home_points"), path)
    return S.read_csv(spark, path, "game_id string, home_points string")


@query("s13_typed_empty", "select game_id, home_points from f_games where false")
def s13_typed_empty(spark, sf_dir):
    """A typed frame without rows keeps a plan's schema."""
    g = fx.games(spark, sf_dir).select("game_id", "home_points")
    return g.join(S.empty_like(spark, g.schema), ["game_id", "home_points"])


@query("s14_row_gate", """
select season_type, count(*) as games, count(*) filter (where home_points > 400) > 0 as has_high_scores from f_games group by season_type""")
def s14_row_gate(spark, sf_dir):
    """Per season type whether any row passes a test, by the gate that reads at most one row."""
    g = fx.games(spark, sf_dir)
    kinds = [r[0] for r in g.select("season_type").distinct().collect()]
    gate = F.create_map(*[x for k in kinds for x in (F.lit(k), F.lit(S.has_rows(g.where((F.col("season_type") == k) & (F.col("home_points") > 400)))))])
    return g.groupBy("season_type").agg(F.count(F.lit(1)).alias("games")).withColumn("has_high_scores", gate[F.col("season_type")])


@query("u04_replace_slice", """
select game_id, home_points * case when season_start = (select max(season_start) from f_games) then 2 else 1 end as home_points,
       cast(season_start as integer) as season_start from f_games""")
def u04_replace_slice(spark, sf_dir):
    """U4: the last season's slice is replaced, the others stay."""
    path = scratch_path(spark, "u04")
    g = fx.games(spark, sf_dir).select("game_id", "home_points", "season_start")
    replace_slice(g, path, ["season_start"])
    last = g.agg(F.max("season_start")).first()[0]
    replace_slice(g.where(F.col("season_start") == last).withColumn("home_points", F.col("home_points") * 2), path, ["season_start"])
    return spark.read.parquet(path).select("game_id", "home_points", F.col("season_start").cast("int").alias("season_start"))


@query("f03_season_split", """
with s as (select max(season_start) as last from f_games)
select case when season_start = s.last then 'test' else 'train' end as part, count(*) as n from f_games, s
where season_start >= s.last - 2 group by all""")
def f03_season_split(spark, sf_dir):
    """The two seasons before the last train, the last tests."""
    g = fx.games(spark, sf_dir)
    last = g.agg(F.max("season_start")).first()[0]
    parts = FL.season_split(g, [last - 2, last - 1], last)
    one = lambda df, name: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return one(parts[0], "train").unionByName(one(parts[1], "test"))


@query("s04_season_scan", """
with g as (select *, case when home_points > away_points then 1 else 0 end as home_win, home_points - away_points as margin from f_games),
s as (select max(season_start) - 2 as t from f_games)
select case when season_start < t then 'train' else 'test' end as part, game_id, game_date, season_start, home_team_id, away_team_id, home_win, margin
from g, s where season_start <= t""")
def s04_season_scan(spark, sf_dir):
    """A data set landed by season; train on all seasons before the third-last, test on it, one feature."""
    g = fx.games(spark, sf_dir)
    margin = F.col("home_points") - F.col("away_points")
    path = scratch_path(spark, "dataset")
    g.withColumns({"home_win": F.when(margin > 0, 1).otherwise(0), "margin": margin}).write.partitionBy("season_start").parquet(path)
    last = spark.read.parquet(path).agg(F.max("season_start")).first()[0]
    train, test = season_scan(spark, path, last - 2, ["margin"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.withColumn("season_start", F.col("season_start").cast("long"))


_PLAYER_LINE = {"reb": "oreb + dreb", "ast": "ast", "turnovers": "turnovers", "pts": "pts"}
_PLAYER_PCT = {"fg_pct": ("fgm", "fga", 23), "fg3_pct": ("fg3m", "fg3a", 29), "ft_pct": ("ftm", "fta", 31)}


@query("f08_out_of_range_player_lines", f"""
with p as (
  select game_id, team_id, player_id, season_start,
         {", ".join(f"case when {a} = 0 then null else (case when player_id % {k} = 0 then -1e0 when player_id % {k} = 1 then 2e0 else 1e0 end) * {m} / {a} end as {c}"
                    for c, (m, a, k) in _PLAYER_PCT.items())},
         {", ".join(f"case when player_id % {37 + 4 * i} = 0 then -1 else 1 end * ({e}) as {c}" for i, (c, e) in enumerate(_PLAYER_LINE.items()))}
  from f_player_raw)
select game_id, team_id, player_id, season_start, {", ".join(f"round({c}, 6) as {c}" for c in _PLAYER_PCT)}, {", ".join(_PLAYER_LINE)} from p
where {" or ".join(f"{c} < 0 or {c} > 1" for c in _PLAYER_PCT)} or {" or ".join(f"{c} < 0" for c in _PLAYER_LINE)}""")
def f08_out_of_range_player_lines(spark, sf_dir):
    """F8: player rows with any of three percentages outside [0, 1] or any of four counts below 0."""
    who = F.col("player_id")
    pct = [F.when(F.col(a) != 0, F.when(who % k == 0, -1.0).when(who % k == 1, 2.0).otherwise(1.0) * F.col(m) / F.col(a)).alias(c)
           for c, (m, a, k) in _PLAYER_PCT.items()]
    line = [(F.when(who % (37 + 4 * i) == 0, -1).otherwise(1) * F.expr(e)).alias(c) for i, (c, e) in enumerate(_PLAYER_LINE.items())]
    rows = fx.player_raw(spark, sf_dir).select("game_id", "team_id", "player_id", "season_start", *pct, *line)
    return round_doubles(QL.out_of_range(rows, list(_PLAYER_PCT), list(_PLAYER_LINE)))


@query("f04_forward_window", "select game_id, game_date from f_games where game_date between date '1995-03-01' and date '1995-03-31'")
def f04_forward_window(spark, sf_dir):
    """games within 30 days of a date, both ends included."""
    return FL.forward_window(fx.games(spark, sf_dir).select("game_id", "game_date"), dt.date(1995, 3, 1), 30)


@query("f09_keep_models", """
select model, game_id, team_id, round(y_prob, 6) as y_prob from f_preds_game where model = 'win_pct_l10' and y_prob is not null and game_id % 3 <> 0""")
def f09_keep_models(spark, sf_dir):
    """the listed models, rows without a probability dropped."""
    p = preds_game(spark, sf_dir).withColumn("y_prob", F.when(F.col("game_id") % 3 != 0, F.col("y_prob")))
    return round_doubles(FL.keep_models(p, ["win_pct_l10", "other"], ["y_prob"]).select("model", "game_id", "team_id", "y_prob"))


@query("o03_row_slice", """
select game_id from (select game_id, row_number() over (order by game_date, game_id) as rn from f_games) x where rn > 100 and rn <= 250""")
def o03_row_slice(spark, sf_dir):
    """O3: rows 100 to 249 of the date order."""
    return slice_rows(fx.games(spark, sf_dir).select("game_id", "game_date"), ["game_date", "game_id"], 100, 250).select("game_id")


@query("p01_team_dimension", "select cast(team_id as bigint) as team_id, 'Team ' || team_id as full_name, tricode as abbreviation from f_teams")
def p01_team_dimension(spark, sf_dir):
    """P1 + S9: the team feed (each team twice, a column too many) -> one row per team in the dimension's columns."""
    t = fx.teams(spark, sf_dir)
    raw = t.select(F.col("team_id").alias("id"), F.concat(F.lit("Team "), F.col("team_id").cast("string")).alias("full_name"),
                   F.col("tricode").alias("abbreviation"), F.lit("x").alias("other"))
    return N.dimension(raw.unionByName(raw), N.TEAM_DIM_RENAMES, "team_id")


@query("p02_player_dimension", """
select distinct player_id, 'P' || player_id as full_name, player_id % 2 = 0 as is_active from f_player_raw""")
def p02_player_dimension(spark, sf_dir):
    """P2 + S9: the player feed, text ids and repeated rows, -> one row per player."""
    p = fx.player_raw(spark, sf_dir).select(
        F.col("player_id").cast("string").alias("id"), F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("full_name"),
        (F.col("player_id") % 2 == 0).alias("is_active"))
    bad = spark.createDataFrame([(None, "nobody", True)], "id string, full_name string, is_active boolean")
    return N.dimension(p.unionByName(bad), N.PLAYER_DIM_RENAMES, "player_id")


@query("p08_schedule_weeks", """
select '2000-01' as season, cast(season_start as varchar) as season_year, '00' as league_id,
       cast(w as integer) as week_number, 'Week ' || w as week_name, cast(min(game_date) as date) as start_date,
       case when w % 5 <> 0 then cast(max(game_date) as date) end as end_date
from (select season_start, game_date, month(game_date) as w from f_games) x group by season_start, w""")
def p08_schedule_weeks(spark, sf_dir):
    """A weeks feed (here one row per month, some end dates unreadable) -> typed rows."""
    w = fx.games(spark, sf_dir).groupBy("season_start", F.month("game_date").alias("w")).agg(
        F.min("game_date").cast("string").alias("startDate"), F.max("game_date").cast("string").alias("endDate"))
    raw = w.select(F.col("season_start").cast("string").alias("seasonYear"), F.col("w").cast("string").alias("weekNumber"),
                   F.concat(F.lit("Week "), F.col("w").cast("string")).alias("weekName"), "startDate",
                   F.when(F.col("w") % 5 != 0, F.col("endDate")).otherwise("soon").alias("endDate"))
    return N.schedule_weeks(raw, "2000-01", league_id="00")


@query("p13_model_input", """
select game_id, team_id, case when game_id % 4 = 0 then 0 else is_home end as is_home, is_win,
       coalesce(case when game_id % 3 <> 0 then 1e0 * team_points end, 0e0) as team_points from f_results""")
def p13_model_input(spark, sf_dir):
    """P13 + P14: required columns, booleans as numbers, a missing is_home as 0, missing features as 0."""
    r = team_game_results(fx.games(spark, sf_dir)).select(
        "game_id", "team_id", F.when(F.col("game_id") % 4 != 0, F.col("is_home")).alias("is_home"),
        (F.col("is_win") == 1).alias("is_win"), F.when(F.col("game_id") % 3 != 0, F.col("team_points").cast("double")).alias("team_points"))
    return N.fill_features(N.require_columns(r, ["is_home", "is_win"]), ["team_points"])


@query("j11_latest_conference", """
select g.game_id, g.home_team_id as team_id, case when s.team_id % 6 = 2 then 'Moved' else s.conference end as conference,
       cast(s.division as varchar) as division
from f_games g left join f_standings s on s.season_start = g.season_start and s.team_id = g.home_team_id""")
def j11_latest_conference(spark, sf_dir):
    """A team's conference is that of its latest standings snapshot of the season (some moved since the first)."""
    st = fx.standings(spark, sf_dir).select("season_start", "team_id", "conference", F.col("division").cast("string").alias("division"))
    early = st.withColumns({"run_date": F.lit(dt.date(2000, 1, 1)), "division": F.lit("none")})
    late = st.withColumns({"run_date": F.lit(dt.date(2000, 4, 1)),
                           "conference": F.when(F.col("team_id") % 6 == 2, "Moved").otherwise(F.col("conference"))})
    g = fx.games(spark, sf_dir).select("game_id", "season_start", F.col("home_team_id").alias("team_id"))
    return FT.attach_conference(g, FT.latest_snapshot(early.unionByName(late))).select("game_id", "team_id", "conference", "division")


@query("q05_calibration_all_bins", f"""
with b as (select model, season_start, {_BIN_SQL} as bin, count(*) as n, avg(y_prob) as p, avg(1e0 * y_true) as y
           from f_preds_game group by all),
k as (select distinct model, season_start, unnest(range(10)) as bin from f_preds_game)
select k.model, k.season_start, cast(k.bin as integer) as bin, coalesce(b.n, 0) as n, round(b.p, 6) as pred_mean,
       round(b.y, 6) as actual_rate, round(abs(b.p - b.y), 6) as abs_gap
from k left join b on b.model = k.model and b.season_start = k.season_start and b.bin = k.bin""")
def q05_calibration_all_bins(spark, sf_dir):
    """Q5: the calibration table with its empty bins."""
    return round_doubles(M.calibration(preds_game(spark, sf_dir), GAME_FOLD, keep_empty=True))


@query("e06_elo_expected", """
select h.season_start, h.game_id, h.team_id, round(1e0 / (1e0 + pow(1e1, (a.elo_pre - h.elo_pre) / 4e2)), 6) as expected
from f_elo h join f_elo a on a.game_id = h.game_id and a.team_id = h.opp_team_id where h.is_home = 1""")
def e06_elo_expected(spark, sf_dir):
    """The home side's expected result from both ratings before the game."""
    h = elo(team_game_results(fx.games(spark, sf_dir)))
    both = h.where("is_home = 1").join(h.where("is_home = 0").select("game_id", F.col("elo_pre").alias("elo_away")), "game_id")
    return round_doubles(both.select("season_start", "game_id", "team_id", E.elo_expected("elo_pre", "elo_away").alias("expected")))


@query("e10_season_texts", """
select game_id, season_start || '-' || lpad(cast((season_start + 1) % 100 as varchar), 2, '0') as season,
       cast(season_start as integer) as season_back from f_games""")
def e10_season_texts(spark, sf_dir):
    """Season from a date, its text, and the season's start read back from the text."""
    g = fx.games(spark, sf_dir).select("game_id", E.season_text(E.season_start_from_date("game_date")).alias("season"))
    return g.withColumn("season_back", E.season_start_from_text("season"))


@query("u08_audit_columns", "select game_id, home_points, true as stamped from f_games where season_type = 'Playoffs'")
def u08_audit_columns(spark, sf_dir):
    """U8: audit times are set on every loaded row; the times themselves are left out of the comparison."""
    from rimshot.operators.merge import with_audit
    g = fx.games(spark, sf_dir).where("season_type = 'Playoffs'").select("game_id", "home_points")
    a = with_audit(g, "created_at", "updated_at")
    return a.select("game_id", "home_points", (F.col("created_at").isNotNull() & (F.col("created_at") <= F.col("updated_at"))).alias("stamped"))
