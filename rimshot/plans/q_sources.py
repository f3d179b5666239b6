"""Queries: landed-file sources and schema normalisation.

Some of these land derived files first (CSV parts with two header variants,
a partitioned game log) in a fresh folder under the session's checkpoint
directory, then read them back the way a landing-zone job would.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rimshot.operators import normalise as N
from rimshot.plans.catalog import query
from rimshot.session import scratch_path
from rimshot.sources import files as S
from rimshot.sources import fixtures as fx

CAMEL = {v: k for k, v in N.BOX_RENAMES.items() if k[0].islower() or k.startswith("SEASON")}
LEGACY = {"game_id": "GAME_ID", "team_id": "TEAM_ID", "player_id": "PLAYER_ID", "minutes": "MIN", "fgm": "FGM",
          "fga": "FGA", "fg3m": "FG3M", "fg3a": "FG3A", "ftm": "FTM", "fta": "FTA", "oreb": "OREB", "dreb": "DREB",
          "ast": "AST", "turnovers": "TO", "pts": "PTS", "season": "SEASON", "season_type": "SEASON_TYPE"}
PART_ROWS = 250_000  # rows of a landed CSV part: a part is read by one task
PLAYER_STATS = ["fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "ast", "turnovers", "pts"]


def _scratch(spark, name):
    return scratch_path(spark, f"landing-{name}")


def _season_text(c):
    return F.concat(c.cast("string"), F.lit("-"), F.lpad(((c + 1) % 100).cast("string"), 2, "0"))


@query("p03_team_box_normalise", """
select cast(game_id as varchar) as game_id, team_id, fgm, fga, round(fg_pct, 6) as fg_pct, fg3m, fg3a,
       round(fg3_pct, 6) as fg3_pct, ftm, fta, round(ft_pct, 6) as ft_pct, oreb, dreb, reb, ast, turnovers, pts,
       cast(season_start as varchar) || '-' || lpad(cast((season_start + 1) % 100 as varchar), 2, '0') as season,
       season_type
from f_team_stats""")
def p03_team_box_normalise(spark, sf_dir):
    """P3 + P10 + W18: a camelCase team box feed (text values, a re-delivered slice) -> canonical typed rows."""
    t = fx.team_stats(spark, sf_dir).withColumn("season", _season_text(F.col("season_start")))
    cols = ["game_id", "team_id", "fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct",
            "oreb", "dreb", "reb", "ast", "turnovers", "pts", "season", "season_type"]
    raw = t.select(*[F.col(c).cast("string").alias(CAMEL[c]) for c in cols])
    raw = raw.unionByName(raw.where(F.col("gameId").cast("bigint") % 9 == 0))      # re-delivered part
    box = N.box_score(raw, "team")
    box = N.dedup_first(box, ["game_id", "team_id"], ["pts", "fga"])
    return box.select(*[F.round(c, 6).alias(c) if c.endswith("_pct") else F.col(c) for c in box.columns])


_PLAYER_ORACLE = """
with p as (select *, row_number() over (partition by game_id, player_id
                                        order by team_id, fgm, fga, fg3m, fg3a, ftm, fta, oreb, dreb, ast, turnovers, pts,
                                                 minutes) as rn
           from f_player_raw)
select cast(game_id as varchar) as game_id, team_id, player_id, minutes, fgm, fga, fg3m, fg3a, ftm, fta, oreb, dreb,
       ast, turnovers, pts,
       cast(season_start as varchar) || '-' || lpad(cast((season_start + 1) % 100 as varchar), 2, '0') as season,
       season_type
from p where rn = 1"""


@query("s02_player_csv_parts", _PLAYER_ORACLE)
def s02_player_csv_parts(spark, sf_dir):
    """S1 + S2 + P4 + P5 + T4 + W18: player rows landed as CSV parts in two header dialects (camelCase for
    even seasons, legacy UPPERCASE for odd), plus an empty part and a part without ids; read back by
    header group, normalised, deduplicated on (game_id, player_id)."""
    p = fx.player_raw(spark, sf_dir).withColumn("season", _season_text(F.col("season_start")))
    cols = ["game_id", "team_id", "player_id", "minutes", *PLAYER_STATS, "season", "season_type"]
    root = _scratch(spark, "players")
    even = p.where(F.col("season_start") % 2 == 0).select(*[F.col(c).cast("string").alias(CAMEL[c]) for c in cols])
    odd = p.where(F.col("season_start") % 2 == 1).select(*[F.col(c).cast("string").alias(LEGACY[c]) for c in cols])
    even.write.options(header=True, maxRecordsPerFile=PART_ROWS).csv(os.path.join(root, "camel"))
    odd.write.options(header=True, maxRecordsPerFile=PART_ROWS).csv(os.path.join(root, "legacy"))
    # an empty part and a part without id columns, landed through Spark like the rest
    spark.createDataFrame([], "value string").coalesce(1).write.text(os.path.join(root, "empty"))
    spark.createDataFrame([("teamName,points",), ("X,1",)], "value string").coalesce(1) \
         .write.text(os.path.join(root, "no_ids"))
    # a team feed: it has game ids but no player ids, so its rows are no player rows
    spark.createDataFrame([("gameId,teamId,points",), ("1,2,3",)], "value string").coalesce(1) \
         .write.text(os.path.join(root, "team_feed"))
    raw = S.read_csv_parts(spark, os.path.join(root, "*", "part-*"))
    box = N.box_score(raw, "player")
    order = ["team_id", *PLAYER_STATS[:-2], "turnovers", "pts", "minutes"]
    return N.dedup_first(box, ["game_id", "player_id"], order).select(
        "game_id", "team_id", "player_id", "minutes", *PLAYER_STATS, "season", "season_type")


@query("s05_scoreboard_games", """
select cast(game_id as varchar) as game_id, game_date,
       case when game_id % 10 = 0 then 1 else 3 end as game_status,
       case when game_id % 10 = 0 then 'Scheduled' else 'Final' end as game_status_text,
       home_team_id, 'T' || home_team_id as home_team_tricode, away_team_id, 'T' || away_team_id as away_team_tricode,
       'Arena ' || home_team_id as arena_name, 'City ' || home_team_id as arena_city,
       cast(null as varchar) as arena_state
from f_games where season_type = 'Regular Season'""")
def s05_scoreboard_games(spark, sf_dir):
    """One scoreboard JSON document per game day (with an id-less placeholder game) -> one row per game."""
    g = fx.games(spark, sf_dir).where(F.col("season_type") == fx.REGULAR)

    def game(gid, status, text, home, away):
        return F.struct(
            gid.alias("gameId"), status.alias("gameStatus"), text.alias("gameStatusText"),
            F.struct(home.alias("teamId"), F.concat(F.lit("T"), home.cast("string")).alias("teamTricode")).alias("homeTeam"),
            F.struct(away.alias("teamId"), F.concat(F.lit("T"), away.cast("string")).alias("teamTricode")).alias("awayTeam"),
            F.struct(F.concat(F.lit("Arena "), home.cast("string")).alias("arenaName"),
                     F.concat(F.lit("City "), home.cast("string")).alias("arenaCity")).alias("arena"))

    gid = F.col("game_id")
    real = game(gid.cast("string"), F.when(gid % 10 == 0, 1).otherwise(3),
                F.when(gid % 10 == 0, "Scheduled").otherwise("Final"), F.col("home_team_id"), F.col("away_team_id"))
    # every day also lists a placeholder entry without a game id, which the parser must skip
    blank = game(F.lit(None).cast("string"), F.lit(0), F.lit("TBD"), F.lit(None).cast("bigint"),
                 F.lit(None).cast("bigint"))
    days = g.groupBy("game_date").agg(F.collect_list(real).alias("games"))
    docs = days.select(F.to_json(F.struct(F.struct(
        F.col("game_date").cast("string").alias("gameDate"),
        F.concat(F.col("games"), F.array(blank)).alias("games")).alias("scoreboard"))).alias("doc"))
    return S.scoreboard_games(docs)


@query("s08_mapping_rows", """
with m as (select game_id, slug from f_market_matched)
select cast(game_id as varchar) as game_id, slug from m where game_id % 6 <> 5""")
def s08_mapping_rows(spark, sf_dir):
    """Mapping file rows with padded ids, the slug under either column name, blank rows dropped."""
    from rimshot.plans.q_market import _markets, _schedule_games
    from rimshot.operators.market import resolve_markets
    matched, _ = resolve_markets(_schedule_games(spark, sf_dir), _markets(spark, sf_dir), fx.tricode_names(spark))
    gid = F.col("game_id")
    raw = matched.select(
        F.concat(F.lit("  "), gid.cast("string"), F.lit(" ")).alias("game_id"),
        F.when(gid % 2 == 0, F.col("slug")).when(gid % 6 == 5, F.lit("  ")).otherwise(F.lit("")).alias("polymarket_slug"),
        F.when(gid % 6 == 5, F.lit(" ")).when(gid % 2 == 1, F.concat(F.lit(" "), F.col("slug"))).alias("slug"))
    return S.mapping_rows(raw)


@query("s15_quarantine_games", """
select *, case when home_team_id is null or away_team_id is null then 'missing_team'
               when home_points is null or away_points is null then 'missing_points'
               when home_team_id >= 1000 then 'unknown_team' end as reason
from f_games_dirty
where home_team_id is null or away_team_id is null or home_points is null or away_points is null
   or home_team_id >= 1000""")
def s15_quarantine_games(spark, sf_dir):
    """Bad game rows split off with the first failing rule as the reason."""
    g = fx.games_dirty(spark, sf_dir)
    _, bad = S.split_good_bad(g, {
        "missing_team": F.col("home_team_id").isNull() | F.col("away_team_id").isNull(),
        "missing_points": F.col("home_points").isNull() | F.col("away_points").isNull(),
        "unknown_team": F.col("home_team_id") >= 1000})
    return bad


@query("s16_landed_log_first_type", """
with l as (select *, case season_type when 'Regular Season' then 1 when 'PlayIn' then 2 when 'Playoffs' then 3 end as p from f_game_log),
b as (select *, min(p) over (partition by game_date) as best from l)
select game_id, game_date, team_id, pts, matchup, wl, season_start, season_type from b where p = best""")
def s16_landed_log_first_type(spark, sf_dir):
    """The game log landed under season_start=/season_type= directories, read back with partition
    discovery; per game day the first season type (Regular Season, PlayIn, Playoffs) with rows wins."""
    root = _scratch(spark, "gamelog")
    games = fx.game_log(spark, sf_dir)
    other = games.where(F.col("game_id") % 29 == 0).withColumn("season_type", F.lit("All-Star"))   # never counts
    games.unionByName(other).write.partitionBy("season_start", "season_type").parquet(root)
    log = S.landed_game_log(spark, root, "parquet")
    out = S.first_nonempty_season_type(log, ["game_date"])
    return out.select("game_id", "game_date", "team_id", "pts", "matchup", "wl",
                      F.col("season_start").cast("bigint").alias("season_start"), "season_type")


@query("p07_schedule_normalise", """
select '2000-01' as season, cast(season_start as varchar) as season_year,
       case when game_id % 9 <> 0 then '0' || cast(game_id % 2 as varchar) else '00' end as league_id, game_id,
       '20000101/T' || cast(away_team_id as varchar) as game_code,
       case when game_status_text = 'Final' then 3 when game_status_text = 'Scheduled' then 1 end as game_status,
       game_status_text,
       cast(game_date as timestamp) as game_date_utc, cast(game_date as timestamp) + interval 1410 minute as game_datetime_utc,
       case when game_id % 4 <> 0 then cast(game_date - 1 as timestamp) end as game_date_est,
       case when game_id % 5 <> 0 then cast(game_date as timestamp) + interval 1170 minute end as game_datetime_est,
       home_team_id, away_team_id, 'T' || cast(home_team_id as varchar) as home_team_tricode,
       cast(null as varchar) as away_team_tricode,
       'Arena ' || cast(home_team_id as varchar) as arena_name, 'City' as arena_city, 'ST' as arena_state,
       case when game_id % 40 = 0 then 'true' else 'false' end as is_neutral, 'A' as postponed_status,
       case when game_id % 4 <> 0 then cast(game_date - 1 as date) else game_date end as game_date
from (select season_start, coalesce(game_id, 0) as game_id, game_date, home_team_id, away_team_id, game_status_text
      from f_schedule) x
where home_team_id is not null and away_team_id is not null""")
def p07_schedule_normalise(spark, sf_dir):
    """P7 + P11: a raw schedule feed (text ids, date and time fields of two calendars) -> typed schedule rows."""
    sch = fx.schedule(spark, sf_dir).fillna(0, subset=["game_id"])
    gid, text = F.col("game_id"), (lambda c: F.col(c).cast("string"))
    day = text("game_date")
    raw = sch.select(
        text("season_start").alias("seasonYear"),
        F.when(gid % 9 != 0, F.concat(F.lit("0"), (gid % 2).cast("string"))).alias("leagueId"),
        text("game_id").alias("gameId"), F.concat(F.lit("20000101/T"), text("away_team_id")).alias("gameCode"),
        F.when(F.col("game_status_text") == "Final", "3").when(F.col("game_status_text") == "Scheduled", "1")
         .otherwise("n/a").alias("gameStatus"),
        F.col("game_status_text").alias("gameStatusText"), F.concat(day, F.lit("T00:00:00Z")).alias("gameDateUTC"),
        F.concat(day, F.lit("T23:30:00Z")).alias("gameDateTimeUTC"),
        F.when(gid % 4 == 0, "TBD").otherwise(F.date_sub("game_date", 1).cast("string")).alias("gameDateEst"),
        F.when(gid % 5 != 0, F.concat(day, F.lit(" 19:30:00"))).alias("gameDateTimeEst"),
        text("home_team_id").alias("homeTeam_teamId"), text("away_team_id").alias("awayTeam_teamId"),
        F.concat(F.lit("T"), text("home_team_id")).alias("homeTeam_teamTricode"),
        F.concat(F.lit("Arena "), text("home_team_id")).alias("arenaName"), F.lit("City").alias("arenaCity"),
        F.lit("ST").alias("arenaState"), F.when(gid % 40 == 0, "true").otherwise("false").alias("isNeutral"),
        F.lit("A").alias("postponedStatus"))
    return N.schedule(raw, "2000-01", league_id="00")


@query("f05_game_type_digit", """
select game_id, lpad(cast(game_id as varchar), 10, '0') as game_id_10,
       substr(lpad(cast(game_id as varchar), 10, '0'), 5, 1) as type_digit,
       substr(lpad(cast(game_id as varchar), 10, '0'), 5, 1) in ('2', '4') as regular_or_playoff
from f_games""")
def f05_game_type_digit(spark, sf_dir):
    """E8 + F5: canonical 10-digit ids and the game-type digit flag for every game."""
    from rimshot.functions.expressions import normalize_game_id
    from rimshot.operators.filters import GAME_TYPE_DIGITS, game_type_digit
    g = fx.games(spark, sf_dir).select("game_id")
    d = game_type_digit(F.col("game_id"))
    return g.select("game_id", normalize_game_id(F.col("game_id")).alias("game_id_10"), d.alias("type_digit"),
                    d.isin(list(GAME_TYPE_DIGITS)).alias("regular_or_playoff"))


@query("p06_standings_normalise", """
select cast(season_start as varchar) as SeasonID, team_id as TeamID, conference as Conference,
       cast(playoff_rank as double) as PlayoffRank, cast(division as varchar) as Division,
       case when season_start % 2 = 0 then cast(wins as double) end as WINS, cast(losses as double) as LOSSES,
       round(1e0 * wins / (wins + losses), 6) as WinPCT,
       case when team_id % 7 = 3 then null else cast(make_date(cast(season_start + 1 as integer), 4, 15) as date) end as RUN_DATE
from f_standings""")
def p06_standings_normalise(spark, sf_dir):
    """A standings feed with text numbers (some unparseable), a lower-case run_date column and
    some unparseable dates -> typed standings rows."""
    st = fx.standings(spark, sf_dir)
    raw = st.select(
        F.col("season_start").cast("string").alias("SeasonID"), F.col("team_id").alias("TeamID"),
        F.col("conference").alias("Conference"), F.col("playoff_rank").cast("string").alias("PlayoffRank"),
        F.col("division").cast("string").alias("Division"),
        F.when(F.col("season_start") % 2 == 0, F.col("wins").cast("string")).otherwise(F.lit("n/a")).alias("WINS"),
        F.col("losses").cast("string").alias("LOSSES"),
        (F.col("wins") / (F.col("wins") + F.col("losses"))).cast("string").alias("WinPCT"),
        F.when(F.col("team_id") % 7 == 3, F.lit("not a date"))
         .otherwise(F.concat((F.col("season_start") + 1).cast("string"), F.lit("-04-15"))).alias("run_date"),
        F.lit("x").alias("IgnoredColumn"))
    from rimshot.operators.normalise import standings as norm_standings
    out = norm_standings(raw)
    return out.withColumn("WinPCT", F.round("WinPCT", 6))


_ADV_CAMEL = {"team_id": "teamId", "off_rtg": "offensiveRating", "def_rtg": "defensiveRating", "net_rtg": "netRating",
              "pace": "pace", "poss": "possessions", "efg_pct": "effectiveFieldGoalPercentage",
              "ts_pct": "trueShootingPercentage", "tov_pct": "turnoverRatio",
              "oreb_pct": "offensiveReboundPercentage", "dreb_pct": "defensiveReboundPercentage"}
_ADV_UPPER = {"team_id": "TEAM_ID", "off_rtg": "OFF_RATING", "def_rtg": "DEF_RATING", "net_rtg": "NET_RATING",
              "pace": "PACE", "poss": "POSS", "efg_pct": "EFG_PCT", "ts_pct": "TS_PCT", "tov_pct": "TOV_PCT",
              "oreb_pct": "OREB_PCT", "dreb_pct": "DREB_PCT"}
_ADV = list(_ADV_CAMEL)


@query("p09_advanced_stats", """
with a as (select b.game_id, b.team_id, b.is_home, b.fga + 0.44e0 * b.fta - b.oreb + b.turnovers as poss,
                  case when b.fga + 0.44e0 * b.fta - b.oreb + b.turnovers <> 0
                       then 1e2 * b.pts / (b.fga + 0.44e0 * b.fta - b.oreb + b.turnovers) end as off_rtg,
                  case when b.fga <> 0 then (b.fgm + 5e-1 * b.fg3m) / b.fga end as efg_pct
           from f_base b),
c as (select game_id, count(*) as n from a group by game_id)
select a.game_id, a.team_id, round(a.off_rtg, 6) as off_rtg, round(a.off_rtg - 1e0, 6) as def_rtg, 1e0 as net_rtg,
       round(a.poss + 2.5e-1, 6) as pace, round(a.poss, 6) as poss,
       round(case when a.game_id % 3 = 0 then null else a.efg_pct end, 6) as efg_pct,
       round(a.efg_pct / 2, 6) as ts_pct, case when a.game_id % 2 = 0 then 1.25e-1 end as tov_pct,
       3.75e-1 as oreb_pct, 6.25e-1 as dreb_pct
from a join c on a.game_id = c.game_id
where c.n = 2 and a.game_id % 11 <> 0 and not (a.game_id % 7 = 0 and a.is_home = 0)""")
def p09_advanced_stats(spark, sf_dir):
    """A game's frames in order: a player frame (three rows), the team frame, and for some games a second team
    frame, which does not count. camelCase (even games) or UPPERCASE (odd games) names, blank strings for missing
    values; the away id of every seventh game is missing, both ids of every eleventh."""
    from rimshot.operators.features import advanced_metrics
    from rimshot.plans.q_features import base_table
    adv = advanced_metrics(base_table(spark, sf_dir)).select("game_id", "team_id", "is_home", "off_rtg", "poss", "efg_pct")
    gid = F.col("game_id")
    txt = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    team = F.when((gid % 11 == 0) | ((gid % 7 == 0) & (F.col("is_home") == 0)), F.lit(None)).otherwise(F.col("team_id").cast("string"))
    values = {"team_id": team, "off_rtg": txt(F.col("off_rtg")), "def_rtg": txt(F.col("off_rtg") - 1), "net_rtg": F.lit("1.0"),
              "pace": txt(F.col("poss") + 0.25), "poss": txt(F.col("poss")),
              "efg_pct": F.when(gid % 3 == 0, "").otherwise(txt(F.col("efg_pct"))), "ts_pct": txt(F.col("efg_pct") / 2),
              "tov_pct": F.when(gid % 2 == 0, "0.125").otherwise("n/a"), "oreb_pct": F.lit("0.375"), "dreb_pct": F.lit("0.625")}

    def frame(names, rows):
        return rows.select("game_id", "frame_no", F.lit(True).alias("has_team_id"),
                           *[values[k].cast("string").alias(n) for k, n in names.items()])

    teams = adv.withColumn("frame_no", F.lit(1))
    # the player frame repeats the home row three times; its metrics would be wrong ones
    players = (adv.where("is_home = 1").withColumns({"off_rtg": F.lit(-1.0), "frame_no": F.lit(0)})
               .withColumn("_i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("_i"))
    second = adv.where(gid % 4 == 0).withColumns({"off_rtg": F.lit(-2.0), "frame_no": F.lit(2)})
    rows = teams.unionByName(players).unionByName(second)
    frames = frame(_ADV_CAMEL, rows.where(gid % 2 == 0)).unionByName(
        frame(_ADV_UPPER, rows.where(gid % 2 == 1)), allowMissingColumns=True)
    out = N.advanced_stats(frames)
    return out.select("game_id", "team_id", *[F.round(c, 6).alias(c) for c in _ADV[1:]])
