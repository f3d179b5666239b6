"""Queries: the streaming jobs run to completion over landed files.

Each query lands data derived from the tables in a fresh folder under the
session's checkpoint directory, runs the stream with ``availableNow`` and
returns the table the stream maintained.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rimshot.operators.features import ROLLING_SPEC
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.oracle_sql import register
from rimshot.session import checkpoint_dir, job, scratch_path, stored
from rimshot.sources import fixtures as fx
from rimshot.streaming import daily as D
from rimshot.streaming import jobs as J

N_CHUNKS = 6
N_FILES = 4


def _scratch(spark, name):
    return scratch_path(spark, f"stream-{name}")


@query("x01_quote_stream", """
with e as (select event_id, user_id as game_id, make_timestamp((epoch_us(ts) // 1000) * 1000) as asof_ts, event_type, value,
                  cast(json_extract_string(props, '$.k') as bigint) as k from events),
f as (select *, row_number() over (partition by asof_ts, game_id order by event_id % 13 = 0, event_id) as rn from e),
q as (select game_id, asof_ts, value, 3e-1 + 1e-3 * k as bid,
             case when event_type = 'error' then null else 3e-1 + 1e-3 * k + 2e-2 end as ask from f where rn = 1),
m as (select q.*, case when ask is not null then 5e-1 * (bid + ask) end as mid from q)
select game_id, asof_ts, round(bid, 6) as bid, round(ask, 6) as ask, round(mid, 6) as mid,
       round(case when ask is not null then bid * value + ask * value end, 6) as liquidity_top_total,
       round(case when mid is not null then
         (case when bid >= mid - 2e-2 then bid * value else 0e0 end) + (case when ask <= mid + 2e-2 then ask * value else 0e0 end)
       end, 6) as liquidity_depth_2c
from m""")
def x01_quote_stream(spark, sf_dir):
    """Book snapshots land in time-ordered files; every thirteenth comes with the last file, however late that
    is, and every tenth is delivered again in the next file with another book, which must not count."""
    root = _scratch(spark, "quotes")
    snaps = fx.book_snapshots(spark, sf_dir)
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    lo, hi = snaps.agg(F.min(ms), F.max(ms)).first()
    chunk = F.floor((ms - F.lit(lo)) * N_CHUNKS / F.lit(hi - lo + 1)).cast("int")
    late = F.col("snapshot_id") % 13 == 0
    orig = snaps.withColumn("chunk", F.when(late, F.lit(N_CHUNKS - 1)).otherwise(chunk))
    again = (orig.where(F.col("snapshot_id") % 10 == 0)
                 .withColumn("snapshot_id", F.col("snapshot_id") + 1000000000)
                 .withColumn("book", F.regexp_replace("book", '"price": ?"0.3', '"price":"0.1'))
                 .withColumn("chunk", F.least(F.col("chunk") + 1, F.lit(N_CHUNKS - 1))))
    checkpoint_dir(spark)
    landed = orig.unionByName(again).select("snapshot_id", "game_id", "book", "chunk").checkpoint()
    files = J.files_of(landed)
    asof = F.get_json_object("book", "$.timestamp")  # with the game, the key of a quote
    J.land_in_time_order(landed, os.path.join(root, "landing"), "ts", N_CHUNKS, files=files, by=("game_id", asof))
    q = J.quote_stream(spark, os.path.join(root, "landing", "chunk-*"), os.path.join(root, "quotes"),
                       os.path.join(root, "_progress"), files_per_trigger=files)
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(root, "quotes"))
    return round_doubles(out.select("game_id", "asof_ts", "bid", "ask", "mid", "liquidity_top_total",
                                    "liquidity_depth_2c"))


# What the last deliveries say: games of the first season whose id is a multiple of 7 come again with other points and
# assists, some player rows with another point, some standings with another win.
_CORRECTED = "season_start = (select min(season_start) from f_game_log) and game_id % 7 = 0"
register("f_daily_log", f"""
select game_id, season_start, game_date, season_type, team_id, matchup,
       pts + case when {_CORRECTED} and matchup like '%vs.%' then 500 else 0 end as pts,
       case when {_CORRECTED} then case when matchup like '%vs.%' then 'W' else 'L' end else wl end as wl
from f_game_log""", ("f_game_log",))
register("f_daily_games", """
select game_id, min(game_date) as game_date,
       max(case when matchup like '%vs.%' then team_id end) as home_team_id,
       max(case when matchup like '%@%' and matchup not like '%vs.%' then team_id end) as away_team_id,
       max(case when matchup like '%vs.%' then pts end) as home_points,
       max(case when matchup like '%@%' and matchup not like '%vs.%' then pts end) as away_points,
       max(case when wl = 'W' then team_id end) as winner, min(season_type) as season_type, min(season_start) as season_start
from f_daily_log group by game_id having count(*) = 2""", ("f_daily_log",))
_BOX_COLUMNS = [c for c in D.FEEDS["team_box"].columns if c not in D.FEEDS["team_box"].keys]
register("f_daily_team_box", f"""
select game_id, season_start, team_id, {", ".join(c if c != "ast" else f"ast + case when {_CORRECTED} then 3 else 0 end as ast" for c in _BOX_COLUMNS)}
from f_team_box""", ("f_team_box", "f_game_log"))


def _daily(spark, sf_dir, files_per_trigger: int, feeds=tuple(D.FEEDS)) -> str:
    """Land the feeds in ``N_FILES`` deliveries each and run the daily load over them; the folder of its tables.

    A delivery of a large table is cut into files by the feed's keys, so the rows of one key come in one file of a
    delivery; a batch takes ``files_per_trigger`` deliveries of each feed.

    Seasons are dealt to the deliveries; the away rows of every fifth game come one delivery later, and the last
    delivery of each feed holds the corrections told above, a row without a team and, of the log, nothing else.
    """
    root = _scratch(spark, "daily")
    checkpoint_dir(spark)
    most = 1
    g = fx.game_log(spark, sf_dir)
    players = fx.player_raw(spark, sf_dir)
    stand = fx.standings(spark, sf_dir).withColumn("run_date", F.make_date(F.col("season_start") + 1, F.lit(6), F.lit(30)))
    raw = {"game_log": g, "team_box": fx.team_box(spark, sf_dir, players), "player_box": players, "standings": stand}
    first = g.agg(F.min("season_start")).first()[0]
    game, home = F.col("game_id") % 7 == 0, F.col("matchup").contains("vs.")
    corrected = {
        "game_log": (game, {"pts": F.col("pts") + F.when(home, 500).otherwise(0), "wl": F.when(home, "W").otherwise("L")}),
        "team_box": (game, {"ast": F.col("ast") + 3}),
        "player_box": (F.col("player_id") % 3 == 0, {"pts": F.col("pts") + 1}),
        "standings": (F.col("team_id") % 5 == 0, {"wins": F.col("wins") + 1}),
    }
    for name in feeds:
        columns = D.FEEDS[name].columns
        rows = raw[name].select(*columns).withColumn("chunk", F.pmod(F.col("season_start") - F.lit(first), F.lit(N_FILES - 2)).cast("int"))
        if name == "game_log":
            rows = rows.withColumn("chunk", F.col("chunk") + ((F.col("game_id") % 5 == 0) & ~home).cast("int"))
        which, change = corrected[name]
        again = rows.where((F.col("season_start") == first) & which).withColumns(change).withColumn("chunk", F.lit(N_FILES - 1))
        nobody = again.limit(1).withColumn("team_id" if name != "player_box" else "player_id", F.lit(None).cast("long"))
        with job(spark):
            landed = stored(rows.unionByName(again).unionByName(nobody))
            files = J.files_of(landed)
            most = max(most, files)
            J.land_in_time_order(landed, os.path.join(root, "landing", name), "season_start", N_FILES, "parquet", files, D.FEEDS[name].keys)
    D.daily_load_stream(spark, {n: os.path.join(root, "landing", n, "chunk-*") for n in feeds}, os.path.join(root, "tables"),
                        os.path.join(root, "_progress"), files_per_trigger=files_per_trigger * most).awaitTermination()
    return os.path.join(root, "tables")


def _table(spark, folder, name, *columns):
    return spark.read.parquet(os.path.join(folder, name)).withColumn("season_start", F.col("season_start").cast("long")).select(*columns)


@query("x02_daily_games_stream", """
select game_id, game_date, home_team_id, away_team_id, home_points, away_points, winner, season_type = 'PlayIn' as play_in_flag,
       season_type = 'Playoffs' as playoff_flag, season_type, season_start
from f_daily_games""")
def x02_daily_games_stream(spark, sf_dir):
    """The games table after all deliveries, one file of the log a batch; corrected games replace the first ones."""
    return _table(spark, _daily(spark, sf_dir, 1, ["game_log"]), "games", "game_id", "game_date", "home_team_id", "away_team_id",
                  "home_points", "away_points", "winner", "play_in_flag", "playoff_flag", "season_type", "season_start")


@query("x02_daily_features", f"""
with r as (
  select season_start, game_id, game_date, home_team_id as team_id, away_team_id as opp_team_id, 1 as is_home,
         case when home_points > away_points then 1 else 0 end as is_win, home_points - away_points as point_diff
  from f_daily_games where season_type = 'Regular Season'
  union all
  select season_start, game_id, game_date, away_team_id, home_team_id, 0,
         case when away_points > home_points then 1 else 0 end, away_points - home_points
  from f_daily_games where season_type = 'Regular Season'),
b as (select r.*, s.pts, s.turnovers, s.ast, s.oreb + s.dreb as reb from r join f_daily_team_box s using (season_start, game_id, team_id))
select season_start, game_id, game_date, team_id, opp_team_id, is_home, is_win,
       {", ".join(f"round(avg({c}) over (w rows between {'unbounded' if n is None else n} preceding and 1 preceding), 6) as {out}"
                  for out, (c, n) in ROLLING_SPEC.items())}
from b window w as (partition by season_start, team_id order by game_date, game_id)""")
def x02_daily_features(spark, sf_dir):
    """The rolling features after all deliveries of log and team box, three files of each a batch."""
    return round_doubles(_table(spark, _daily(spark, sf_dir, 3, ["game_log", "team_box"]), "features", "season_start", "game_id",
                                "game_date", "team_id", "opp_team_id", "is_home", "is_win", *ROLLING_SPEC))


@query("x02_daily_player_box", f"""
with d as (
  select *, 0 as delivery from f_player_raw
  union all
  select * replace (pts + 1 as pts), 1 from f_player_raw
  where season_start = (select min(season_start) from f_game_log) and player_id % 3 = 0),
n as (select *, row_number() over (partition by season_start, game_id, player_id order by delivery desc,
        {", ".join(f"{c} desc" for c in D.FEEDS["player_box"].columns if c not in D.FEEDS["player_box"].keys)}) as rn from d)
select {", ".join(D.FEEDS["player_box"].columns)} from n where rn = 1""")
def x02_daily_player_box(spark, sf_dir):
    """Player rows after all deliveries in one batch; of the rows of one key the last delivered, then the greatest."""
    return _table(spark, _daily(spark, sf_dir, 100, ["player_box"]), "player_box", *D.FEEDS["player_box"].columns)


@query("x02_daily_standings", """
select season_start, make_date(cast(season_start + 1 as integer), 6, 30) as run_date, team_id, conference, division,
       wins + case when season_start = (select min(season_start) from f_game_log) and team_id % 5 = 0 then 1 else 0 end as wins,
       losses, playoff_rank
from f_standings""")
def x02_daily_standings(spark, sf_dir):
    """Standings after all deliveries, two files a batch."""
    return _table(spark, _daily(spark, sf_dir, 2, ["standings"]), "standings", *D.FEEDS["standings"].columns)
