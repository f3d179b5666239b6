"""Queries: merges (U1-U3, U5-U7) on loads derived from the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimshot.operators import merge as U
from rimshot.operators import table_merge as TM
from rimshot.operators.market import market_map
from rimshot.plans import q_market  # noqa: F401  (registers the f_markets oracle CTE)
from rimshot.plans.catalog import query
from rimshot.plans.oracle_sql import register
from rimshot.session import scratch_path
from rimshot.sources import fixtures as fx

GAME_COLS = ["game_id", "season_start", "game_date", "home_team_id", "away_team_id", "home_points",
             "away_points", "season_type"]


@query("u01_upsert_games", """
select * from f_games_dirty where game_id not in (select game_id from f_games where season_type = 'Playoffs')
union all
select game_id, season_start, game_date, home_team_id, away_team_id,
       home_points + case when game_id % 5 = 0 then 1 else 0 end, away_points, season_type
from f_games where season_type = 'Playoffs'""")
def u01_upsert_games(spark, sf_dir):
    """A clean playoff file replaces those games in the (dirty) games table; every fifth game is delivered
    twice, the second time with a corrected score, which counts."""
    one = fx.games(spark, sf_dir).where(F.col("season_type") == "Playoffs").select(*GAME_COLS, F.lit(1).alias("delivery"))
    two = one.where(F.col("game_id") % 5 == 0).withColumns({"home_points": F.col("home_points") + 1, "delivery": F.lit(2)})
    return U.upsert(fx.games_dirty(spark, sf_dir), one.unionByName(two), ["game_id"], ["delivery"])


@query("u02_insert_ignore_games", """
with s as (select *, row_number() over (partition by game_id order by home_team_id asc nulls first,
                                          away_team_id asc nulls first, home_points asc nulls first) as rn
           from f_games_dirty)
select game_id, season_start, game_date, home_team_id, away_team_id, home_points, away_points, season_type
from f_games where season_type = 'Regular Season'
union all
select game_id, season_start, game_date, home_team_id, away_team_id, home_points, away_points, season_type
from s where rn = 1 and game_id not in (select game_id from f_games where season_type = 'Regular Season')""")
def u02_insert_ignore_games(spark, sf_dir):
    """Insert-only load; existing keys are never touched, repeated source keys insert once."""
    tgt = fx.games(spark, sf_dir).where(F.col("season_type") == "Regular Season").select(*GAME_COLS)
    order = [F.asc_nulls_first("home_team_id"), F.asc_nulls_first("away_team_id"), F.asc_nulls_first("home_points")]
    return U.insert_ignore(tgt, fx.games_dirty(spark, sf_dir), ["game_id"], order)


register("f_map_target", """
select source_game_id, 'old-' || slug as slug, home_team_abbr, away_team_abbr, game_date,
       case when source_game_id % 13 = 0 then true when source_game_id % 17 = 0 then null else false end
         as is_manual_override
from (select source_game_id, slug, 'T' || home_team_id as home_team_abbr, 'T' || away_team_id as away_team_abbr,
             game_date from f_markets) m
where source_game_id % 10 <> 9""", ("f_markets",))

register("f_map_source", """
select source_game_id, case when source_game_id % 7 = 0 then 'new-' || slug else slug end as slug,
       case when source_game_id % 3 = 0 then null else 'T' || home_team_id end as home_team_abbr,
       'T' || away_team_id as away_team_abbr,
       case when source_game_id % 4 = 0 then null else game_date end as game_date
from f_markets""", ("f_markets",))


def _map_frames(spark, sf_dir):
    m = market_map(fx.market_docs(spark, sf_dir)).select(
        "source_game_id", "slug", "home_team_abbr", "away_team_abbr", "game_date")
    gid = F.col("source_game_id")
    tgt = m.where(gid % 10 != 9).select(
        "source_game_id", F.concat(F.lit("old-"), F.col("slug")).alias("slug"), "home_team_abbr", "away_team_abbr",
        "game_date",
        F.when(gid % 13 == 0, F.lit(True)).when(gid % 17 == 0, F.lit(None).cast("boolean"))
         .otherwise(F.lit(False)).alias("is_manual_override"))
    src = m.select(
        "source_game_id", "slug",
        F.when(gid % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("home_team_abbr")).alias("home_team_abbr"),
        "away_team_abbr",
        F.when(gid % 4 == 0, F.lit(None).cast("date")).otherwise(F.col("game_date")).alias("game_date"),
        F.lit(1).alias("delivery"))
    # every seventh market comes twice: the later row has a new slug and no abbreviation or date
    again = src.where(gid % 7 == 0).withColumns({
        "slug": F.concat(F.lit("new-"), F.col("slug")), "home_team_abbr": F.lit(None).cast("string"),
        "game_date": F.lit(None).cast("date"), "delivery": F.lit(2)})
    return tgt, src.unionByName(again)


@query("u03_guarded_upsert_map", """
select coalesce(t.source_game_id, s.source_game_id) as source_game_id,
       case when s.source_game_id is not null and t.is_manual_override is not true then s.slug else t.slug end as slug,
       case when s.source_game_id is not null and t.is_manual_override is not true
            then coalesce(s.home_team_abbr, t.home_team_abbr) else t.home_team_abbr end as home_team_abbr,
       case when s.source_game_id is not null and t.is_manual_override is not true
            then coalesce(s.away_team_abbr, t.away_team_abbr) else t.away_team_abbr end as away_team_abbr,
       case when s.source_game_id is not null and t.is_manual_override is not true
            then coalesce(s.game_date, t.game_date) else t.game_date end as game_date,
       case when t.source_game_id is not null then t.is_manual_override else false end as is_manual_override
from f_map_target t full outer join f_map_source s on t.source_game_id = s.source_game_id""")
def u03_guarded_upsert_map(spark, sf_dir):
    """Market-map refresh: abbreviations and date keep old values when the feed has none; locked rows stay."""
    tgt, src = _map_frames(spark, sf_dir)
    return U.guarded_upsert(tgt, src, ["source_game_id"], ["home_team_abbr", "away_team_abbr", "game_date"],
                            order=["delivery"])


@query("u05_placeholder_players", """
with facts as (select distinct player_id from f_player_raw),
dim as (select player_id, 'P' || player_id as player_name, true as is_active from facts where player_id < 400)
select * from dim
union all
select player_id, 'UNKNOWN_' || player_id, false from facts where player_id not in (select player_id from dim)""")
def u05_placeholder_players(spark, sf_dir):
    """Late-arriving dimension: box-score players missing from the player table get placeholders."""
    facts = fx.player_raw(spark, sf_dir)
    dim = (facts.select("player_id").distinct().where(F.col("player_id") < 400)
                .select("player_id", F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("player_name"),
                        F.lit(True).alias("is_active")))
    return U.placeholder_dim(facts, dim, "player_id", "player_name", "is_active")


_E8 = ("case when regexp_full_match(trim(cast({0} as varchar)), '[0-9]+') and length(trim(cast({0} as varchar))) < 10 "
       "then lpad(trim(cast({0} as varchar)), 10, '0') else trim(cast({0} as varchar)) end")


@query("u06_pending_games", f"""
select * from f_schedule s
where not exists (select 1 from f_team_box b where {_E8.format('b.game_id')} = {_E8.format('s.game_id')})""")
def u06_pending_games(spark, sf_dir):
    """Schedule games whose box score has not been loaded (ids normalised to 10 digits both sides)."""
    return U.pending(fx.schedule(spark, sf_dir), fx.team_box(spark, sf_dir).select("game_id"), "game_id")


register("f_schedule_updates", """
select game_id, date_add(game_date, case when game_id % 6 = 0 then 2 else 1 end) as game_date,
       case when game_id % 6 = 0 then 'Final/OT' else 'Final' end as game_status_text, home_team_id, away_team_id
from f_schedule where game_status_text = 'Scheduled'
union all
select game_id, game_date, 'Scheduled', home_team_id, away_team_id from f_games where season_type = 'Playoffs'""",
         ("f_schedule", "f_games"))


@query("u07_patch_schedule", """
select t.season_start, coalesce(t.game_id, s.game_id) as game_id,
       case when s.game_status_text is not null then s.game_date else t.game_date end as game_date,
       case when t.game_status_text is not null then t.home_team_id else s.home_team_id end as home_team_id,
       case when t.game_status_text is not null then t.away_team_id else s.away_team_id end as away_team_id,
       case when s.game_status_text is not null then s.game_status_text else t.game_status_text end as game_status_text
from f_schedule t full outer join f_schedule_updates s on t.game_id = s.game_id""")
def u07_patch_schedule(spark, sf_dir):
    """status/date updates patch the schedule (the later of two counts); other columns kept; unknown games
    inserted."""
    return U.patch(fx.schedule(spark, sf_dir), _schedule_feed(spark, sf_dir), ["game_id"], ["game_status_text", "game_date"],
                   order=["delivery"])


def _schedule_feed(spark, sf_dir):
    upd1 = fx.schedule(spark, sf_dir).where(F.col("game_status_text") == "Scheduled").select(
        "game_id", F.date_add("game_date", 1).alias("game_date"), F.lit("Final").alias("game_status_text"),
        "home_team_id", "away_team_id")
    later = upd1.where(F.col("game_id") % 6 == 0).withColumns({
        "game_date": F.date_add("game_date", 1), "game_status_text": F.lit("Final/OT")})
    upd2 = fx.games(spark, sf_dir).where(F.col("season_type") == "Playoffs").select(
        "game_id", "game_date", F.lit("Scheduled").alias("game_status_text"), "home_team_id", "away_team_id")
    return upd1.unionByName(upd2).withColumn("delivery", F.lit(1)).unionByName(later.withColumn("delivery", F.lit(2)))


@query("u01_upsert_table", """
select game_id, season_start, game_date, home_team_id, away_team_id,
       home_points + case when season_start = (select max(season_start) from f_games) and game_id % 5 = 0 then 1 else 0 end
         as home_points, away_points, season_type from f_games""")
def u01_upsert_table(spark, sf_dir):
    """U1 on a stored table by season: a file of corrected scores of the last season touches that partition alone."""
    path = scratch_path(spark, "games-table")
    games = fx.games(spark, sf_dir).select(*GAME_COLS)
    games.write.partitionBy("season_start").parquet(path)
    last = games.agg(F.max("season_start").alias("last"))
    fixed = (games.join(F.broadcast(last), F.col("season_start") == F.col("last")).where(F.col("game_id") % 5 == 0)
             .withColumn("home_points", F.col("home_points") + 1).select(*GAME_COLS))
    TM.merge_table(spark, path, fixed, ["game_id"], ["season_start"], lambda t, s: U.upsert(t, s, ["game_id"]))
    return spark.read.schema(games.schema).parquet(path)


@query("u07_patch_table", """
select t.season_start, coalesce(t.game_id, s.game_id) as game_id,
       case when s.game_status_text is not null then s.game_date else t.game_date end as game_date,
       case when t.game_status_text is not null then t.home_team_id else s.home_team_id end as home_team_id,
       case when t.game_status_text is not null then t.away_team_id else s.away_team_id end as away_team_id,
       case when s.game_status_text is not null then s.game_status_text else t.game_status_text end as game_status_text
from f_schedule t full outer join f_schedule_updates s on t.game_id = s.game_id""")
def u07_patch_table(spark, sf_dir):
    """U7 on a stored table by season: the feed has no season, so its keys find the partitions; unknown games go to
    the partition without a season."""
    path = scratch_path(spark, "schedule-table")
    schedule = fx.schedule(spark, sf_dir)
    schedule.write.partitionBy("season_start").parquet(path)
    TM.merge_table(spark, path, _schedule_feed(spark, sf_dir), ["game_id"], ["season_start"],
                   lambda t, s: U.patch(t, s, ["game_id"], ["game_status_text", "game_date"], order=["delivery"]))
    return spark.read.schema(schedule.schema).parquet(path)
