"""Queries: order-book quotes (S6), market map (S7), both outcomes (S17), market resolution."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.operators import market as MK
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.oracle_sql import register
from rimshot.sources import fixtures as fx

_NAMES_SQL = ", ".join(
    "('{}', [{}])".format(k, ", ".join("'{}'".format(n) for n in v)) for k, v in fx.TRICODE_NAMES.items())

# Oracle: book levels of both tokens of a game. Token 1 is the mirror book of token 0.
register("f_levels2", """
select b.game_id, 0 as token_index, b.side, b.price, b.size,
       cast(date_diff('day', date '1970-01-01', g.game_date) as bigint) * 86400000 + b.game_id % 86400000 as ms
from f_book_levels b join f_games g on b.game_id = g.game_id
union all
select b.game_id, 1, case when b.side = 'bid' then 'ask' else 'bid' end, 1e0 - b.price, b.size,
       cast(date_diff('day', date '1970-01-01', g.game_date) as bigint) * 86400000 + b.game_id % 86400000 + 250
from f_book_levels b join f_games g on b.game_id = g.game_id""", ("f_book_levels", "f_games"))

register("f_quotes2", """
with bb as (select game_id, token_index, price as bid, size as bid_size from (
              select *, row_number() over (partition by game_id, token_index order by price desc, size desc) as rk
              from f_levels2 where side = 'bid') x where rk = 1),
ba as (select game_id, token_index, price as ask, size as ask_size from (
              select *, row_number() over (partition by game_id, token_index order by price, size) as rk
              from f_levels2 where side = 'ask') x where rk = 1),
k as (select game_id, token_index, min(ms) as ms from f_levels2 group by 1, 2),
q as (select k.game_id, k.token_index, k.ms, bb.bid, ba.ask, bb.bid_size, ba.ask_size,
             case when bb.bid is not null and ba.ask is not null then 5e-1 * (bb.bid + ba.ask) end as mid
      from k left join bb using (game_id, token_index) left join ba using (game_id, token_index)),
d as (select q.game_id, q.token_index,
             sum(case when l.side = 'bid' and l.price >= q.mid - 2e-2 then l.price * l.size
                      when l.side = 'ask' and l.price <= q.mid + 2e-2 then l.price * l.size else 0e0 end) as depth
      from q join f_levels2 l on l.game_id = q.game_id and l.token_index = q.token_index group by 1, 2)
select q.game_id, q.token_index, epoch_ms(q.ms) as asof_ts, q.bid, q.ask, q.mid,
       case when q.bid is not null and q.ask is not null then q.bid * coalesce(q.bid_size, 0e0) + q.ask * coalesce(q.ask_size, 0e0) end
         as liquidity_top_total,
       case when q.mid is not null then d.depth end as liquidity_depth_2c
from q left join d using (game_id, token_index)""", ("f_levels2",))

register("f_markets", """
select game_id as source_game_id, game_date, home_team_id, away_team_id,
       case game_id % 5
         when 0 then concat_ws('-', 'nba', 't' || away_team_id, 't' || home_team_id, cast(game_date as varchar))
         when 1 then concat_ws('-', 'nba', 't' || home_team_id, 'vs', 't' || away_team_id, cast(game_date as varchar))
         when 2 then concat_ws('-', 'nba', 't' || away_team_id, 't' || home_team_id, cast(game_date as varchar), 'moneyline')
         when 3 then concat_ws('-', 'nba', 't' || away_team_id, 'at', 't' || home_team_id, cast(game_date as varchar))
         else concat_ws('-', 'nba', 't' || home_team_id, 't' || away_team_id, cast(game_date as varchar)) end as slug,
       case when game_id % 7 = 5 then '["T98", "T99"]' when game_id % 5 = 4 then '["Yes", "No"]'
            else '["T' || away_team_id || '", "T' || home_team_id || '"]' end as outcomes,
       case when game_id % 7 = 5 then 'Will T98 beat T99?'
            else 'Will T' || away_team_id || '  beat T' || home_team_id || '?' end as question
from f_games where season_type = 'Regular Season'""", ("f_games",))


def _schedule_games(spark, sf_dir):
    return fx.games(spark, sf_dir).where(F.col("season_type") == fx.REGULAR).select(
        "game_id", "game_date",
        F.concat(F.lit("T"), F.col("home_team_id").cast("string")).alias("home_tricode"),
        F.concat(F.lit("T"), F.col("away_team_id").cast("string")).alias("away_tricode"))


def _markets(spark, sf_dir):
    docs = fx.market_docs(spark, sf_dir)
    return docs.select("slug", F.get_json_object("market", "$.question").alias("question"),
                       F.get_json_object("market", "$.outcomes").alias("outcomes"))


def _book_docs_both(spark, sf_dir):
    """Book documents for both tokens of each game: token 0 as landed, token 1 its mirror book. The levels are gathered
    once a game, and the mirror book is made from the gathered levels."""
    lv = fx.book_levels(spark, sf_dir)
    lvl = F.struct("price", "size")
    per = lv.groupBy("game_id").agg(
        F.collect_list(F.when(F.col("side") == "bid", lvl)).alias("bids"),
        F.collect_list(F.when(F.col("side") == "bid", None).otherwise(lvl)).alias("asks"))
    g = fx.games(spark, sf_dir).select("game_id", "game_date")
    base_ms = F.unix_date("game_date").cast("bigint") * 86400000 + F.col("game_id") % 86400000

    def mirror(levels):
        return F.transform(levels, lambda l: F.struct((F.lit(1.0) - l["price"]).alias("price"), l["size"].alias("size")))

    def book(idx, extra, bids, asks):
        return F.struct(F.concat(F.col("game_id").cast("string"), F.lit(str(idx))).alias("token_id"), F.to_json(F.struct(
            (base_ms + extra).cast("string").alias("timestamp"), F.sort_array(bids).alias("bids"),
            F.sort_array(asks).alias("asks"))).alias("book"))

    return per.join(g, "game_id").select(F.inline(F.array(
        book(0, 0, F.col("bids"), F.col("asks")), book(1, 250, mirror(F.col("asks")), mirror(F.col("bids"))))))


@query("s06_book_quotes", """
select game_id, asof_ts, round(bid, 6) as bid, round(ask, 6) as ask, round(mid, 6) as mid,
       round(liquidity_top_total, 6) as liquidity_top_total, round(liquidity_depth_2c, 6) as liquidity_depth_2c
from f_quotes2 where token_index = 0""")
def s06_book_quotes(spark, sf_dir):
    """S6 + E12-E16: quotes from order-book JSON documents."""
    return round_doubles(MK.book_quotes(fx.book_docs(spark, sf_dir)))


@query("s07_market_map", """
select source_game_id, slug, 'm' || source_game_id as gamma_market_id, 'c' || source_game_id as clob_market_id,
       'e' || source_game_id as gamma_event_id, source_game_id || '0' as token_yes_id, source_game_id || '1' as token_no_id,
       'T' || home_team_id as home_team_abbr, 'T' || away_team_id as away_team_abbr, game_date
from f_markets""")
def s07_market_map(spark, sf_dir):
    """S7 + E11 + E17: game-map rows from market JSON documents."""
    return MK.market_map(fx.market_docs(spark, sf_dir))


@query("s17_outcome_quotes", """
with m as (select source_game_id as game_id, slug, from_json(outcomes, '["VARCHAR"]') as o from f_markets),
r as (select m.game_id, m.slug, t.token_index as outcome_index, m.o[t.token_index + 1] as outcome_name,
             m.game_id || cast(t.token_index as varchar) as token_id, q.asof_ts, q.bid, q.ask, q.mid,
             q.liquidity_top_total, q.liquidity_depth_2c
      from m join (select 0 as token_index union all select 1) t on true
      join f_quotes2 q on q.game_id = m.game_id and q.token_index = t.token_index)
select game_id, slug, cast(outcome_index as integer) as outcome_index, outcome_name, token_id,
       min(asof_ts) over (partition by game_id, slug) as asof_ts,
       round(bid, 6) as bid, round(ask, 6) as ask, round(mid, 6) as mid,
       round(liquidity_top_total, 6) as liquidity_top_total, round(liquidity_depth_2c, 6) as liquidity_depth_2c
from r""")
def s17_outcome_quotes(spark, sf_dir):
    """Both outcomes of every mapped market, quoted at one shared time."""
    docs = fx.market_docs(spark, sf_dir).where(F.col("source_game_id").isNotNull())
    # every document of a game is mapped with the outcomes of every document of that game
    docs = docs.withColumn("_outcomes", F.collect_list(F.struct(F.get_json_object("market", "$.outcomes").alias("outcomes")))
                           .over(Window.partitionBy("source_game_id")))
    m = (MK.market_map(docs).withColumn("_of", F.explode("_outcomes")).withColumn("outcomes", F.col("_of.outcomes"))
         .withColumnRenamed("source_game_id", "game_id"))
    q = MK.outcome_quotes(m, _book_docs_both(spark, sf_dir))
    return round_doubles(q.select("game_id", "slug", "outcome_index", "outcome_name", "token_id", "asof_ts",
                                  "bid", "ask", "mid", "liquidity_top_total", "liquidity_depth_2c"))


register("f_market_matched", f"""
with g as (select game_id, game_date, 'T' || home_team_id as home_tricode, 'T' || away_team_id as away_tricode
           from f_games where season_type = 'Regular Season'),
names as (select * from (values {_NAMES_SQL}) t(tricode, names)),
gn as (select g.*, coalesce(na.names, [upper(g.away_tricode)]) as an, coalesce(nh.names, [upper(g.home_tricode)]) as hn
       from g left join names na on upper(g.away_tricode) = na.tricode
              left join names nh on upper(g.home_tricode) = nh.tricode),
cand as (select game_id, an, hn,
                unnest(range(6)) as candidate_pos,
                unnest([concat_ws('-', 'nba', lower(away_tricode), lower(home_tricode), cast(game_date as varchar)),
                        concat_ws('-', 'nba', lower(home_tricode), lower(away_tricode), cast(game_date as varchar)),
                        concat_ws('-', 'nba', lower(away_tricode), 'vs', lower(home_tricode), cast(game_date as varchar)),
                        concat_ws('-', 'nba', lower(home_tricode), 'vs', lower(away_tricode), cast(game_date as varchar)),
                        concat_ws('-', 'nba', lower(away_tricode), lower(home_tricode), cast(game_date as varchar), 'moneyline'),
                        concat_ws('-', 'nba', lower(home_tricode), lower(away_tricode), cast(game_date as varchar), 'moneyline')]) as slug
         from gn),
mk as (select slug, regexp_replace(lower(trim(question)), '\\s+', ' ', 'g') as q,
              list_transform(from_json(outcomes, '["VARCHAR"]'), lambda o: regexp_replace(lower(trim(o)), '\\s+', ' ', 'g')) as o
       from f_markets),
j as (select c.*, mk.q, mk.o from cand c join mk using (slug)),
ok as (select * from j where
        (len(o) > 0 and len(list_filter(an, lambda n: list_contains(o, regexp_replace(lower(trim(n)), '\\s+', ' ', 'g')))) > 0
                    and len(list_filter(hn, lambda n: list_contains(o, regexp_replace(lower(trim(n)), '\\s+', ' ', 'g')))) > 0)
        or (len(list_filter(an, lambda n: contains(q, regexp_replace(lower(trim(n)), '\\s+', ' ', 'g')))) > 0
            and len(list_filter(hn, lambda n: contains(q, regexp_replace(lower(trim(n)), '\\s+', ' ', 'g')))) > 0))
select game_id, arg_min(slug, candidate_pos) as slug, cast(min(candidate_pos) as integer) as candidate_pos
from ok group by game_id""", ("f_games", "f_markets"))


@query("j06_resolve_markets", "select game_id, slug, candidate_pos from f_market_matched")
def j06_resolve_markets(spark, sf_dir):
    """J6 + J10 + F10 + E18 + E19: each game's market by candidate slug priority and team-name match."""
    matched, _ = MK.resolve_markets(_schedule_games(spark, sf_dir), _markets(spark, sf_dir),
                                    fx.tricode_names(spark))
    return matched


@query("j06_unresolved_games", """
select game_id, game_date, 'T' || home_team_id as home_tricode, 'T' || away_team_id as away_tricode
from f_games where season_type = 'Regular Season' and game_id not in (select game_id from f_market_matched)""")
def j06_unresolved_games(spark, sf_dir):
    """J6 misses: games for which no candidate market names both teams (left_anti on the matches)."""
    g = _schedule_games(spark, sf_dir)
    _, missed = MK.resolve_markets(g, _markets(spark, sf_dir), fx.tricode_names(spark))
    return missed
