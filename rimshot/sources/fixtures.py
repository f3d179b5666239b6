"""Basketball tables derived from the landed star-schema tables.

One order is one game, one line item is one player box-score row. The rules
are fixed values (they define the test data shape) and are written out once
here; the SQL oracle in ``rimshot.plans.oracle_sql`` derives the same tables
independently with DuckDB. Everything is a lazy DataFrame: a derived table
costs nothing until a query reads it, and Catalyst prunes unused columns
back into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions.expressions import season_start_from_date
from rimshot.sources.tables import read_table

# Fixed values of the fixture rules.
N_TEAMS = 30
REGULAR = "Regular Season"
PLAY_IN = "PlayIn"
PLAYOFFS = "Playoffs"


def _i(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_games: one row per game (game_id, season_start, game_date, teams, points, season_type)."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    d = F.to_date("o_orderdate")
    home = F.col("o_custkey") % N_TEAMS
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        season_start_from_date(d).alias("season_start"),
        d.alias("game_date"),
        home.alias("home_team_id"),
        ((home + 1 + F.col("o_orderkey") % 29) % N_TEAMS).alias("away_team_id"),
        (F.lit(85) + F.floor("o_totalprice") % 47).alias("home_points"),
        (F.lit(85) + F.floor(F.col("o_totalprice") / 7) % 43).alias("away_points"),
        F.when(F.col("o_orderpriority") == "5-LOW", PLAYOFFS)
         .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", PLAY_IN)
         .otherwise(REGULAR).alias("season_type"),
    )


def game_log(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """f_game_log: the raw league game log, two rows per game (home 'vs.', away '@')."""
    g = g if g is not None else games(spark, sf_dir)

    def side(team, opp, tp, op, marker):
        return F.struct(
            F.col(team).alias("team_id"), F.col(tp).alias("pts"),
            F.concat(F.lit("T"), F.col(team).cast("string"), F.lit(marker), F.col(opp).cast("string")).alias("matchup"),
            F.when(F.col(tp) > F.col(op), "W").otherwise("L").alias("wl"))

    return g.select(
        "game_id", "season_start", "game_date", "season_type",
        F.inline(F.array(side("home_team_id", "away_team_id", "home_points", "away_points", " vs. T"),
                         side("away_team_id", "home_team_id", "away_points", "home_points", " @ T"))))


def player_raw(spark: SparkSession, sf_dir: str, g: DataFrame | None = None) -> DataFrame:
    """f_player_raw: one row per line item; (game_id, player_id) repeats on purpose."""
    g = g if g is not None else games(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
    q = F.col("l_quantity").cast("bigint")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    j = li.join(g, li.l_orderkey == g.game_id)
    return j.select(
        F.col("l_orderkey").alias("game_id"), "season_start", "season_type", "game_date",
        F.when(F.col("l_linenumber") % 2 == 1, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
        (F.col("l_linenumber") * 100 + pk % 40).alias("player_id"),
        F.concat((q % 48).cast("string"), F.lit(":"), F.lpad((sk % 60).cast("string"), 2, "0")).alias("minutes"),
        (q % 15).alias("fgm"),
        (q % 15 + pk % 11).alias("fga"),
        (sk % 5).alias("fg3m"),
        (sk % 5 + pk % 6).alias("fg3a"),
        (pk % 7).alias("ftm"),
        (pk % 7 + sk % 4).alias("fta"),
        (sk % 4).alias("oreb"),
        (pk % 9).alias("dreb"),
        (pk % 8).alias("ast"),
        (sk % 6).alias("turnovers"),
        (2 * (q % 15) + sk % 5 + pk % 7).alias("pts"),
    )


COUNT_STATS = ("fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "ast", "turnovers", "pts")


def team_box(spark: SparkSession, sf_dir: str, players: DataFrame | None = None) -> DataFrame:
    """f_team_box: team totals per (game, team); partial aggregation runs map-side."""
    p = players if players is not None else player_raw(spark, sf_dir)
    return (p.groupBy("game_id", "team_id", "season_start", "season_type", "game_date")
             .agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNT_STATS]))


def team_stats(spark: SparkSession, sf_dir: str, box: DataFrame | None = None) -> DataFrame:
    """team_game_stats: the box totals plus rebounds and shooting percentages (null when no attempt)."""
    b = box if box is not None else team_box(spark, sf_dir)

    def pct(m, a):
        return F.when(F.col(a) > 0, F.col(m) / F.col(a))

    return b.select("*", (F.col("oreb") + F.col("dreb")).alias("reb"),
                    pct("fgm", "fga").alias("fg_pct"), pct("fg3m", "fg3a").alias("fg3_pct"),
                    pct("ftm", "fta").alias("ft_pct"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_teams: team dimension (tricode, conference, division, venue coordinates).

    Derived from the distinct team ids of both sides of every game (one scan), at most N_TEAMS rows.
    """
    ids = games(spark, sf_dir).select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    t = F.col("team_id")
    return ids.select(
        "team_id",
        F.concat(F.lit("T"), t.cast("string")).alias("tricode"),
        F.when(t % 2 == 0, "East").otherwise("West").alias("conference"),
        (t % 6).alias("division"),
        (F.lit(25.0) + F.lit(0.8) * t).alias("lat"),
        (F.lit(-120.0) + F.lit(1.6) * t).alias("lon"),
    )


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_book_levels: one order-book level per line item (open lines bid, the rest ask)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_linestatus", "l_quantity"])
    is_bid = F.col("l_linestatus") == "O"
    return li.select(
        F.col("l_orderkey").alias("game_id"),
        F.when(is_bid, "bid").otherwise("ask").alias("side"),
        F.when(is_bid, F.lit(0.45) + F.lit(0.005) * F.col("l_linenumber"))
         .otherwise(F.lit(0.49) + F.lit(0.005) * F.col("l_linenumber")).alias("price"),
        F.col("l_quantity").alias("size"))


def games_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_games_dirty: games with planted defects (null points, null/unknown team, repeated key)."""
    g = games(spark, sf_dir)
    gid = F.col("game_id")
    bad = g.select(
        "game_id", "season_start", "game_date",
        F.when(gid % 101 == 0, F.col("home_team_id") + 1000).otherwise(F.col("home_team_id")).alias("home_team_id"),
        F.when(gid % 89 == 0, F.lit(None).cast("bigint")).otherwise(F.col("away_team_id")).alias("away_team_id"),
        F.when(gid % 97 == 0, F.lit(None).cast("bigint")).otherwise(F.col("home_points")).alias("home_points"),
        "away_points", "season_type")
    repeated = g.where(gid % 113 == 0).select(*bad.columns)
    return bad.unionByName(repeated)


def stats_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_stats_dirty: player rows with planted defects (pct > 1, negative points, orphan game, null team)."""
    p = player_raw(spark, sf_dir)
    pid = F.col("player_id")
    return p.select(
        F.when(pid % 31 == 0, F.col("game_id") + 100000000).otherwise(F.col("game_id")).alias("game_id"),
        F.when((F.col("fga") == 0) & (pid % 2 == 0), F.lit(None).cast("bigint")).otherwise(F.col("team_id")).alias("team_id"),
        "player_id", "season_start",
        F.when(pid % 23 == 0, (F.col("fgm") + F.col("fga") + 1) / (F.col("fga") + 1))
         .when(F.col("fga") == 0, F.lit(None).cast("double"))
         .otherwise(F.col("fgm") / F.col("fga")).alias("fg_pct"),
        F.when(pid % 29 == 0, -F.col("pts")).otherwise(F.col("pts")).alias("pts"))


def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_standings: regular-season record per team-season with strict and dense conference seeds.

    Team rows come from one scan of ``games`` exploded to both sides, so no
    second join back to games is needed for the point difference.
    """
    from rimshot.operators.results import team_game_results

    r = team_game_results(games(spark, sf_dir))
    t = teams(spark, sf_dir).select("team_id", "conference", "division")
    s = (r.join(t, "team_id")
          .groupBy("season_start", "team_id", "conference", "division")
          .agg(F.sum("is_win").cast("bigint").alias("wins"),
               F.sum(1 - F.col("is_win")).cast("bigint").alias("losses"),
               F.sum(F.col("team_points") - F.col("opp_points")).cast("bigint").alias("point_diff")))
    conf = Window.partitionBy("season_start", "conference")
    return s.select(
        "*",
        F.row_number().over(conf.orderBy(F.desc("wins"), F.desc("point_diff"), "team_id")).alias("playoff_rank"),
        F.dense_rank().over(conf.orderBy(F.desc("wins"))).alias("dense_seed"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_schedule: regular-season schedule with statuses and missing ids."""
    g = games(spark, sf_dir).where(F.col("season_type") == REGULAR)
    gid = F.col("game_id")
    return g.select(
        "season_start",
        F.when(gid % 211 == 0, F.lit(None).cast("bigint")).otherwise(gid).alias("game_id"),
        "game_date", "home_team_id",
        F.when(gid % 307 == 0, F.lit(None).cast("bigint")).otherwise(F.col("away_team_id")).alias("away_team_id"),
        F.when(gid % 10 == 0, "Scheduled").when(gid % 50 == 1, "PPD").otherwise("Final").alias("game_status_text"))


def book_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book JSON documents, one per game (token 0): {timestamp (ms text), bids[], asks[]}.

    Levels are sorted by price ascending, so the best bid is the last bid and
    the best ask the first ask. A game may lack one side.
    """
    lv = book_levels(spark, sf_dir)
    lvl = F.struct("price", "size")
    per = lv.groupBy("game_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "bid", lvl))).alias("bids"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "ask", lvl))).alias("asks"))
    g = games(spark, sf_dir).select("game_id", "game_date")
    ms = F.unix_date("game_date").cast("bigint") * 86400000 + F.col("game_id") % 86400000
    return per.join(g, "game_id").select(
        "game_id", F.to_json(F.struct(ms.cast("string").alias("timestamp"), "bids", "asks")).alias("book"))


def market_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-market JSON documents, one per regular-season game, keyed by slug.

    Slug shapes cycle over five forms (four are among the resolver's
    candidates, one is not); some markets name the teams only in the
    question, some name other teams, and some have an unparseable start date.
    """
    g = games(spark, sf_dir).where(F.col("season_type") == REGULAR)
    gid = F.col("game_id")
    a = F.concat(F.lit("t"), F.col("away_team_id").cast("string"))
    h = F.concat(F.lit("t"), F.col("home_team_id").cast("string"))
    d = F.col("game_date").cast("string")
    shape = gid % 5
    slug = (F.when(shape == 0, F.concat_ws("-", F.lit("nba"), a, h, d))
             .when(shape == 1, F.concat_ws("-", F.lit("nba"), h, F.lit("vs"), a, d))
             .when(shape == 2, F.concat_ws("-", F.lit("nba"), a, h, d, F.lit("moneyline")))
             .when(shape == 3, F.concat_ws("-", F.lit("nba"), a, F.lit("at"), h, d))
             .otherwise(F.concat_ws("-", F.lit("nba"), h, a, d)))
    away_code = F.concat(F.lit("T"), F.col("away_team_id").cast("string"))
    home_code = F.concat(F.lit("T"), F.col("home_team_id").cast("string"))
    wrong = gid % 7 == 5
    outcomes = (F.when(wrong, F.lit('["T98", "T99"]'))
                 .when(shape == 4, F.lit('["Yes", "No"]'))
                 .otherwise(F.concat(F.lit('["'), away_code, F.lit('", "'), home_code, F.lit('"]'))))
    question = F.when(wrong, F.lit("Will T98 beat T99?")).otherwise(
        F.concat(F.lit("\t\n Will "), away_code, F.lit("  beat "), home_code, F.lit("?")))
    iso = F.concat(d, F.lit("T23:30:00Z"))
    start = F.when(gid % 11 == 0, F.lit("TBD")).otherwise(iso)
    teams_arr = F.array(F.struct(away_code.alias("abbreviation"), F.lit("away").alias("hostStatus")),
                        F.struct(home_code.alias("abbreviation"), F.lit("home").alias("hostStatus")))
    doc = F.struct(
        F.concat(F.lit("m"), gid.cast("string")).alias("id"),
        F.concat(F.lit("c"), gid.cast("string")).alias("conditionId"),
        question.alias("question"), outcomes.alias("outcomes"),
        F.concat(F.lit('["'), gid.cast("string"), F.lit('0", "'), gid.cast("string"), F.lit('1"]')).alias("clobTokenIds"),
        F.array(F.struct(F.concat(F.lit("e"), gid.cast("string")).alias("id"), teams_arr.alias("teams"))).alias("events"),
        start.alias("startDateIso"), iso.alias("endDateIso"))
    return g.select(gid.alias("source_game_id"), slug.alias("slug"), F.to_json(doc).alias("market"))


# Tricode -> team names (aliases BRK, GS, NO, NY; three codes have two names).
TRICODE_NAMES = {
    "ATL": ["Hawks"], "BOS": ["Celtics"], "BKN": ["Nets"], "BRK": ["Nets"], "CHA": ["Hornets"],
    "CHI": ["Bulls"], "CLE": ["Cavaliers"], "DAL": ["Mavericks"], "DEN": ["Nuggets"], "DET": ["Pistons"],
    "GSW": ["Warriors"], "GS": ["Warriors"], "HOU": ["Rockets"], "IND": ["Pacers"], "LAC": ["Clippers"],
    "LAL": ["Lakers"], "MEM": ["Grizzlies"], "MIA": ["Heat"], "MIL": ["Bucks"],
    "MIN": ["Timberwolves", "Wolves"], "NOP": ["Pelicans"], "NO": ["Pelicans"], "NYK": ["Knicks"],
    "NY": ["Knicks"], "OKC": ["Thunder"], "ORL": ["Magic"], "PHI": ["76ers", "Sixers"], "PHX": ["Suns"],
    "POR": ["Trail Blazers", "Blazers"], "SAC": ["Kings"], "SAS": ["Spurs"], "TOR": ["Raptors"],
    "UTA": ["Jazz"], "WAS": ["Wizards"],
}


def tricode_names(spark: SparkSession) -> DataFrame:
    """J10 dimension: (tricode, names array). A fixed 34-row table; broadcast wherever it is joined."""
    rows = [(k, v) for k, v in TRICODE_NAMES.items()]
    return spark.createDataFrame(rows, "tricode string, names array<string>")


def book_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book snapshots derived from the event stream: one per event (snapshot_id = event_id,
    game_id = user_id, time = ts). One bid level and, except for error events, one ask level."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("bigint")
    bid = F.lit(0.3) + F.lit(0.001) * k
    ask = bid + F.lit(0.02)
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    lvl = lambda p: F.array(F.struct(p.cast("string").alias("price"), F.col("value").cast("string").alias("size")))
    asks = F.when(F.col("event_type") == "error", F.array().cast("array<struct<price:string,size:string>>")) \
            .otherwise(lvl(ask))
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("game_id"), "ts",
                    F.to_json(F.struct(ms.cast("string").alias("timestamp"), lvl(bid).alias("bids"),
                                       asks.alias("asks"))).alias("book"))
