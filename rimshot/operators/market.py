"""Market odds: order-book quotes (S6, E12-E16), market map (S7, E11, E17), both outcomes (S17),
and game -> market resolution (J6, J10, F10, E18, E19).

JSON payloads are parsed with explicit schemas (``from_json``), levels are
arrays handled by higher-order functions, and resolution is an equi join on
exploded candidate slugs, so nothing loops per game on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions import expressions as E

# Prices and sizes arrive as text in the feed; parse them as strings and cast safely.
BOOK_SCHEMA = ("struct<timestamp:string, bids:array<struct<price:string,size:string>>, "
               "asks:array<struct<price:string,size:string>>>")
MARKET_SCHEMA = ("struct<id:string, conditionId:string, question:string, outcomes:string, clobTokenIds:string, "
                 "events:array<struct<id:string, teams:array<struct<abbreviation:string, abbr:string, "
                 "hostStatus:string>>>>, startDateIso:string, endDateIso:string>")
DEPTH_CENTS = 0.02


def _levels(arr):
    return F.transform(F.coalesce(arr, F.array()), lambda l: F.struct(
        l["price"].try_cast("double").alias("price"), l["size"].try_cast("double").alias("size")))


def book_quotes(df: DataFrame, book_col: str = "book") -> DataFrame:
    """One quote per book document: asof_ts, bid (last bid), ask (first ask), mid, top-of-book
    liquidity and notional depth within 2 cents of mid. Unparseable numbers become null."""
    b = F.from_json(F.col(book_col), BOOK_SCHEMA)
    parsed = df.withColumn("_b", b).withColumn("_bids", _levels(F.col("_b.bids"))).withColumn(
        "_asks", _levels(F.col("_b.asks")))
    # columns of their own, so that no level works them out again
    parsed = parsed.withColumns({"_bid": E.best_bid(F.col("_bids")), "_ask": E.best_ask(F.col("_asks"))})
    parsed = parsed.withColumn("_mid", E.mid_price(F.col("_bid"), F.col("_ask")))
    keep = [c for c in df.columns if c != book_col]
    return parsed.select(
        *keep, E.epoch_ms_to_ts(F.col("_b.timestamp")).alias("asof_ts"),
        F.col("_bid").alias("bid"), F.col("_ask").alias("ask"), F.col("_mid").alias("mid"),
        E.top_liquidity(F.col("_bids"), F.col("_asks")).alias("liquidity_top_total"),
        E.depth_within(F.col("_bids"), F.col("_asks"), F.col("_mid"), DEPTH_CENTS).alias("liquidity_depth_2c"))


def market_map(df: DataFrame, market_col: str = "market") -> DataFrame:
    """Market document -> game-map row: first event id, token ids 0/1, first parseable date of
    start/end (its own date part, as written), home/away abbreviation by hostStatus."""
    m = F.from_json(F.col(market_col), MARKET_SCHEMA)
    x = df.withColumn("_m", m)
    tokens = E.json_string_list(F.col("_m.clobTokenIds"))
    ev = F.get(F.col("_m.events"), 0)
    teams = F.coalesce(ev["teams"], F.array())

    def abbr(status):
        hit = F.filter(teams, lambda t: t["hostStatus"] == status)
        last = F.try_element_at(hit, F.lit(-1))
        return F.coalesce(last["abbreviation"], last["abbr"])

    keep = [c for c in df.columns if c != market_col]
    return x.select(
        *keep, F.col("_m.id").alias("gamma_market_id"), F.col("_m.conditionId").alias("clob_market_id"),
        ev["id"].alias("gamma_event_id"), F.get(tokens, 0).alias("token_yes_id"), F.get(tokens, 1).alias("token_no_id"),
        abbr("home").alias("home_team_abbr"), abbr("away").alias("away_team_abbr"),
        E.first_valid_date("_m.startDateIso", "_m.endDateIso").alias("game_date"))


def outcome_quotes(markets: DataFrame, books: DataFrame) -> DataFrame:
    """Both outcomes of a market as two rows; both share asof_ts = the earlier book time.

    ``markets``: game_id, slug, outcomes (JSON list), token ids; ``books``:
    token_id, book (JSON). One window per market (two rows) aligns the time.
    """
    m = markets.select("game_id", "slug", F.posexplode(F.array("token_yes_id", "token_no_id")).alias("outcome_index", "token_id"),
                       E.json_string_list(F.col("outcomes")).alias("_outcomes"))
    m = m.withColumn("outcome_name", F.get(F.col("_outcomes"), F.col("outcome_index"))).drop("_outcomes")
    q = book_quotes(m.join(books, "token_id"))
    return q.withColumn("asof_ts", F.min("asof_ts").over(Window.partitionBy("game_id", "slug")))


def candidate_slugs(away, home, game_date):
    """The six slug templates in priority order."""
    a, h, d = F.lower(away), F.lower(home), game_date.cast("string")
    return F.array(
        F.concat_ws("-", F.lit("nba"), a, h, d), F.concat_ws("-", F.lit("nba"), h, a, d),
        F.concat_ws("-", F.lit("nba"), a, F.lit("vs"), h, d), F.concat_ws("-", F.lit("nba"), h, F.lit("vs"), a, d),
        F.concat_ws("-", F.lit("nba"), a, h, d, F.lit("moneyline")),
        F.concat_ws("-", F.lit("nba"), h, a, d, F.lit("moneyline")))


def resolve_markets(games: DataFrame, markets: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J6 + J10 + F10: per game, the first candidate slug whose market names both teams.

    ``games``: game_id, game_date, home_tricode, away_tricode. ``markets``:
    slug, question, outcomes. ``names``: tricode -> names (broadcast; a code
    missing from it stands for itself). A market matches when every team has a
    name among the outcomes, else when the question contains a name of each.
    Returns (matched: game_id, slug, candidate_pos; missed: unmatched games).
    """
    nm = F.broadcast(names.select(F.upper("tricode").alias("_code"), "names"))
    g = (games.join(nm.withColumnRenamed("names", "away_names"), F.upper(F.col("away_tricode")) == F.col("_code"), "left")
              .drop("_code")
              .join(nm.withColumnRenamed("names", "home_names"), F.upper(F.col("home_tricode")) == F.col("_code"), "left")
              .drop("_code"))
    g = g.select("*",
                 F.coalesce("away_names", F.array(F.upper("away_tricode"))).alias("_an"),
                 F.coalesce("home_names", F.array(F.upper("home_tricode"))).alias("_hn"))
    cand = g.select("game_id", "_an", "_hn",
                    F.posexplode(candidate_slugs(F.col("away_tricode"), F.col("home_tricode"), F.col("game_date")))
                     .alias("candidate_pos", "slug"))
    mk = markets.select("slug", E.norm_text(F.col("question")).alias("_q"),
                        F.transform(E.json_string_list(F.col("outcomes")), lambda o: E.norm_text(o)).alias("_o"))
    j = cand.join(mk, "slug")

    def in_outcomes(names_col):
        return F.exists(names_col, lambda n: F.array_contains(F.col("_o"), E.norm_text(n)))

    def in_question(names_col):
        return F.exists(names_col, lambda n: F.col("_q").contains(E.norm_text(n)))

    by_outcomes = (F.size("_o") > 0) & in_outcomes(F.col("_an")) & in_outcomes(F.col("_hn"))
    by_question = in_question(F.col("_an")) & in_question(F.col("_hn"))
    ok = j.where(by_outcomes | by_question)
    matched = ok.groupBy("game_id").agg(F.min_by("slug", F.col("candidate_pos")).alias("slug"),
                                        F.min("candidate_pos").alias("candidate_pos"))
    missed = games.join(matched.select("game_id"), "game_id", "left_anti")
    return matched, missed
