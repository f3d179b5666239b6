"""Leakage-safe team features over the season window.

Common window: PARTITION BY season_start, team_id ORDER BY game_date, game_id, in slices (``operators.sliced``), so
that a team-season with very many rows is spread over tasks. All frames of one call share that partitioning and
ordering, so Spark plans a single Exchange + Sort for them and evaluates every frame in one Window operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions import expressions as E
from rimshot.operators.sliced import slice_window, spread

SEASON_KEYS = ("season_start", "team_id")
GAME_ORDER = ("game_date", "game_id")

# Output -> (input column, frame length; None = season to date)
ROLLING_SPEC = {
    "win_pct_l5": ("is_win", 5),
    "win_pct_l10": ("is_win", 10),
    "avg_point_diff_l10": ("point_diff", 10),
    "avg_pts_l10": ("pts", 10),
    "avg_tov_l10": ("turnovers", 10),
    "avg_reb_l10": ("reb", 10),
    "avg_ast_l10": ("ast", 10),
    "win_pct_s2d": ("is_win", None),
    "avg_point_diff_s2d": ("point_diff", None),
}


def rolling(df: DataFrame, spec: dict = ROLLING_SPEC, pre: bool = True,
            keys=SEASON_KEYS, order=GAME_ORDER, calendar: DataFrame | None = None, slice_rows: int | None = None) -> DataFrame:
    """Windowed means per team-season (``calendar`` and ``slice_rows`` as for ``sliced.spread``).

    ``pre=True`` (the model inputs) ends every frame one row before the current
    game, so a row never sees its own result; ``pre=False`` is the post-game
    variant (frame ends at the current row) used by the leakage proof.
    """
    keys, order = list(keys), list(order)
    longest = max([n for _, n in spec.values() if n is not None], default=0)
    whole = tuple(dict.fromkeys(c for c, n in spec.values() if n is None))
    rows = spread(df, keys, order, halo=longest if pre else max(0, longest - 1), sums=whole, calendar=calendar,
                  slice_rows=slice_rows)
    w = slice_window(keys, order)
    end = -1 if pre else 0
    cols = []
    for out, (col, n) in spec.items():
        if n is None:  # what lies before the slice is added to what the slice has
            own, frame = F.when(~F.col("_halo"), F.col(col)), w.rowsBetween(Window.unboundedPreceding, end)
            count = F.col(f"_cnt_{col}") + F.count(own).over(frame)
            cols.append(F.when(count > 0, (F.col(f"_sum_{col}") + F.coalesce(F.sum(own).over(frame), F.lit(0))) / count).alias(out))
        else:
            cols.append(F.avg(col).over(w.rowsBetween(-n if pre else -(n - 1), end)).alias(out))
    return rows.select(*df.columns, "_halo", *cols).where(~F.col("_halo")).drop("_halo")


def with_game_number(df: DataFrame, keys=SEASON_KEYS, order=GAME_ORDER, calendar: DataFrame | None = None) -> DataFrame:
    """team_game_number = 1, 2, ... within the team-season."""
    rows = spread(df, list(keys), list(order), calendar=calendar)
    number = F.col("_before") + F.row_number().over(slice_window(list(keys), list(order)))
    return rows.select(*df.columns, number.cast("bigint").alias("team_game_number"))


def checkpoint_rows(df: DataFrame, n: int | tuple[int, ...]) -> DataFrame:
    """The pre-game row of game N+1, i.e. the team's state after N games, for each N (one pass for all)."""
    if "team_game_number" not in df.columns:
        df = with_game_number(df)
    wanted = [n] if isinstance(n, int) else list(n)
    return (df.where(F.col("team_game_number").isin([k + 1 for k in wanted]))
            .withColumn("checkpoint", (F.col("team_game_number") - 1).cast("int")))


def training_rows(rolled: DataFrame, labels: DataFrame) -> DataFrame:
    """team_game_training (+ F2): rolling features with the season label; first game of a team-season dropped.

    ``labels`` is one row per team-season; AQE turns this join into a
    broadcast at run time once it has measured that side.
    """
    lab = labels.select("season_start", "team_id", "made_playoffs")
    return (rolled.join(lab, ["season_start", "team_id"], "left")
                  .where(F.col("win_pct_l10").isNotNull() & F.col("avg_point_diff_l10").isNotNull()))


def attach_conference(df: DataFrame, teams: DataFrame) -> DataFrame:
    """Conference and division for each team row. ``teams`` may have a row per (season_start, team_id), the
    team's latest standings snapshot of the season, or one per team."""
    on = [c for c in ("season_start", "team_id") if c in teams.columns]
    return df.join(teams.select(*on, "conference", "division"), on, "left")


def latest_snapshot(standings: DataFrame, run_date: str = "run_date", keys=("season_start", "team_id")) -> DataFrame:
    """Conference and division from each team's latest standings snapshot of a season (ties by the greater)."""
    by = F.struct(F.col(run_date), F.col("conference"), F.col("division"))
    row = F.struct("conference", "division")
    return standings.groupBy(*keys).agg(F.max_by(row, by).alias("_s")).select(*keys, "_s.conference", "_s.division")


def rest_travel(results: DataFrame, teams: DataFrame) -> DataFrame:
    """W14 + W15 per team row: days of rest, back-to-back flag, miles travelled since the previous game.

    The venue of a game is the home team's location; before its first game a
    team is at its own venue. Both lags share the season window.
    """
    loc = teams.select("team_id", "lat", "lon")
    venue_team = F.when(F.col("is_home") == 1, F.col("team_id")).otherwise(F.col("opp_team_id"))
    r = results.withColumn("venue_team_id", venue_team)
    r = r.join(loc.withColumnRenamed("team_id", "venue_team_id"), "venue_team_id", "left")
    home_loc = loc.select(F.col("team_id").alias("_own"), F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon"))
    r = r.join(home_loc, F.col("team_id") == F.col("_own"), "left").drop("_own")
    columns = results.columns
    r = spread(r, list(SEASON_KEYS), list(GAME_ORDER), halo=1, calendar=results)
    w = slice_window(list(SEASON_KEYS), list(GAME_ORDER))
    prev_date = F.lag("game_date").over(w)
    prev_lat = F.coalesce(F.lag("lat").over(w), F.col("own_lat"))
    prev_lon = F.coalesce(F.lag("lon").over(w), F.col("own_lon"))
    rest = F.datediff(F.col("game_date"), prev_date)
    miles = E.haversine_miles(prev_lat, prev_lon, F.col("lat"), F.col("lon"))
    return r.select(
        *columns, "_halo",
        rest.alias("rest_days"),
        F.when(rest <= 1, 1).otherwise(0).alias("is_b2b"),
        miles.alias("travel_miles"),
        F.when(miles > 0, 1).otherwise(0).alias("traveled")).where(~F.col("_halo")).drop("_halo")


def advanced_metrics(base: DataFrame) -> DataFrame:
    """Per team-game efficiency metrics; the opponent's row comes by a self join on (game_id, team).

    poss = fga + 0.44 fta - oreb + tov; off_rtg = 100 pts / poss; def_rtg = the
    opponent's off_rtg; net = off - def; pace = mean of both teams' poss;
    tov_pct = tov / poss; oreb_pct = oreb / (oreb + opp dreb); dreb_pct = dreb / (dreb + opp oreb).
    """
    poss = E.possessions("fga", "fta", "oreb", "turnovers")
    b = base.withColumn("poss", poss).withColumn("off_rtg", E.safe_div(F.lit(100.0) * F.col("pts"), F.col("poss")))
    opp = b.select(F.col("game_id"), F.col("team_id").alias("opp_team_id"),
                   F.col("poss").alias("opp_poss"), F.col("off_rtg").alias("def_rtg"),
                   F.col("oreb").alias("opp_oreb"), F.col("dreb").alias("opp_dreb"))
    j = b.join(opp, ["game_id", "opp_team_id"], "left")
    return j.select(
        *b.columns,
        "def_rtg",
        (F.col("off_rtg") - F.col("def_rtg")).alias("net_rtg"),
        ((F.col("poss") + F.col("opp_poss")) / 2).alias("pace"),
        E.efg_pct("fgm", "fg3m", "fga").alias("efg_pct"),
        E.ts_pct("pts", "fga", "fta").alias("ts_pct"),
        E.safe_div(F.col("turnovers"), F.col("poss")).alias("tov_pct"),
        E.safe_div(F.col("oreb"), F.col("oreb") + F.col("opp_dreb")).alias("oreb_pct"),
        E.safe_div(F.col("dreb"), F.col("dreb") + F.col("opp_oreb")).alias("dreb_pct"),
    )


ADV_METRICS = ("net_rtg", "off_rtg", "def_rtg", "efg_pct", "ts_pct", "tov_pct", "oreb_pct", "dreb_pct", "pace", "poss")


def advanced_rolling_spec(metrics=ADV_METRICS) -> dict:
    """L5 / L10 / season-to-date means of the advanced metrics."""
    spec = {}
    for m in metrics:
        spec[f"{m}_l5"] = (m, 5)
        spec[f"{m}_l10"] = (m, 10)
        spec[f"{m}_s2d"] = (m, None)
    return spec


def matchup(features: DataFrame, feature_cols: list[str], label: str = "is_win") -> DataFrame:
    """One row per game, every feature as home minus away (``<f>_diff``), label = home row's result.

    Conditional aggregation on game_id: one shuffle, no self-join. Games
    lacking either side produce a null difference.
    """
    home = F.col("is_home") == 1
    aggs = [F.max(F.when(home, F.col(label))).alias(f"home_{label}")]
    for f in feature_cols:
        aggs.append((F.max(F.when(home, F.col(f))) - F.max(F.when(~home, F.col(f)))).alias(f"{f}_diff"))
    return features.groupBy("season_start", "game_id", "game_date").agg(*aggs)


CORE_PLAYERS = 8
RECENT, LOOKBACK = 5, 10
TASK_GAMES = 16_384  # team games that a task takes apart: rosters are small in the exchange and ten times as large after it


def core_availability(players: DataFrame, results: DataFrame, core: int = CORE_PLAYERS) -> DataFrame:
    """Injury proxy per team game: of the team's ``core`` players (most minutes over the previous
    10 team games, ties by player_id), how many appearances and minutes they had in the previous 5.

    A team game's players are gathered in one array (its roster), and a frame of ten rows over the season window holds
    the rosters before each game. They are taken apart after that exchange: sums per player, the ranking and the sums
    per game all keep the window's partitioning, so player rows are dealt out once, to their team game. The exchange has
    a partition for each ``TASK_GAMES`` team games, whose number is counted while the plan is built.
    """
    keys, order = list(SEASON_KEYS), list(GAME_ORDER)
    game = [*keys, "game_id"]
    roster = players.groupBy(*game).agg(F.collect_list(F.struct(
        "player_id", F.coalesce(E.minutes_played("minutes"), F.lit(0.0)).alias("m"))).alias("_roster"))
    days = results.select(*keys, "game_id", "game_date")
    rows = spread(days.join(roster, game, "left"), keys, order, halo=LOOKBACK, calendar=days)
    rows = rows.repartition(1 + days.count() // TASK_GAMES, *keys, "_slice")
    w = slice_window(keys, order)
    at = F.row_number().over(w)
    own = F.col("_before") + F.sum((~F.col("_halo")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.collect_list(F.struct(F.col("_at"), F.coalesce("_roster", F.array().cast(roster.schema["_roster"].dataType)).alias("_r")))
    part = [*keys, "_slice", "game_date", "game_id"]
    seen = (rows.withColumns({"_at": at, "team_game_number": own.cast("bigint")})
            .withColumn("_last", before.over(w.rowsBetween(-LOOKBACK, -1))).where(~F.col("_halo")))
    each = F.flatten(F.transform("_last", lambda g: F.transform(g["_r"], lambda p: F.struct(
        p["player_id"].alias("player_id"), p["m"].alias("m"), (F.col("_at") - g["_at"] <= RECENT).alias("recent")))))
    long = seen.select(*part, "team_game_number", F.explode_outer(each).alias("_p")).select(*part, "team_game_number", "_p.*")
    per = long.groupBy(*part, "team_game_number", "player_id").agg(
        F.sum("m").alias("min10"), F.sum(F.when(F.col("recent"), F.col("m")).otherwise(0.0)).alias("min5"),
        F.sum(F.when(F.col("recent") & (F.col("m") > 0), 1).otherwise(0)).alias("games5"))
    best = Window.partitionBy(*part, "team_game_number").orderBy(F.desc("min10"), F.asc("player_id"))
    top = per.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= core)
    return top.groupBy(*part, "team_game_number").agg(F.sum("games5").cast("bigint").alias("core_games5"), F.sum("min5").alias("core_min5")).select(
        *game, "team_game_number", "core_games5", "core_min5")


def form_timeline(features: DataFrame, games: int = 30) -> DataFrame:
    """The first ``games`` games of every team-season with its running form (a timeline per team).
    Two-stage top-k, so a long team-season is cut per input partition before it is ranked."""
    from rimshot.operators.ordering import top_k_per_group
    t = top_k_per_group(features, list(SEASON_KEYS), list(GAME_ORDER), games, "team_game_number")
    return t.withColumn("team_game_number", F.col("team_game_number").cast("bigint"))
