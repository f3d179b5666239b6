"""Season projection from a checkpoint.

The reference draws an (N draws x remaining games) matrix in one process.
Here every draw of every remaining game is worked out: draws are generated per
block of games as an array inside the tasks, the uniform number is an integer
hash of (seed, draw, game), so the result is reproducible, independent of
partitioning and recomputable after an executor loss. Wins are summed per
(draw, team), in each task and then over all, seeds ranked per (draw, conference) with a window, and the
probabilities averaged per team. The work grows with draws x games and
spreads over all (season, checkpoint, draw) keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimshot.functions import expressions as E
from rimshot.operators.features import with_game_number

# Fixed values.
DEFAULT_TEMP = 2.0
DEFAULT_ALPHA = 0.0
DEFAULT_BETA = E.LN10_OVER_400
DEFAULT_SEED = 42
TOP6, TOP10 = 6, 10
TWO_POW_32 = 4294967296.0


def checkpoint_cutoffs(results: DataFrame, checkpoints=(20, 40, 60)) -> DataFrame:
    """Per (season, checkpoint): the latest date on which any team plays its N-th game.

    One row per season and checkpoint, so the table is bounded by
    seasons x checkpoints and is broadcast into the joins below.
    """
    n = with_game_number(results)
    return (n.where(F.col("team_game_number").isin(list(checkpoints)))
             .groupBy("season_start", F.col("team_game_number").alias("checkpoint"))
             .agg(F.max("game_date").alias("cutoff")))


def team_state(results: DataFrame, elo_hist: DataFrame, teams: DataFrame, cutoffs: DataFrame,
               elo_start: float = E.ELO_START) -> DataFrame:
    """Wins and Elo of every team of the season as of the checkpoint cut-off date."""
    cut = cutoffs
    members = results.select("season_start", "team_id").distinct().join(cut, "season_start")
    played = (results.join(cut, "season_start").where(F.col("game_date") <= F.col("cutoff"))
                     .groupBy("season_start", "checkpoint", "team_id")
                     .agg(F.sum("is_win").cast("bigint").alias("wins_cp")))
    rated = (elo_hist.join(cut, "season_start").where(F.col("game_date") <= F.col("cutoff"))
                     .groupBy("season_start", "checkpoint", "team_id")
                     .agg(F.max_by("elo_post", F.struct("game_date", "game_id")).alias("elo_cp")))
    s = (members.join(played, ["season_start", "checkpoint", "team_id"], "left")
                .join(rated, ["season_start", "checkpoint", "team_id"], "left")
                .join(teams.select("team_id", "conference"), "team_id", "left"))
    return s.select("season_start", "checkpoint", "team_id", "conference", "cutoff",
                    F.coalesce("wins_cp", F.lit(0).cast("bigint")).alias("wins_cp"),
                    F.coalesce("elo_cp", F.lit(elo_start)).alias("elo_cp"))


def remaining_games(games: DataFrame, cutoffs: DataFrame, season_type: str = "Regular Season") -> DataFrame:
    """Regular-season games after the cut-off (each counted once per checkpoint)."""
    g = games.where(F.col("season_type") == season_type)
    return (g.join(cutoffs, "season_start").where(F.col("game_date") > F.col("cutoff"))
             .select("season_start", "checkpoint", "game_id", "home_team_id", "away_team_id"))


def game_probabilities(remaining: DataFrame, state: DataFrame, alpha: float = DEFAULT_ALPHA,
                       beta: float = DEFAULT_BETA, temp: float = DEFAULT_TEMP) -> DataFrame:
    """J7 + M1: home win probability from the Elo gap, then temperature-scaled (clip 1e-15)."""
    k = ["season_start", "checkpoint"]
    hs = state.select(*k, F.col("team_id").alias("home_team_id"), F.col("elo_cp").alias("elo_home"))
    as_ = state.select(*k, F.col("team_id").alias("away_team_id"), F.col("elo_cp").alias("elo_away"))
    j = remaining.join(hs, k + ["home_team_id"], "left").join(as_, k + ["away_team_id"], "left")
    p = E.sigmoid(F.lit(alpha) + F.lit(beta) * (F.col("elo_home") - F.col("elo_away")))
    return j.withColumn("p_home_win", E.temperature_scale(p, temp, E.PROJECTION_EPS))


def expected_wins(games: DataFrame, state: DataFrame, cutoffs: DataFrame, **model) -> DataFrame:
    """M5's expected wins, exactly and without draws: wins at the cut-off and the sum of the win probabilities of
    the games that remain, per (season, checkpoint, team). One pass over the games, both sides from each row."""
    p = game_probabilities(remaining_games(games, cutoffs), state, **model)
    side = lambda team, chance: F.struct(F.col(team).alias("team_id"), chance.alias("chance"))
    ahead = (p.select("season_start", "checkpoint", F.inline(F.array(
        side("home_team_id", F.col("p_home_win")), side("away_team_id", 1 - F.col("p_home_win")))))
        .groupBy("season_start", "checkpoint", "team_id").agg(F.sum("chance").alias("_more"), F.count(F.lit(1)).alias("games_left")))
    j = state.join(ahead, ["season_start", "checkpoint", "team_id"], "left")
    return j.select("season_start", "checkpoint", "team_id", "conference", "wins_cp",
                    F.coalesce("games_left", F.lit(0)).alias("games_left"),
                    (F.col("wins_cp") + F.coalesce("_more", F.lit(0.0))).alias("exp_wins"))


# Fixed values of the draw hash: a 32-bit integer mixer (two multiply-xorshift rounds).
MIX_MULT = 0x45D9F3B
TWO_32 = 4294967296


def _mix_steps(df: DataFrame, src: str, out: str) -> DataFrame:
    """out = mix32(src): 32-bit avalanche mix (two multiply-xorshift rounds).

    Each step is its own column, so every reference is a plain attribute
    (nesting the steps would copy the expression tree exponentially). Every
    product stays below 2^59: bigint arithmetic never overflows.
    """
    df = df.withColumn(f"{out}_0", F.col(src) % TWO_32)
    df = df.withColumn(f"{out}_1", (F.shiftright(F.col(f"{out}_0"), 16).bitwiseXOR(F.col(f"{out}_0")) * MIX_MULT) % TWO_32)
    df = df.withColumn(f"{out}_2", (F.shiftright(F.col(f"{out}_1"), 16).bitwiseXOR(F.col(f"{out}_1")) * MIX_MULT) % TWO_32)
    df = df.withColumn(out, F.shiftright(F.col(f"{out}_2"), 16).bitwiseXOR(F.col(f"{out}_2")))
    return df.drop(f"{out}_0", f"{out}_1", f"{out}_2")


def with_uniform_draw(df: DataFrame, seed, draw: str, game_id: str, out: str = "u") -> DataFrame:
    """Add u in [0, 1) = hash(seed, draw, game_id) / 2^32: chained integer mixing, pure arithmetic.

    Reproducible in any engine with 64-bit integers and independent of
    partitioning, so a recomputed task draws the same numbers. Ids wider than
    32 bits are folded in as two halves.
    """
    gid = F.col(game_id).cast("bigint")
    df = df.withColumn("_h_in", seed.cast("bigint"))
    df = _mix_steps(df, "_h_in", "_h")
    df = _mix_steps(df.withColumn("_h_in", F.col("_h") + F.col(draw).cast("bigint")), "_h_in", "_h")
    df = _mix_steps(df.withColumn("_h_in", F.col("_h") + gid % TWO_32), "_h_in", "_h")
    df = _mix_steps(df.withColumn("_h_in", F.col("_h") + F.shiftright(gid, 32)), "_h_in", "_h")
    return df.withColumn(out, F.col("_h").cast("double") / F.lit(TWO_POW_32)).drop("_h_in", "_h")


def _mixed(x: np.ndarray) -> np.ndarray:
    """mix32 of ``_mix_steps`` over numbers of 32 bits, or over longs with Java's signs."""
    if x.dtype == np.uint32:  # products modulo 2^32 need no more bits
        for _ in range(2):
            x = ((x >> np.uint32(16)) ^ x) * np.uint32(MIX_MULT)
        return (x >> np.uint32(16)) ^ x
    x = np.fmod(x, TWO_32)
    for _ in range(2):
        x = np.fmod(((x >> 16) ^ x) * MIX_MULT, TWO_32)
    return (x >> 16) ^ x


def uniform_draws(seed: int, n_draws: int, games: np.ndarray) -> np.ndarray:
    """The numbers of ``with_uniform_draw`` for draws 0..n_draws-1 (columns) of ``games`` (rows) under one seed: the part
    of the hash that all games share is worked out once a draw."""
    of_draw = _mixed(_mixed(np.array([seed], np.int64)) + np.arange(n_draws))
    low, high = np.fmod(games, TWO_32)[:, None], (games >> 32)[:, None]
    if len(games) and min(games.min(), of_draw.min()) >= 0:
        h = _mixed(of_draw.astype(np.uint32) + low.astype(np.uint32))
        h = _mixed(h + high.astype(np.uint32))
    else:
        h = _mixed(_mixed(of_draw + low) + high)
    return h / TWO_POW_32


#: Games whose draws are held at once.
DRAW_GAMES = 2_000


def _drawn_wins(batches: Iterator[pa.RecordBatch], n_draws: int) -> Iterator[pa.RecordBatch]:
    """A task's sums of wins: a row for every (season, checkpoint, team, draw) of its games."""
    wins: dict[tuple, np.ndarray] = {}
    schema = None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field(0), batch.schema.field(1),
                                      pa.field("team_id", batch.schema.field(3).type), ("draw", pa.int32()), ("w", pa.int64())])
        for key, rows in batch.to_pandas().groupby(["season_start", "checkpoint"]):
            for i in range(0, len(rows), DRAW_GAMES):
                some = rows.iloc[i: i + DRAW_GAMES]
                chance = some["p_home_win"].to_numpy(np.float64)[:, None]
                u = uniform_draws(int(some["_seed"].iloc[0]), n_draws, some["game_id"].to_numpy(np.int64))
                home = ((u < chance) | np.isnan(chance)).view(np.int8)
                for side, w in (("home_team_id", home), ("away_team_id", 1 - home)):
                    codes, teams = pd.factorize(some[side])
                    order = np.argsort(codes, kind="stable")
                    begins = np.flatnonzero(np.diff(codes[order], prepend=-2))
                    for code, total in zip(codes[order][begins], np.add.reduceat(w[order], begins, dtype=np.int64)):
                        if code >= 0:
                            at = (*key, teams[code])
                            wins[at] = wins[at] + total if at in wins else total
    for (season, checkpoint, team), total in wins.items():
        yield pa.RecordBatch.from_arrays([
            *[pa.array([x] * n_draws, schema.field(i).type) for i, x in enumerate((season, checkpoint, team))],
            pa.array(np.arange(n_draws), pa.int32()), pa.array(total)], schema=schema)


def project(state: DataFrame, probs: DataFrame, n_draws: int, seed_base: int = DEFAULT_SEED,
            alpha: float = DEFAULT_ALPHA, beta: float = DEFAULT_BETA) -> DataFrame:
    """M2-M5: simulate the rest of the season ``n_draws`` times; per team: p_top6, p_top10,
    p_playoffs (a copy of p_top10, as in the reference), exp_wins, exp_conf_seed."""
    k = ["season_start", "checkpoint"]
    seed = F.lit(seed_base) + F.col("season_start") * 100 + F.col("checkpoint")
    # The draw stage multiplies every game by n_draws. Spread the (small) game table over the
    # configured shuffle width first: AQE would otherwise coalesce it into very few partitions
    # and run the whole n_draws-fold expansion in a handful of tasks.
    width = int(probs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = probs.repartition(width, *k, "game_id").select(
        *k, "game_id", "home_team_id", "away_team_id", "p_home_win", seed.cast("bigint").alias("_seed"))
    kinds = dict(probs.dtypes)
    # a game without an id or a chance has no winner
    part = probs.where(F.col("game_id").isNotNull() & F.col("p_home_win").isNotNull()).mapInArrow(lambda b: _drawn_wins(b, n_draws), f"season_start {kinds['season_start']}, "
                            f"checkpoint {kinds['checkpoint']}, team_id {kinds['home_team_id']}, draw int, w long")
    sim = part.groupBy(*k, "draw", "team_id").agg(F.sum("w").alias("sim_wins"))
    # every team in every draw, including teams with no game left
    base = state.select(*k, "team_id", "conference", "wins_cp", "elo_cp",
                        F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    tot = (base.join(sim, k + ["draw", "team_id"], "left")
               .withColumn("wins", F.col("wins_cp") + F.coalesce(F.col("sim_wins"), F.lit(0))))
    w = Window.partitionBy(*k, "draw", "conference").orderBy(F.desc("wins"), F.desc("elo_cp"), F.asc("team_id"))
    seeded = tot.withColumn("seed", F.row_number().over(w))
    out = seeded.groupBy(*k, "team_id", "conference").agg(
        F.avg(F.when(F.col("seed") <= TOP6, 1.0).otherwise(0.0)).alias("p_top6"),
        F.avg(F.when(F.col("seed") <= TOP10, 1.0).otherwise(0.0)).alias("p_top10"),
        F.avg("wins").alias("exp_wins"), F.avg("seed").alias("exp_conf_seed"))
    return out.select(
        E.season_text(F.col("season_start")).alias("season"), *k, "team_id", "conference",
        "p_top6", "p_top10", F.col("p_top10").alias("p_playoffs"), "exp_wins", "exp_conf_seed",
        F.lit(n_draws).alias("n_sims"), seed.cast("bigint").alias("seed"),
        F.lit(float(alpha)).alias("alpha"), F.lit(float(beta)).alias("beta"))


def season_projection(games: DataFrame, teams: DataFrame, n_draws: int, checkpoints=(20, 40, 60),
                      seed_base: int = DEFAULT_SEED, temp: float = DEFAULT_TEMP,
                      alpha: float = DEFAULT_ALPHA, beta: float = DEFAULT_BETA) -> DataFrame:
    """M1-M6 end to end for every season x checkpoint: results -> Elo -> state at each cut-off ->
    remaining-game probabilities -> draws -> per-team probabilities.

    The team state (one row per team, season and checkpoint) feeds three branches (home and away
    probabilities and the per-draw base rows); it is materialised once with a reliable checkpoint,
    so Elo and the state aggregation run once instead of once per branch.
    """
    from rimshot.operators.elo import elo
    from rimshot.operators.results import team_game_results
    from rimshot.session import checkpoint_dir

    checkpoint_dir(games.sparkSession)
    res = team_game_results(games)
    cut = checkpoint_cutoffs(res, checkpoints)
    state = team_state(res, elo(res), teams, cut).checkpoint(eager=True)
    probs = game_probabilities(remaining_games(games, cut), state, alpha, beta, temp)
    return project(state, probs, n_draws, seed_base, alpha, beta)
