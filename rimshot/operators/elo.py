"""Elo ratings per season.

Elo is a true recurrence: a game's pre-game ratings depend on the earlier games of its two teams. So two games only
have to wait for each other if a chain of games joins their teams:

- Teams that no chain of games joins never touch each other's ratings. Each connected component of teams of a season
  (``components.connected``) is a group of its own, so leagues that share a season run in parallel without being told.
- Within a group a game's level is the length of the longest chain of earlier games of its two teams. The games of one
  level have no team in common and are rated in one vector step.

Pairing the team rows of a game, dropping malformed games, finding the components and going back to team rows are
DataFrame operations. The levels run in ``applyInPandas`` over one compact row a game; the rows arrive sorted by
date as an iterator of Arrow batches, so memory is one batch plus one rating a team.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimshot.functions.expressions import ELO_HOME_ADV, ELO_K, ELO_SCALE, ELO_START
from rimshot.operators.components import connected, with_label
from rimshot.session import checkpoint_dir, stored

RATING_SCHEMA = ("game_id long, game_date date, home_id long, away_id long, "
                 "res_home int, res_away int, elo_home_pre double, elo_home_post double, "
                 "elo_away_pre double, elo_away_post double")


def pair_games(results: DataFrame, group_keys=("season_start",)) -> DataFrame:
    """J8 for Elo: one row per game with home/away ids and results.

    Games without exactly two team rows, or with a missing result, are
    dropped. The home side is the row marked home (lowest team_id if both or
    neither are marked).
    """
    row = F.struct("team_id", "is_home", "is_win")
    g = results.groupBy(*group_keys, "game_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("game_date").alias("game_date"),
        F.min_by(row, F.col("team_id")).alias("_r1"), F.max_by(row, F.col("team_id")).alias("_r2"))
    r1_home = F.col("_r1.is_home") == 1
    r2_home = ~r1_home & (F.col("_r2.is_home") == 1)
    home = F.when(r2_home, F.col("_r2")).otherwise(F.col("_r1"))
    away = F.when(r2_home, F.col("_r1")).otherwise(F.col("_r2"))
    return (g.where((F.col("_n") == 2) & F.col("_r1.is_win").isNotNull() & F.col("_r2.is_win").isNotNull())
             .select(*group_keys, "game_id", "game_date",
                     home["team_id"].alias("home_id"), away["team_id"].alias("away_id"),
                     home["is_win"].cast("int").alias("res_home"), away["is_win"].cast("int").alias("res_away")))


def _in_levels(home: np.ndarray, away: np.ndarray, teams: int) -> Iterator[np.ndarray]:
    """The games, in order of play, as levels: arrays of games whose teams have no earlier game left.

    A game is due when it is the next one of both its teams, so after each level only the next games of the teams that
    have just played are looked at."""
    n = len(home)
    team, game = np.concatenate([home, away]), np.tile(np.arange(n), 2)
    order = np.lexsort((game, team))
    queue = np.append(game[order], n)
    ends = np.cumsum(np.bincount(team, minlength=teams))
    at = ends - np.bincount(team, minlength=teams)

    def following(who: np.ndarray) -> np.ndarray:
        return np.where(at[who] < ends[who], queue[at[who]], n)

    touched = np.unique(team)
    while True:
        due = np.unique(following(touched))
        due = due[due < n]
        due = due[(following(home[due]) == due) & (following(away[due]) == due)]
        if not len(due):
            return
        yield due
        played = np.concatenate([home[due], away[due]])
        np.add.at(at, played, 1)
        touched = np.unique(played)


def _by_levels(k: float, start: float, home_adv: float, out: list[str]):
    """The recurrence over an ordered stream of batches; ratings go from one batch to the next."""
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rating = np.zeros(0, np.int64), np.zeros(0)
        last = None
        for pdf in batches:
            if pdf.empty:
                continue
            when, game = pd.to_datetime(pdf["game_date"]).to_numpy(), pdf["game_id"].to_numpy()
            back = (when[1:] < when[:-1]) | ((when[1:] == when[:-1]) & (game[1:] < game[:-1]))
            if back.any() or (last is not None and (when[0], game[0]) < last):
                raise RuntimeError("Elo input is not ordered by (game_date, game_id) within the season")
            last = (when[-1], game[-1])
            home, away = pdf["home_id"].to_numpy(), pdf["away_id"].to_numpy()
            known, old = ids, rating
            ids = np.union1d(known, np.concatenate([home, away]))
            rating = np.full(len(ids), start, dtype="float64")
            rating[np.searchsorted(ids, known)] = old
            h, a = np.searchsorted(ids, home), np.searchsorted(ids, away)
            rh, ra = pdf["res_home"].to_numpy(dtype="float64"), pdf["res_away"].to_numpy(dtype="float64")
            hpre, hpost, apre, apost = (np.empty(len(pdf)) for _ in range(4))
            for due in _in_levels(h, a, len(ids)):
                eh, ea = rating[h[due]], rating[a[due]]
                expected = 1.0 / (1.0 + 10.0 ** (-((eh + home_adv) - ea) / ELO_SCALE))
                hpre[due], apre[due] = eh, ea
                hpost[due], apost[due] = eh + k * (rh[due] - expected), ea + k * (ra[due] - (1.0 - expected))
                rating[h[due]], rating[a[due]] = hpost[due], apost[due]
            yield pdf.assign(elo_home_pre=hpre, elo_home_post=hpost, elo_away_pre=apre, elo_away_post=apost)[out]
    return run


def elo(results: DataFrame, k: float = ELO_K, start: float = ELO_START, home_adv: float = ELO_HOME_ADV,
        group_keys=("season_start",)) -> DataFrame:
    """team_elo_history rows (pre/post rating per team per game), reset to ``start`` each season."""
    checkpoint_dir(results.sparkSession)
    keys, label = list(group_keys), "_component"
    games = stored(pair_games(results, keys))
    teams = connected(games.select(*keys, "home_id", "away_id"), keys, "home_id", "away_id", out=label)
    games = with_label(games, teams, keys, "home_id", "home_id", label, "left")
    # Dealt by component and sorted inside each partition: this already satisfies the grouped operator's distribution
    # and ordering, so Spark adds no re-sort and the games stream to the recurrence in date order, batch by batch.
    ordered = games.repartition(*keys, label).sortWithinPartitions(*keys, label, "game_date", "game_id")
    kinds = dict(games.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in keys], RATING_SCHEMA])
    out = [*keys, *[c.split()[0] for c in RATING_SCHEMA.split(", ")]]
    rated = ordered.groupBy(*keys, label).applyInPandas(_by_levels(k, start, home_adv, out), schema)

    def side(team, opp, is_home, pre, post, res):
        return F.struct(F.col(team).alias("team_id"), F.col(opp).alias("opp_team_id"),
                        F.lit(is_home).alias("is_home"), F.col(pre).alias("elo_pre"),
                        F.col(post).alias("elo_post"), F.col(res).alias("result"))

    return rated.select(
        *keys, "game_id", "game_date",
        F.inline(F.array(side("home_id", "away_id", 1, "elo_home_pre", "elo_home_post", "res_home"),
                         side("away_id", "home_id", 0, "elo_away_pre", "elo_away_post", "res_away"))),
        F.lit(float(k)).alias("k_factor"))
