"""Exact selection by histograms (quantiles, the row at a rank) and the sliding roster."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from rimshot.operators import selection as S
from rimshot.operators.features import core_availability
from rimshot.operators.ordering import time_split


def _quantiles(spark, rows, qs, parts=3):
    df = spark.createDataFrame(rows, "g string, v double, _n long").repartition(parts)
    return {r.g: [r[k] for k in qs] for r in S.quantiles(df, ["g"], "v", qs).collect()}


@pytest.mark.parametrize("few, most, on_driver", [(50, 50_000, 200), (10_000, 50_000, 200), (50, 50_000, 0), (2000, 3, 0)])
def test_quantiles_of_awkward_values(spark, monkeypatch, few, most, on_driver):
    monkeypatch.setattr(S, "DRIVER_RANKS", on_driver)
    monkeypatch.setattr(S, "MOST_RANKS", most)
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(few)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(3000)],
        "tails": [math.exp(rng.gauss(0, 60)) * rng.choice([-1, 1]) for _ in range(1500)],
        "ties": [float(rng.randint(0, 3)) for _ in range(800)],
        "near": [1.0 + rng.randint(0, 40) * 2.0 ** -52 for _ in range(300)],
        "one": [7.5], "two": [1.0, 2.0], "huge": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324],
    }
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("ties", 1.0, 300), ("none", None, 5), (None, 3.0, 2), (None, 4.0, 1)]
    groups["ties"] = groups["ties"] + [1.0] * 300
    qs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0, "f": 0.0}
    got = _quantiles(spark, rows, qs)
    assert got.pop(None) == pytest.approx(list(np.quantile([3.0, 3.0, 4.0], list(qs.values()))))
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        for q, x in zip(qs.values(), got[g]):
            h = (len(vs) - 1) * q
            lo, hi = vs[math.floor(h)], vs[math.ceil(h)]
            assert x == lo + (hi - lo) * (h - math.floor(h)), (g, q)


def test_quantiles_of_nothing_and_infinities(spark):
    assert _quantiles(spark, [], {"m": 0.5}) == {} and _quantiles(spark, [("a", None, 1)], {"m": 0.5}) == {}
    got = _quantiles(spark, [("a", math.inf, 1), ("a", -math.inf, 1), ("a", 2.0, 1), ("a", math.nan, 9)], {"m": 0.5})
    assert got == {"a": [2.0]}


@pytest.mark.parametrize("few", [3, 100_000])
def test_row_at_a_rank(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_VALUES", few)
    rng = random.Random(few)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 20)) if rng.random() > 0.1 else None, rng.choice("xyzé"), rng.randint(-9, 9) + (1 << 60))
            for _ in range(200)]
    df = spark.createDataFrame(rows, "d date, s string, n long").repartition(4)
    order = sorted(rows, key=lambda r: ((False,) if r[0] is None else (True, r[0]), r[1], r[2]))
    for rank in (0, 1, 77, 150, 199):
        assert tuple(S.row_at(df, ["d", "s", "n"], rank).values()) == order[rank]
    assert S.row_at(df, ["d", "s", "n"], 200) is None


def test_time_split_counts(spark):
    for n in (0, 1, 2, 3, 10, 57):
        df = spark.createDataFrame([(i // 3, -i, "x") for i in range(n)], "a long, b long, z string")
        got = {(r.a, r.b): r.split for r in time_split(df, ["a", "b"], 0.8).collect()}
        cut = max(min(int(n * 0.8), n - 1), 1) if n else 0
        assert sum(v == "fit" for v in got.values()) == cut
        assert [got[k] for k in sorted(got)] == ["fit"] * cut + ["calib"] * (n - cut)


@pytest.mark.parametrize("slice_rows", [4096, 4])
def test_sliding_roster_equals_a_plain_count(spark, monkeypatch, slice_rows):
    from rimshot.operators import sliced

    monkeypatch.setattr(sliced, "SLICE_ROWS", slice_rows)
    rng = random.Random(slice_rows)
    results, players = [], []
    for team in (1, 2):
        for g in range(25):
            results.append((2020, team, 100 * team + g, dt.date(2020, 1, 1) + dt.timedelta(days=g)))
            for p in rng.sample(range(14), rng.randint(0, 9)):
                players.append((2020, team, 100 * team + g, p, rng.choice([None, "0:00", f"{rng.randint(1, 40)}:30"])))
    players.append((2020, 1, 999, 1, "30:00"))  # no result
    r = spark.createDataFrame(results, "season_start long, team_id long, game_id long, game_date date")
    p = spark.createDataFrame(players, "season_start long, team_id long, game_id long, player_id long, minutes string")
    out = core_availability(p, r, core=3)
    minutes = lambda m: 0.0 if m is None else int(m.split(":")[0]) + int(m.split(":")[1]) / 60
    want = {}
    for team in (1, 2):
        for g in range(25):
            ten, five, games = {}, {}, {}
            for _, t, game, who, m in players:
                back = 100 * team + g - game
                if t == team and 1 <= back <= 10:
                    ten[who] = ten.get(who, 0) + minutes(m)
                    if back <= 5:
                        five[who] = five.get(who, 0) + minutes(m)
                        games[who] = games.get(who, 0) + (minutes(m) > 0)
            top = sorted(ten, key=lambda x: (-round(ten[x], 9), x))[:3]
            want[100 * team + g] = (g + 1, sum(games.get(x, 0) for x in top), round(sum(five.get(x, 0) for x in top), 6))
    assert {x.game_id: (x.team_game_number, x.core_games5, round(x.core_min5, 6)) for x in out.collect()} == want
