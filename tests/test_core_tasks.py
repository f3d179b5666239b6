"""Core-player availability: the exchange before rosters are taken apart grows with the number of team games."""

import datetime

from rimshot.operators import features as FT


def test_exchange_grows_with_team_games(spark, monkeypatch):
    day = datetime.date(2020, 1, 1)
    games = [(2019, t, g * 10 + t, day + datetime.timedelta(days=g)) for t in range(8) for g in range(15)]
    results = spark.createDataFrame(games, "season_start long, team_id long, game_id long, game_date date")
    rows = [(s, t, g, p, f"{(g + p) % 40}:00") for s, t, g, _ in games for p in range(3)]
    players = spark.createDataFrame(rows, "season_start long, team_id long, game_id long, player_id long, minutes string")

    def run():
        out = FT.core_availability(players, results, core=2)
        dealt = [line for line in out._jdf.queryExecution().toString().splitlines() if "REPARTITION_BY_NUM" in line]
        return sorted(map(tuple, out.collect())), dealt

    few, _ = run()
    monkeypatch.setattr(FT, "TASK_GAMES", 10)
    many, dealt = run()
    assert any(f", {1 + len(games) // 10}), REPARTITION_BY_NUM" in line for line in dealt)
    assert few == many and len(few) == len(games)
