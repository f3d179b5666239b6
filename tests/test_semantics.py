"""Hand-written rows for edge semantics the fixtures do not cover."""

import datetime as dt

from pyspark.sql import functions as F

from rimshot.functions import expressions as E
from rimshot.operators import merge as U
from rimshot.operators import metrics as M
from rimshot.operators.elo import elo
from rimshot.operators.market import book_quotes, market_map
from rimshot.operators.ordering import global_row_number, time_split
from rimshot.operators.quality import orphans
from rimshot.operators.results import pivot_games, team_game_results


def test_tie_is_a_loss_for_both(spark):
    g = spark.createDataFrame([(1, 2020, dt.date(2020, 10, 1), 1, 2, 100, 100, "Regular Season"),
                               (2, 2020, dt.date(2020, 10, 2), 1, 2, None, 90, "Regular Season")],
                              "game_id long, season_start long, game_date date, home_team_id long, away_team_id long, "
                              "home_points long, away_points long, season_type string")
    r = team_game_results(g).collect()
    assert len(r) == 4 and all(x.is_win == 0 for x in r)


def test_pivot_three_teams_and_missing_marker(spark):
    log = spark.createDataFrame([
        (1, 2020, dt.date(2020, 10, 1), "Regular Season", 10, 101, "T10 vs. T20", "W"),
        (1, 2020, dt.date(2020, 10, 1), "Regular Season", 20, 99, "T20 @ T10", "L"),
        (1, 2020, dt.date(2020, 10, 2), "Regular Season", 30, 80, "T30 @ T10", "L"),
        (2, 2020, dt.date(2020, 10, 1), "PlayIn", 10, 90, "T10 T20", "L"),
        (2, 2020, dt.date(2020, 10, 1), "PlayIn", 20, 95, "T20 @ T10", "W")],
        "game_id long, season_start long, game_date date, season_type string, team_id long, pts long, "
        "matchup string, wl string")
    bulk = {r.game_id: r for r in pivot_games(log, "bulk").collect()}
    assert (bulk[1].home_team_id, bulk[1].away_team_id, bulk[1].winner) == (10, 20, 10)
    assert bulk[2].home_team_id is None and bulk[2].away_team_id == 20 and bulk[2].play_in_flag
    daily = {r.game_id for r in pivot_games(log, "daily").collect()}
    assert daily == {2}


def test_orphans_keep_null_keys(spark):
    fact = spark.createDataFrame([(1,), (None,), (3,)], "k long")
    dim = spark.createDataFrame([(1,)], "k long")
    assert sorted(orphans(fact, dim, "k").collect(), key=lambda r: (r.k is not None, r.k)) == \
        [(None,), (3,)]


def test_calibration_bins_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.30000000000000004,), (0.3,), (1.0,), (0.55,)], "p double")
    got = [r.b for r in df.select(E.calibration_bin(F.col("p")).alias("b")).collect()]
    assert got == [0, 0, 2, 2, 9, 5]


def test_auc_one_class_is_null_and_ties_count_half(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.2), ("b", 1, 0.5), ("b", 0, 0.5), ("b", 0, 0.1)],
                               "g string, y_true int, y_prob double")
    got = {r.g: r.auc for r in M.auc(df, ["g"]).collect()}
    assert got["a"] is None
    assert abs(got["b"] - 0.75) < 1e-12


def test_book_quote_edge_cases(spark):
    docs = spark.createDataFrame([
        (1, '{"timestamp": "1700000000000", "bids": [{"price": "0.40", "size": "10"}, {"price": "0.46", "size": "5"}],'
            ' "asks": [{"price": "0.50", "size": "x"}, {"price": "0.60", "size": "1"}]}'),
        (2, '{"timestamp": "1700000000000", "bids": [], "asks": [{"price": "0.50", "size": "1"}]}'),
        (3, '{"timestamp": "1700000000000", "bids": [{"price": "abc", "size": "1"}], "asks": [{"price": "0.5"}]}')],
        "game_id long, book string")
    q = {r.game_id: r for r in book_quotes(docs).collect()}
    assert q[1].bid == 0.46 and q[1].ask == 0.5 and abs(q[1].mid - 0.48) < 1e-12
    assert abs(q[1].liquidity_top_total - 0.46 * 5) < 1e-12          # unparseable ask size -> 0
    # band [0.46, 0.50]: the 0.46 bid counts, the 0.50 ask has no parseable size and is skipped
    assert abs(q[1].liquidity_depth_2c - 0.46 * 5) < 1e-12
    assert q[2].bid is None and q[2].mid is None and q[2].liquidity_depth_2c is None
    assert q[3].bid is None and q[3].liquidity_top_total is None
    assert q[1].asof_ts == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_json_list_with_quoted_comma(spark):
    df = spark.createDataFrame([('["A, B", "C"]',), ("[x, 'y']",), ("nope",)], "s string")
    got = [r.a for r in df.select(E.json_string_list(F.col("s")).alias("a")).collect()]
    assert got == [["A, B", "C"], ["x", "y"], []]


def test_market_map_first_valid_date_and_host_status(spark):
    doc = ('{"id": "m1", "conditionId": "c1", "clobTokenIds": "[\\"a\\", \\"b\\"]", '
           '"events": [{"id": "e1", "teams": [{"abbr": "LAL", "hostStatus": "home"}, '
           '{"abbreviation": "BOS", "hostStatus": "away"}]}], "startDateIso": "soon", "endDateIso": "2025-01-02T03:00:00Z"}')
    r = market_map(spark.createDataFrame([(doc,)], "market string")).collect()[0]
    assert (r.token_yes_id, r.token_no_id, r.gamma_event_id) == ("a", "b", "e1")
    assert (r.home_team_abbr, r.away_team_abbr, r.game_date) == ("LAL", "BOS", dt.date(2025, 1, 2))


def test_guarded_upsert_null_lock_is_unlocked(spark):
    t = spark.createDataFrame([(1, "a", "x", True), (2, "b", "y", None), (3, "c", "z", False)],
                              "k long, v string, w string, is_manual_override boolean")
    s = spark.createDataFrame([(1, "A", None), (2, "B", None), (4, "D", "d")], "k long, v string, w string")
    got = {r.k: r for r in U.guarded_upsert(t, s, ["k"], ["w"]).collect()}
    assert (got[1].v, got[1].w) == ("a", "x")          # locked
    assert (got[2].v, got[2].w) == ("B", "y")          # null lock: updated, w coalesced
    assert (got[3].v, got[3].w) == ("c", "z")          # not in source
    assert (got[4].v, got[4].is_manual_override) == ("D", False)


def test_global_row_number_and_split(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    rn = {r.k: r.row_num for r in global_row_number(df, ["k"], num_partitions=7).collect()}
    assert rn == {k: k + 1 for k in range(1000)}
    s = time_split(df, ["k"], 0.8).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"fit": 800, "calib": 200}


def test_elo_skips_incomplete_games(spark):
    res = spark.createDataFrame([
        (2020, 1, dt.date(2020, 10, 1), 1, 2, 1, 1), (2020, 1, dt.date(2020, 10, 1), 2, 1, 0, 0),
        (2020, 2, dt.date(2020, 10, 2), 1, 3, 1, 1),
        (2020, 3, dt.date(2020, 10, 3), 2, 1, 1, 0), (2020, 3, dt.date(2020, 10, 3), 1, 2, 0, 1)],
        "season_start long, game_id long, game_date date, team_id long, opp_team_id long, is_home int, is_win int")
    h = {(r.game_id, r.team_id): r for r in elo(res).collect()}
    assert set(h) == {(1, 1), (1, 2), (3, 1), (3, 2)}
    assert h[(1, 1)].elo_post == 1510.0 and h[(1, 2)].elo_post == 1490.0
    assert h[(3, 2)].elo_pre == 1490.0


def test_upsert_and_insert_ignore(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C2")], "k long, v string")
    assert sorted(U.upsert(t, s.where("v != 'C2'"), ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    got = sorted(U.insert_ignore(t, s, ["k"], [F.col("v")]).collect())
    assert got == [(1, "a"), (2, "b"), (3, "C")]


def _hot_rows():
    rows = []
    for i in range(400):                       # one hot team-season holds most rows
        rows.append((2020, 1, dt.date(2020, 10, 1) + dt.timedelta(days=i // 3), i, i % 2, None if i % 17 == 0 else i % 9))
    for i in range(30):
        rows.append((2020, 2, dt.date(2020, 10, 1) + dt.timedelta(days=i), 1000 + i, (i + 1) % 2, i % 5))
    rows += [(None, 3, dt.date(2020, 10, 1), 2000, 1, 1), (2020, 4, None, 2001, 1, 1), (2020, 4, dt.date(2020, 10, 2), 2002, 0, 3)]
    return rows


_HOT = "season_start long, team_id long, game_date date, game_id long, is_win int, point_diff long"


def test_sliced_windows_equal_plain_windows(spark, monkeypatch):
    from pyspark.sql.window import Window
    from rimshot.operators import sliced
    from rimshot.operators.features import rolling, with_game_number
    df = spark.createDataFrame(_hot_rows(), _HOT)
    spec = {"w5": ("is_win", 5), "w10": ("point_diff", 10), "s2d": ("point_diff", None)}
    w = Window.partitionBy("season_start", "team_id").orderBy("game_date", "game_id")
    for size in (4096, 40, 7, 1):
        monkeypatch.setattr(sliced, "SLICE_ROWS", size)
        for pre in (True, False):
            end = -1 if pre else 0
            frames = {"w5": ("is_win", -5), "w10": ("point_diff", -10), "s2d": ("point_diff", Window.unboundedPreceding)}
            plain = df.select("game_id", *[F.avg(c).over(w.rowsBetween(n if n < -1000 or pre else n + 1, end)).alias(o)
                                           for o, (c, n) in frames.items()])
            want = {r.game_id: r for r in plain.collect()}
            got = rolling(df, spec, pre=pre).collect()
            assert len(got) == len(want)
            for r in got:
                for c in spec:
                    x, y = r[c], want[r.game_id][c]
                    assert (x is None and y is None) or abs(x - y) < 1e-9, (size, r.game_id, c, pre, x, y)
        want = {r.game_id: r.n for r in df.select("game_id", F.row_number().over(w).alias("n")).collect()}
        assert {r.game_id: r.team_game_number for r in with_game_number(df).collect()} == want


def test_hot_team_season_is_spread_over_tasks(spark, monkeypatch):
    from rimshot.operators import sliced
    monkeypatch.setattr(sliced, "SLICE_ROWS", 40)
    df = spark.createDataFrame(_hot_rows(), _HOT)
    rows = sliced.spread(df, ["season_start", "team_id"], ["game_date", "game_id"], halo=10)
    sizes = {r["_slice"]: r["count"] for r in rows.where("team_id = 1 and season_start = 2020").groupBy("_slice").count().collect()}
    assert len(sizes) >= 8 and max(sizes.values()) <= 40 + 3 + 10


def test_nan_and_tiny_values_keep_their_means(spark):
    from rimshot.operators.features import rolling
    rows = [(2020, 1, dt.date(2020, 10, 1 + i), i, v) for i, v in enumerate([1e-14, 2e-14, float("nan"), 4.0])]
    df = spark.createDataFrame(rows, "season_start long, team_id long, game_date date, game_id long, x double")
    got = [r.s for r in rolling(df, {"s": ("x", None)}).orderBy("game_id").collect()]
    assert got[0] is None and got[1] == 1e-14 and abs(got[2] - 1.5e-14) < 1e-20 and got[3] != got[3]


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np
    from rimshot.operators.ordering import value_counts
    from rimshot.operators.selection import quantiles
    df = spark.range(0, 2001).select(F.when(F.col("id") % 3 != 2, F.col("id") % 3).alias("g"),
                                     F.when(F.col("id") % 11 != 0, (F.col("id") * 7919) % 1000 / 7.0).alias("v"))
    qs = {"p01": 0.01, "med": 0.5, "p99": 0.99}
    got = {r.g: r for r in quantiles(value_counts(df, ["g"], "v"), ["g"], "v", qs).collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r.g, [])
        if r.v is not None:
            values[r.g].append(r.v)
    assert got.keys() == values.keys()
    for g, v in values.items():
        for name, q in qs.items():
            assert abs(got[g][name] - np.quantile(v, q)) < 1e-9


def _season_recurrence(k, start, home_adv):
    """Game by game over a whole season: what the levels are tested against."""
    def run(pdf):
        pdf = pdf.sort_values(["game_date", "game_id"], kind="mergesort").reset_index(drop=True)
        rating, rows = {}, []
        for g in pdf.itertuples():
            eh, ea = rating.get(g.home_id, start), rating.get(g.away_id, start)
            expected = 1.0 / (1.0 + 10.0 ** (-((eh + home_adv) - ea) / 400.0))
            nh, na = eh + k * (g.res_home - expected), ea + k * (g.res_away - (1.0 - expected))
            rating[g.home_id], rating[g.away_id] = nh, na
            rows.append((eh, nh, ea, na))
        names = ["elo_home_pre", "elo_home_post", "elo_away_pre", "elo_away_post"]
        return pdf.assign(**dict(zip(names, zip(*rows))))
    return run


def test_components_of_edges(spark):
    from rimshot.operators.components import connected
    chain = [(1, i, i + 1) for i in range(40)] + [(1, 100, 101), (1, 102, 101), (2, 5, 7), (None, 3, 9), (2, None, 5), (2, 8, 8)]
    got = {(r.s, r.a): r.component for r in connected(spark.createDataFrame(chain, "s int, a int, b int"), ["s"], "a", "b").collect()}
    assert got == ({(1, i): 0 for i in range(41)} | {(1, i): 100 for i in (100, 101, 102)}
                   | {(2, 5): 5, (2, 7): 5, (2, 8): 8, (None, 3): 3, (None, 9): 3})
    assert connected(spark.createDataFrame([], "s int, a int, b int"), ["s"], "a", "b").count() == 0


def test_elo_levels_and_leagues(spark):
    """Levels hold no team twice and keep each team's order; two leagues in one season are two groups."""
    import numpy as np
    from rimshot.operators.elo import _in_levels
    rng = np.random.default_rng(3)
    home = rng.integers(0, 9, 300)
    away = (home + rng.integers(1, 9, 300)) % 9
    levels = list(_in_levels(home, away, 9))
    assert sorted(np.concatenate(levels).tolist()) == list(range(300))
    depth, longest = {}, {}
    for i, due in enumerate(levels):
        assert len(set(home[due]) | set(away[due])) == 2 * len(due)
        depth |= {int(g): i for g in due}
    for g in range(300):
        d = max(longest.get(home[g], 0), longest.get(away[g], 0))
        assert depth[g] == d
        longest[home[g]] = longest[away[g]] = d + 1
    rows = [(2020, g, f"2020-01-{1 + g % 28:02d}", league * 10 + t, h, int(h == g % 2))
            for g in range(20) for league in [g % 2] for t, h in [(g % 3, 1), (3 + g % 2, 0)]]
    res = spark.createDataFrame(rows, "season_start int, game_id long, game_date string, team_id long, is_home int, is_win int")
    res = res.withColumn("game_date", F.to_date("game_date"))
    plan = elo(res)
    alone = [r for league in (0, 1) for r in elo(res.where(F.floor(F.col("team_id") / 10) == league)).collect()]
    assert sorted(plan.collect()) == sorted(alone) and len(alone) == 40
    assert elo(res.limit(0)).count() == 0


def test_elo_streaming_matches_whole_season(spark):
    """Small Arrow batches force each season across many batches; ratings must equal the
    whole-season computation."""
    import pandas as pd
    from rimshot.operators.elo import pair_games
    from rimshot.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    res = team_game_results(fx.games(spark, SF_SMALL))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.game_id, r.team_id): r.elo_post for r in elo(res).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    games = pair_games(res).toPandas()
    ref = pd.concat([_season_recurrence(20.0, 1500.0, 0.0)(g) for _, g in games.groupby("season_start")])
    for r in ref.itertuples():
        assert abs(got[(r.game_id, r.home_id)] - r.elo_home_post) < 1e-9
        assert abs(got[(r.game_id, r.away_id)] - r.elo_away_post) < 1e-9


def test_resolve_markets_names_aliases_priority_and_misses(spark):
    from rimshot.operators.market import resolve_markets
    from rimshot.sources.fixtures import tricode_names
    d = dt.date(2024, 1, 5)
    games = spark.createDataFrame([(1, d, "LAL", "MIN"), (2, d, "BKN", "PHI"), (3, d, "GSW", "NOP"), (4, d, "BOS", "NYK")],
                                  "game_id long, game_date date, home_tricode string, away_tricode string")
    markets = spark.createDataFrame([
        # game 1: first template, outcomes use an alias name of MIN
        ("nba-min-lal-2024-01-05", "Who wins?", '["Wolves", "Lakers"]'),
        # game 2: only the 4th template exists; outcomes are Yes/No, the question names both teams
        ("nba-bkn-vs-phi-2024-01-05", "Will the  76ERS beat the Nets?", '["Yes", "No"]'),
        # game 3: the first template exists but names other teams; the moneyline variant matches
        ("nba-nop-gsw-2024-01-05", "Celtics vs Knicks", '["Celtics", "Knicks"]'),
        ("nba-nop-gsw-2024-01-05-moneyline", "x", '["Pelicans", "Warriors"]'),
        # game 4: nothing resolvable
        ("nba-nyk-bos-2024-01-05", "Lakers vs Suns", '["Lakers", "Suns"]')],
        "slug string, question string, outcomes string")
    matched, missed = resolve_markets(games, markets, tricode_names(spark))
    got = {r.game_id: (r.slug, r.candidate_pos) for r in matched.collect()}
    assert got == {1: ("nba-min-lal-2024-01-05", 0), 2: ("nba-bkn-vs-phi-2024-01-05", 3),
                   3: ("nba-nop-gsw-2024-01-05-moneyline", 4)}
    assert [r.game_id for r in missed.collect()] == [4]


def test_outcome_quotes_share_the_earlier_time(spark):
    from rimshot.operators.market import outcome_quotes
    m = spark.createDataFrame([(7, "s", '["A", "B"]', "t0", "t1")],
                              "game_id long, slug string, outcomes string, token_yes_id string, token_no_id string")
    books = spark.createDataFrame([
        ("t0", '{"timestamp": "1700000005000", "bids": [{"price": "0.4", "size": "1"}], "asks": [{"price": "0.6", "size": "1"}]}'),
        ("t1", '{"timestamp": "1700000001000", "bids": [{"price": "0.4", "size": "1"}], "asks": []}')],
        "token_id string, book string")
    rows = sorted(outcome_quotes(m, books).collect(), key=lambda r: r.outcome_index)
    assert [r.outcome_name for r in rows] == ["A", "B"]
    assert rows[0].asof_ts == rows[1].asof_ts == dt.datetime(2023, 11, 14, 22, 13, 21)
    assert rows[1].mid is None and abs(rows[0].mid - 0.5) < 1e-12
