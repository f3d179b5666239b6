"""The plans and helpers that the findings of round 3 on time and memory asked for."""

import contextlib
import io

from rimshot.plans import catalog


def _plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def _tables(spark, folder):
    """Two games of one regular season (one of them twice) and their line items."""
    folder.mkdir()
    spark.sql("""select * from values
        (1L, 4L, 100.5D, timestamp_ntz'1995-11-02 00:00:00', '1-URGENT'), (1L, 4L, 100.5D, timestamp_ntz'1995-11-02 00:00:00', '1-URGENT'),
        (2L, 7L, 250.0D, timestamp_ntz'1995-11-03 00:00:00', '2-HIGH'), (null, 7L, 250.0D, timestamp_ntz'1995-11-03 00:00:00', '2-HIGH')
        t(o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority)""").write.parquet(str(folder / "orders.parquet"))
    spark.sql("""select * from values (1L, 3L, 5L, 1, 7.0D, 'O'), (1L, 4L, 6L, 2, 9.0D, 'F'), (1L, 5L, 6L, 3, 2.0D, 'O'),
        (2L, 8L, 2L, 1, 4.0D, 'F'), (2L, 8L, 2L, 1, 5.0D, 'F'), (null, 8L, 2L, 1, 5.0D, 'F')
        t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_linestatus)""").write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_outcome_quotes_gather_the_levels_once(spark, tmp_path):
    df = catalog.queries()["s17_outcome_quotes"](spark, _tables(spark, tmp_path / "t"))
    assert _plan(df).count("ReadSchema: struct<l_orderkey") == 1
    rows = {(r["game_id"], r["outcome_index"]): r for r in df.collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert (rows[1, 0]["bid"], rows[1, 0]["ask"], rows[1, 0]["mid"]) == (0.465, 0.5, 0.4825)
    assert (rows[1, 1]["bid"], rows[1, 1]["ask"], rows[1, 1]["mid"]) == (0.5, 0.535, 0.5175)
    assert rows[2, 0]["bid"] is None and rows[2, 0]["mid"] is None and rows[2, 1]["ask"] is None
    # a repeated game maps every one of its documents with the outcomes of every one, and has two books a token
    assert df.where("game_id = 1").count() == 2 * 2 * 2 * 2


def test_draws_are_summed_a_block_at_a_time(spark):
    """The block's numbers are the column's, for ids beyond 32 bits and below 0 too; null teams, ids, chances add nothing."""
    import numpy as np
    from pyspark.sql import functions as F

    from rimshot.operators import projection as P

    rows = [(1998, 20, gid, h, a, p) for gid, h, a, p in (
        (5, 1, 2, 0.5), ((7 << 32) + 9, 2, 3, 0.25), (11, 1, 3, float("nan")), (12, 3, 1, None), (None, 2, 1, 0.9), (13, None, 2, 0.6))]
    kinds = "season_start long, checkpoint int, game_id long, home_team_id long, away_team_id long, p_home_win double"
    for some in (rows, [(1998, 20, -3, 1, 2, 0.5), *rows[:2]]):
        probs = spark.createDataFrame(some, kinds)
        state = spark.createDataFrame([(1998, 20, t, "E", 0, 1500.0 + t) for t in (1, 2, 3)],
                                      "season_start long, checkpoint int, team_id long, conference string, wins_cp long, elo_cp double")
        draws = probs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39))))
        draws = P.with_uniform_draw(draws, F.lit(42) + F.col("season_start") * 100 + F.col("checkpoint"), "draw", "game_id")
        told = [r for r in draws.orderBy("draw").collect() if r["game_id"] is not None]
        ids = list(dict.fromkeys(r["game_id"] for r in told))
        mine = P.uniform_draws(42 + 199820, 40, np.array(ids))
        assert all([r["u"] for r in told if r["game_id"] == g] == list(mine[i]) for i, g in enumerate(ids))
        won = (draws.withColumn("w", (F.col("u") < F.col("p_home_win")).cast("int"))
               .select(F.inline(F.array(F.struct(F.col("home_team_id").alias("t"), F.col("w")),
                                        F.struct(F.col("away_team_id").alias("t"), (1 - F.col("w")).alias("w")))))
               .groupBy("t").agg((F.sum("w") / 40).alias("mean")).collect())
        out = P.project(state, probs, 40)
        assert "Generate explode(sequence" not in _plan(out.where("team_id = 1")).split("MapInArrow")[-1]
        assert "MapInArrow" in _plan(out)
        assert {r["team_id"]: r["exp_wins"] for r in out.collect()} == {t: {r["t"]: r["mean"] or 0 for r in won}.get(t, 0) for t in (1, 2, 3)}


def test_first_lines_of_csv_parts_need_no_sort(spark, tmp_path):
    """A part's first line is taken where it is read, and a landing is cut into parts that many tasks can read."""
    import pyarrow as pa

    from rimshot.sources import files as S

    batches = [pa.RecordBatch.from_arrays([pa.array(v), pa.array(f)], ["value", "_file"]) for v, f in (
        (["a,b", "1,2", "c", "5"], ["x", "x", "y", "y"]), (["6", "", "c"], ["y", "z", "z"]), (["7"], ["z"]))]
    assert [tuple(r.values()) for b in S._first_lines(iter(batches)) for r in b.to_pylist()] == [("a,b", "x"), ("c", "y"), ("", "z")]
    for name, text in (("p1", "gameId,personId\n1,2\ngameId,personId\ngameId,3\n"), ("p2", "﻿PLAYER_ID,GAME_ID\n5,\"6\n7\"\n"), ("p3", "")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    df = S.read_csv_parts(spark, str(tmp_path / "p*"))
    named = {tuple(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in df.collect()}
    assert (("gameId", "1"), ("personId", "2")) in named and (("gameId", "gameId"), ("personId", "3")) in named and len(named) == 3
    spark.range(7).repartition(1).write.options(header=True, maxRecordsPerFile=3).csv(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 3


def test_block_hashes_by_doubling():
    """The blocks' polynomials from those of 1, 2, 4, ... words are those of word after word."""
    import numpy as np
    import xxhash

    from rimshot.llm import linededup as L

    words = [f"w{i % 13}" for i in range(90)]
    for least in (1, 2, 3, 7, 24, 50, 51):
        size, m = (least + 1) // 2, 0xFF51AFD7ED558CCD
        told = []
        for i in range(len(words) - size + 1):
            h = 0
            for w in words[i: i + size]:
                h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w)) % (1 << 64)
            h = ((h ^ (h >> 33)) * m) % (1 << 64)
            told.append(h ^ (h >> 33))
        assert L._blocks(" ".join(words), least).tolist() == told
    assert np.array_equal(L._blocks("a b", 50), np.zeros(0, np.uint64))


def test_only_lines_that_lose_a_part_are_cut_by_words(monkeypatch):
    """Lines that stay or go as a whole need no places of words; before, every line was searched for them."""
    from rimshot.llm import linededup as L

    found, real = [], L.re.finditer
    monkeypatch.setattr(L.re, "finditer", lambda p, line: found.append(line) or real(p, line))
    text = "a b c\nd e\n\n f  g h \ni\n \x85\nj"
    assert L._without_words(text, [{"start": 3, "lines": 3}]) == ("a b c\n\n g h \ni\n \x85\nj", [1], 5, 3)
    assert found == [" f  g h "]
    assert L._without_words(text, []) == (text, [], 5, 0)


def test_words_are_told_and_hashed_many_texts_at_once(monkeypatch):
    """op5: words as ``str.split`` tells them, with one call for long words only; before, each word was hashed by itself."""
    import pyarrow as pa
    import xxhash

    from rimshot.llm import linededup as L

    every = "".join("aé" + chr(c) for c in range(0x3100)) + "\U0001f600" * 9
    texts = ["", "a b", every, "  c" + "d" * 40 + "\n", "\x85", "".join(f"{'x' * i} " for i in range(33)), "b", "\x00 \x00\x00"]
    told = [[xxhash.xxh64_intdigest(w) for w in t.split()] for t in texts]
    calls, real = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(L.xxhash, "xxh64_intdigest", lambda w: calls.append(bytes(w)) or real(w))
    ids, words = L._word_ids(pa.array(["cut", *texts]).slice(1))
    assert [ids[a:b].tolist() for a, b in zip(words, words[1:])] == told
    assert all(len(w) >= 32 for w in calls)
    assert [len(x) for x in L._word_ids(pa.array([], pa.string()))] == [0, 1]


def test_least_blocks_of_many_texts():
    """op5: the marks and places of a batch are those of its texts one by one, with texts too short for a run between."""
    import random

    import pyarrow as pa

    from rimshot.llm import linededup as L

    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(60)]

    def batch(ids):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids, pa.int64()), pa.array([texts[i] for i in ids], pa.string())],
                                          ["doc_id", "h", "text"])

    for least in (1, 2, 5, 8):
        size = (least + 1) // 2
        rows = [r for b in L._marks(iter([batch(range(60))]), least) for r in b.to_pylist()]
        alone = [r for i in range(60) for b in L._marks(iter([batch([i])]), least) for r in b.to_pylist()]
        assert rows == alone and [r["doc_id"] for r in rows] == [i for i in range(60) if len(texts[i].split()) >= least]
        for r in rows:
            blocks = [x >> 28 for x in L._blocks(texts[r["doc_id"]], least).tolist()]
            runs = range(r["words"] - least + 1)
            assert r["at"] == sorted({min(range(i, i + least - size + 1), key=lambda k: (blocks[k], k)) for i in runs})


def test_runs_to_remove_are_joined():
    """op5: runs that overlap or meet are one; before, each of them was handed on as a row of its own."""
    import pyarrow as pa

    from rimshot.llm import linededup as L

    kind = pa.list_(pa.struct([("start", pa.int32()), ("lines", pa.int32())]))
    gone = [[(9, 1), (0, 3), (2, 4), (6, 1)], None, [], [(0, 5), (1, 2), (7, 2)]]
    column = pa.array([g if g is None else [{"start": a, "lines": n} for a, n in g] for g in gone], kind)
    assert L._spans(column) == [[{"start": 0, "lines": 7}, {"start": 9, "lines": 1}], None, None, [{"start": 0, "lines": 5}, {"start": 7, "lines": 2}]]
    assert L._spans(column.slice(1, 2)) == [None, None] and L._spans(column.slice(0, 0)) == []


def test_duplicates_are_counted_where_rows_are_dealt(spark, tmp_path, monkeypatch):
    """F21 a03: tasks join and count a bounded number of rows; before, a task that reads held each key of all its rows."""
    from collections import Counter
    from datetime import datetime

    import rimshot.operators.quality as Q
    from rimshot.plans.catalog import queries

    orders = [(k, k * 7 % 50, 100.0 + k, datetime(2020, 1 + k % 12, 3), "1-URGENT") for k in [*range(1, 300), 5, 113]]
    lines = [(k % 310, k % 90, k % 8, 1 + k % 3, 1.0) for k in range(2000)] + [(None, 1, 1, 1, 1.0)] * 3
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    keys = Counter(k for k, *_ in orders)
    told = Counter()
    for k, part, _, line, _ in lines:
        if keys[k]:
            told[(k, line * 100 + part % 40)] += keys[k]
    games = keys + Counter({k: n for k, n in keys.items() if k % 113 == 0})
    for rows in (500_000, 100):
        monkeypatch.setattr(Q, "DEALT_ROWS", rows)
        players = queries()["a03_duplicate_player_rows"](spark, str(tmp_path))
        assert {(r.game_id, r.player_id): r.n for r in players.collect()} == {k: n for k, n in told.items() if n > 1}
        found = queries()["a03_duplicate_games"](spark, str(tmp_path))
        assert {r.game_id: r.n for r in found.collect()} == {k: n for k, n in games.items() if n > 1}
    plan = players._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    plan = players._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(") == 2 and plan.rindex("HashAggregate") < plan.index("hashpartitioning(")
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(") == 1 and plan.rindex("HashAggregate") < plan.index("hashpartitioning(")
