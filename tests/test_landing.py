"""Landed deliveries of the streaming queries: cut into files by key, with the same result."""

import glob
import os

from rimshot.plans import q_streaming as Q
from rimshot.streaming import jobs as J
from tests.conftest import SF_SMALL


def test_delivery_is_cut_by_key(spark, tmp_path):
    rows = [(k % 500, k, i) for i in (0, 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "key long, value long, chunk int")
    J.land_in_time_order(df, str(tmp_path), "key", 3, "parquet", 4, ["key"])
    files = [sorted(glob.glob(os.path.join(str(tmp_path), f"chunk-{i:05d}", "*.parquet"))) for i in range(3)]
    assert [len(f) for f in files] == [4, 0, 4]
    for some in (files[0], files[2]):
        keys = [{r.key for r in spark.read.parquet(f).collect()} for f in some]
        assert sum(len(k) for k in keys) == len(set().union(*keys)) == 500
        assert sum(spark.read.parquet(f).count() for f in some) == 1000


def test_daily_load_and_quotes_over_cut_deliveries(spark, monkeypatch):
    def rows(query):
        return sorted(map(str, query(spark, SF_SMALL).collect()))

    queries = (Q.x02_daily_player_box, Q.x02_daily_games_stream, Q.x01_quote_stream)
    whole = [rows(q) for q in queries]
    monkeypatch.setattr(J, "LANDED_ROWS", 1500)
    landed = []
    monkeypatch.setattr(J, "files_of", lambda df, real=J.files_of: landed.append(real(df)) or landed[-1])
    assert [rows(q) for q in queries[:2]] == whole[:2]
    assert min(landed) > 1
    monkeypatch.setattr(J, "LANDED_ROWS", 300)
    assert rows(queries[2]) == whole[2] and landed[-1] > 1
