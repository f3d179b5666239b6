"""Every registered query against its DuckDB oracle (value-level, order-insensitive)."""

import math

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as entry


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


ORACLES = entry.oracle_sql()

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    con = duck(SF_SMALL)
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    a, b = _canon(rows, df.columns), _canon(orows, ocols)
    assert a == b


def test_every_query_has_a_unique_name():
    names = list(entry.queries())
    assert len(names) == len(set(names))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["season_start", "game_id"]
    assert df.count() >= 0
