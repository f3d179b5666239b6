"""Registry of named queries: a Spark implementation and, where SQL can say it, a DuckDB oracle.

Each Spark query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole input tables. Double columns are rounded to 6 places in both the
Spark result and the oracle, by way of decimals of 12 places: a mean that lies
on a rounding half, such as 0.1109375, may miss it by the last bit of a double,
and then rounds the same way in both. Query modules register themselves on
import.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.plans.oracle_sql import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` (may use ``f_*`` fixture CTEs) is its oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(rounded_by_decimals(sql.strip()))
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column, as ``rounded_by_decimals`` has the oracle do; infinities and NaN stay."""
    def by_decimals(c: str) -> Column:
        x = F.col(c).cast("double")
        near = F.when(F.abs(x) < 1e25, x).cast(f"decimal(38,{SNAP})")
        return F.when(F.abs(x) < 1e25, F.round(near, digits).cast("double")).otherwise(x)

    cols = [by_decimals(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


SNAP = 12  # places of the decimals that stand between a double and its rounding


def rounded_by_decimals(sql: str) -> str:
    """``round(x, 6)`` of an oracle as the rounding of a decimal."""
    out, at = [], 0
    for m in re.finditer(r"(?<![\w.])round\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inside = sql[m.end(): end - 1]
        if not inside.endswith(", 6"):
            continue
        out += [sql[at: m.start()], f"cast(round(cast({rounded_by_decimals(inside[:-3])} as decimal(38, {SNAP})), 6) as double)"]
        at = end
    return "".join(out) + sql[at:]


def load_all() -> None:
    """Import every query module so it registers."""
    from rimshot.plans import (q_features, q_quality, q_results, q_elo, q_metrics,  # noqa: F401
                               q_projection, q_market, q_merge, q_profile, q_models, q_streaming,
                               q_sources, q_gaps)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
