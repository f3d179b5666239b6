"""Scalar and array expressions (Column -> Column), all JVM-side built-ins.

None of these is a Python UDF: they compile into whole-stage code and are
pushed through Catalyst like any other expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ELO_START = 1500.0
ELO_K = 20.0
ELO_HOME_ADV = 0.0
ELO_SCALE = 400.0
EARTH_RADIUS_MILES = 3958.8
FLOAT_EPS = 2.220446049250313e-16          # numpy float64 eps, log-loss clip
CALIBRATION_EPS = 1e-6
PROJECTION_EPS = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (no ANSI error)."""
    return F.when(_c(den) != 0, _c(num) / _c(den))


# E1-E4 shooting and possession rates (null when there is no attempt)
def efg_pct(fgm, fg3m, fga) -> Column:
    return safe_div(_c(fgm) + F.lit(0.5) * _c(fg3m), fga)


def ts_pct(pts, fga, fta) -> Column:
    return safe_div(pts, F.lit(2.0) * (_c(fga) + F.lit(0.44) * _c(fta)))


def rate(part, whole) -> Column:
    return safe_div(part, whole)


def tov_rate(tov, fga, fta) -> Column:
    return safe_div(tov, _c(fga) + F.lit(0.44) * _c(fta) + _c(tov))


def possessions(fga, fta, oreb, tov) -> Column:
    return _c(fga) + F.lit(0.44) * _c(fta) - _c(oreb) + _c(tov)


# E5 win flag: a tie or a missing score is a loss for both sides
def win_flag(team_points, opp_points) -> Column:
    return F.when(_c(team_points) > _c(opp_points), F.lit(1)).otherwise(F.lit(0))


# E6 Elo expectation, sigmoid, logit, temperature scaling
def elo_expected(elo_a, elo_b, home_adv: float = ELO_HOME_ADV) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -(_c(elo_a) + F.lit(home_adv) - _c(elo_b)) / F.lit(ELO_SCALE)))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def clip(p, eps: float) -> Column:
    return F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))


def logit(p, eps: float = PROJECTION_EPS) -> Column:
    q = clip(p, eps)
    return F.ln(q / (F.lit(1.0) - q))


def temperature_scale(p, t: float, eps: float = PROJECTION_EPS) -> Column:
    return sigmoid(logit(p, eps) / F.lit(float(t)))


# E7 great-circle distance in miles
def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2.0 * EARTH_RADIUS_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


# E8 canonical game id: trimmed, all digits -> zero padded to 10, else unchanged
def normalize_game_id(x) -> Column:
    s = F.trim(_c(x).cast("string"))
    return F.when(s.rlike("^[0-9]+$") & (F.length(s) < 10), F.lpad(s, 10, "0")).otherwise(s)


# E9 minutes "MM:SS" -> decimal minutes
def minutes_played(x) -> Column:
    s = F.trim(_c(x).cast("string"))
    mm = F.regexp_extract(s, r"^(\d+)", 1)
    ss = F.regexp_extract(s, r"^\d+:(\d+)", 1)
    return F.when(mm != "", mm.cast("double") + F.coalesce(F.when(ss != "", ss.cast("double")), F.lit(0.0)) / 60.0)


# E10 season from a date: September starts a season, text 'YYYY-YY'
def season_start_from_date(d) -> Column:
    return F.when(F.month(_c(d)) >= 9, F.year(_c(d))).otherwise(F.year(_c(d)) - 1).cast("bigint")


def season_text(season_start) -> Column:
    s = _c(season_start)
    return F.concat(s.cast("string"), F.lit("-"), F.lpad(((s + 1) % 100).cast("string"), 2, "0"))


def season_start_from_text(season) -> Column:
    return F.substring(_c(season), 1, 4).cast("int")


# E11 JSON list text -> array<string>; anything not bracketed -> empty array
def json_string_list(x) -> Column:
    """Proper JSON parse (quoted commas stay inside their item); a bracketed list that is not
    valid JSON falls back to comma splitting with quotes stripped."""
    s = F.trim(_c(x))
    bracketed = s.startswith("[") & s.endswith("]")
    parts = F.transform(F.split(F.substring(s, F.lit(2), F.length(s) - 2), ","),
                        lambda p: F.regexp_replace(F.trim(p), r"^[\"']+|[\"']+$", ""))
    loose = F.filter(parts, lambda p: p != "")
    return F.when(bracketed, F.coalesce(F.from_json(s, "array<string>"), loose)).otherwise(
        F.array().cast("array<string>"))


# E12-E15 order-book quote fields over array<struct<price:double,size:double>>
def best_bid(bids) -> Column:
    """Last bid level by position (books list bids ascending)."""
    return F.try_element_at(_c(bids), F.lit(-1))["price"]


def best_ask(asks) -> Column:
    """First ask level by position."""
    return F.get(_c(asks), 0)["price"]


def mid_price(bid, ask) -> Column:
    return (_c(bid) + _c(ask)) / F.lit(2.0)


def top_liquidity(bids, asks) -> Column:
    """best bid * its size + best ask * its size (missing size -> 0); null unless both sides quote."""
    b = F.try_element_at(_c(bids), F.lit(-1))
    a = F.get(_c(asks), 0)
    return F.when(b["price"].isNotNull() & a["price"].isNotNull(),
                  b["price"] * F.coalesce(b["size"], F.lit(0.0)) + a["price"] * F.coalesce(a["size"], F.lit(0.0)))


def depth_within(bids, asks, mid, cents: float = 0.02) -> Column:
    """Notional (price * size) of bids >= mid - cents plus asks <= mid + cents; levels with a
    null price or size are skipped; null when there is no mid."""
    m = _c(mid)

    def notional(levels, keep):
        kept = F.filter(_c(levels), lambda l: l["price"].isNotNull() & l["size"].isNotNull() & keep(l))
        return F.aggregate(kept, F.lit(0.0), lambda acc, l: acc + l["price"] * l["size"])

    total = (notional(bids, lambda l: l["price"] >= m - F.lit(cents))
             + notional(asks, lambda l: l["price"] <= m + F.lit(cents)))
    return F.when(m.isNotNull(), total)


# E16 epoch milliseconds -> timestamp
def epoch_ms_to_ts(x) -> Column:
    """UTC wall-clock timestamp (timestamp_ntz) of epoch milliseconds; independent of the session time zone."""
    ms = _c(x).try_cast("bigint")
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


# E17 first parseable ISO date of several candidates
def first_valid_date(*cands) -> Column:
    """The first that parses; its own date part, as written."""
    return F.coalesce(*[F.when(F.try_to_timestamp(_c(c)).isNotNull(), F.to_date(F.substring(_c(c), 1, 10))) for c in cands])


# E18 text normalisation
def norm_text(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"\s+", " "))


# E20 calibration bin: 10 equal bins, right-closed, 0 falls in bin 0.
# Edges are numpy.linspace(0, 1, 11); three of them are not the short decimals.
CALIBRATION_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001,
                     0.7000000000000001, 0.8, 0.9, 1.0]


def calibration_bin(p, n_bins: int = 10) -> Column:
    inner = F.array(*[F.lit(e) for e in _linspace_edges(n_bins)[1:-1]])
    # number of inner edges strictly below p: right-closed bins, p = 0 -> bin 0
    return F.size(F.filter(inner, lambda e: e < _c(p)))


def _linspace_edges(n_bins: int) -> list[float]:
    if n_bins == 10:
        return CALIBRATION_EDGES
    step = 1.0 / n_bins
    return [0.0] + [i * step for i in range(1, n_bins)] + [1.0]


# E22 rounding: pandas rounds half-even, PostgreSQL numeric half-up
def round_half_even(x, d: int) -> Column:
    return F.bround(_c(x), d)


def round_half_up(x, d: int) -> Column:
    return F.round(_c(x), d)


LN10_OVER_400 = math.log(10.0) / 400.0
