"""Queries: feature profiling (A8, A10-A15, P12) over the training rows and the checkpoint-40 table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimshot.operators import features as FT
from rimshot.operators import profile as PR
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.oracle_sql import register
from rimshot.plans.q_features import ROLL_COLS, labels_table, rolled_table
from rimshot.sources import fixtures as fx

TARGET = "made_playoffs"

register("f_training", """
select r.season_start, r.game_id, r.game_date, r.team_id, r.is_home, r.is_win, r.point_diff,
       r.win_pct_l5, r.win_pct_l10, r.avg_point_diff_l10, r.avg_pts_l10, r.avg_tov_l10, r.avg_reb_l10, r.avg_ast_l10,
       r.win_pct_s2d, r.avg_point_diff_s2d, l.made_playoffs
from f_rolling r left join f_labels l on r.season_start = l.season_start and r.team_id = l.team_id
where r.win_pct_l10 is not null and r.avg_point_diff_l10 is not null""", ("f_rolling", "f_labels"))


def training(spark, sf_dir):
    t = FT.training_rows(rolled_table(spark, sf_dir), labels_table(spark, sf_dir))
    return t.select("season_start", "game_id", "game_date", "team_id", "is_home", "is_win", "point_diff",
                    *ROLL_COLS, TARGET)


# P12 on the training schema (ids and target excluded); the oracle uses the same list.
FEATURES = ["is_home", "is_win", "point_diff", *ROLL_COLS]


def _long_sql(cols, src="f_training", keep=""):
    k = f"{keep}, " if keep else ""
    return "\nunion all\n".join(f"select {k}'{c}' as feature, cast({c} as double) as value from {src}" for c in cols)


@query("a08_base_rates", """
with n as (select r.*, row_number() over (partition by season_start, team_id order by game_date, game_id) as gn
           from f_rolling r),
c as (select n.season_start, n.team_id, t.conference, t.division, l.made_playoffs
      from n left join f_teams t on n.team_id = t.team_id
      left join f_labels l on n.season_start = l.season_start and n.team_id = l.team_id where n.gn = 41),
g as (select null as conference, null as division, 3 as level, count(*) as team_seasons, avg(1e0 * made_playoffs) as rate from c
      union all
      select conference, null, 1, count(*), avg(1e0 * made_playoffs) from c group by conference
      union all
      select conference, division, 0, count(*), avg(1e0 * made_playoffs) from c group by conference, division)
select conference, division, level, team_seasons, round(rate, 6) as rate, round_even(rate * 100, 1) as rate_pct from g""")
def a08_base_rates(spark, sf_dir):
    """Playoff base rate at checkpoint 40 overall, by conference, by conference and division."""
    numbered = FT.with_game_number(rolled_table(spark, sf_dir))
    cp = FT.attach_conference(FT.checkpoint_rows(numbered, 40), fx.teams(spark, sf_dir))
    cp = cp.join(labels_table(spark, sf_dir).select("season_start", "team_id", TARGET), ["season_start", "team_id"], "left")
    r = PR.base_rates(cp, TARGET, ["conference", "division"])
    return round_doubles(r.select("conference", "division", F.col("level").cast("int").alias("level"),
                                  "team_seasons", "rate", "rate_pct"))


@query("a10_missingness", f"""
with lf as ({_long_sql(FEATURES + [TARGET])})
select feature, round(100 * avg(case when value is null then 1e0 else 0e0 end), 6) as missing_pct
from lf group by feature""")
def a10_missingness(spark, sf_dir):
    return round_doubles(PR.missingness(training(spark, sf_dir), FEATURES + [TARGET]))


@query("a11_feature_audit", f"""
with lf as ({_long_sql(FEATURES)})
select feature, round(100 * avg(case when value is null then 1e0 else 0e0 end), 6) as missing_pct,
       count(distinct value) as n_unique, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
       round(min(value), 6) as min, round(quantile_cont(value, 0.01), 6) as p01,
       round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.99), 6) as p99,
       round(max(value), 6) as max, count(distinct value) <= 1 as is_constant,
       (max(value) > quantile_cont(value, 0.99) * 3 and quantile_cont(value, 0.99) <> 0) as has_extreme_outliers
from lf group by feature""")
def a11_feature_audit(spark, sf_dir):
    """Feature audit with exact distributed quantiles."""
    t = training(spark, sf_dir)
    return round_doubles(PR.feature_audit(t, PR.numeric_features(t, TARGET)))


@query("a12_std_diff", f"""
with lf as ({_long_sql(FEATURES, keep=TARGET)}),
g as (select feature, count(case when {TARGET} = 1 then value end) as n1, count(case when {TARGET} = 0 then value end) as n0,
             avg(case when {TARGET} = 1 then value end) as m1, avg(case when {TARGET} = 0 then value end) as m0,
             stddev_samp(value) as sd from lf group by feature),
d as (select feature, (m1 - m0) / (case when sd is null or sd <> 0 then sd else 1e0 end) as d, m1, m0
      from g where n1 >= 5 and n0 >= 5)
select feature, round(abs(d), 6) as abs_std_diff, round(d, 6) as std_diff_signed, round(m1, 6) as mean_playoff,
       round(m0, 6) as mean_nonplayoff
from d order by abs(d) desc, feature limit 15""")
def a12_std_diff(spark, sf_dir):
    return round_doubles(PR.std_diff(training(spark, sf_dir), FEATURES, TARGET))


_PAIRS = [(a, b) for a in FEATURES for b in FEATURES]


@query("a13_corr_matrix", "\nunion all\n".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, round(corr(cast({a} as double), cast({b} as double)), 6) as corr "
    f"from f_training" for a, b in _PAIRS))
def a13_corr_matrix(spark, sf_dir):
    return round_doubles(PR.corr_matrix(training(spark, sf_dir), FEATURES))


_UPPER = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query("a14_top_corr", "with c as (" + "\nunion all\n".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, abs(corr(cast({a} as double), cast({b} as double))) as abs_corr "
    f"from f_training" for a, b in _UPPER) + """)
select feature_a, feature_b, round(abs_corr, 6) as abs_corr from c where abs_corr is not null
order by abs_corr desc, feature_a, feature_b limit 10""")
def a14_top_corr(spark, sf_dir):
    t = training(spark, sf_dir)
    return round_doubles(PR.top_corr(PR.corr_matrix(t, FEATURES), FEATURES, 10))


@query("a15_histogram", f"""
with lf as (select * from ({_long_sql(FEATURES)}) x where value is not null),
r as (select feature, min(value) as lo, max(value) as hi from lf group by feature)
select lf.feature, cast(case when hi - lo > 0 then least(floor((value - lo) / (hi - lo) * 30), 29) else 0 end as integer) as bin,
       round(lo, 6) as lo, round(hi, 6) as hi, count(*) as n
from lf join r on lf.feature = r.feature group by 1, 2, 3, 4""")
def a15_histogram(spark, sf_dir):
    return round_doubles(PR.histogram(training(spark, sf_dir), FEATURES, 30))


@query("a15_box_by_target", f"""
with lf as ({_long_sql(FEATURES, keep=TARGET)})
select feature, {TARGET}, round(min(value), 6) as min, round(max(value), 6) as max, count(value) as n,
       round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median,
       round(quantile_cont(value, 0.75), 6) as q3
from lf group by feature, {TARGET}""")
def a15_box_by_target(spark, sf_dir):
    return round_doubles(PR.box_by_target(training(spark, sf_dir), FEATURES, TARGET))
