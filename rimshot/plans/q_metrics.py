"""Queries: model-quality metrics on deterministic scores.

Two prediction tables are derived from the features so every metric has an
oracle: game-level scores (next-game win) and checkpoint-level scores (made
the playoffs, predicted from the team's state after N games).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimshot.functions import expressions as E
from rimshot.operators import metrics as M
from rimshot.operators import features as FT
from rimshot.operators.ordering import time_split
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.oracle_sql import register
from rimshot.plans.q_features import calendar, labels_table, rolled_table
from rimshot.sources import fixtures as fx

GAME_FOLD = ["model", "season_start"]
CP_FOLD = ["checkpoint", "model", "season_start"]

register("f_preds_game", """
select season_start, game_id, game_date, team_id, 'sigmoid_pd_l10' as model, is_win as y_true,
       1e0 / (1e0 + exp(-1e-1 * avg_point_diff_l10)) as y_prob
from f_rolling where avg_point_diff_l10 is not null
union all
select season_start, game_id, game_date, team_id, 'win_pct_l10', is_win, win_pct_l10
from f_rolling where avg_point_diff_l10 is not null""", ("f_rolling",))

register("f_preds_cp", """
with n as (select r.*, row_number() over (partition by season_start, team_id order by game_date, game_id) as gn
           from f_rolling r),
c as (select n.*, cp.checkpoint from n join (select 20 as checkpoint union all select 40 union all select 60) cp
      on n.gn = cp.checkpoint + 1),
x as (select c.checkpoint, c.season_start, c.team_id, t.conference as team_conference, l.made_playoffs as y_true,
             c.avg_point_diff_s2d, c.win_pct_s2d
      from c left join f_teams t on c.team_id = t.team_id
      left join f_labels l on c.season_start = l.season_start and c.team_id = l.team_id)
select checkpoint, season_start, team_id, team_conference, y_true, 'sigmoid_pd_s2d' as model,
       1e0 / (1e0 + exp(-1e-1 * avg_point_diff_s2d)) as y_prob from x
union all
select checkpoint, season_start, team_id, team_conference, y_true, 'win_pct_s2d', win_pct_s2d from x""",
         ("f_rolling", "f_teams", "f_labels"))


def preds_game(spark, sf_dir) -> DataFrame:
    r = rolled_table(spark, sf_dir).where(F.col("avg_point_diff_l10").isNotNull())
    keys = ["season_start", "game_id", "game_date", "team_id"]
    return _scores(r.withColumnRenamed("is_win", "y_true"), [*keys, "y_true"], {
        "sigmoid_pd_l10": E.sigmoid(F.lit(0.1) * F.col("avg_point_diff_l10")), "win_pct_l10": F.col("win_pct_l10")})


def _scores(df, keys, models) -> DataFrame:
    """A row for each model, from one pass over ``df``."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("y_prob")) for m, p in models.items()])
    rows = df.select(*keys, F.explode(each).alias("_m"))
    first = [k for k in keys if k != "y_true"]
    return rows.select(*first, "_m.model", "y_true", "_m.y_prob")


def preds_checkpoint(spark, sf_dir) -> DataFrame:
    numbered = FT.with_game_number(rolled_table(spark, sf_dir), calendar=calendar(spark, sf_dir))
    cp = FT.checkpoint_rows(numbered, (20, 40, 60))
    cp = FT.attach_conference(cp, fx.teams(spark, sf_dir)).withColumnRenamed("conference", "team_conference")
    cp = cp.join(labels_table(spark, sf_dir).select("season_start", "team_id", F.col("made_playoffs").alias("y_true")),
                 ["season_start", "team_id"], "left")
    keys = ["checkpoint", "season_start", "team_id", "team_conference", "y_true"]
    return _scores(cp, keys, {"sigmoid_pd_s2d": E.sigmoid(F.lit(0.1) * F.col("avg_point_diff_s2d")),
                              "win_pct_s2d": F.col("win_pct_s2d")})


def _auc_sql(src: str, fold: str) -> str:
    return f"""
ranked as (select {fold}, y_true,
                  rank() over (partition by {fold} order by y_prob)
                  + (count(*) over (partition by {fold}, y_prob) - 1) / 2e0 as rnk from {src}),
auc_t as (select {fold},
                 case when sum(y_true) > 0 and sum(1 - y_true) > 0 then
                   (sum(case when y_true = 1 then rnk else 0e0 end) - sum(y_true) * (sum(y_true) + 1) / 2e0)
                   / (1e0 * sum(y_true) * sum(1 - y_true)) end as auc
          from ranked group by {fold})"""


def _metrics_sql(src: str, fold: str, digits: int | None = 6) -> str:
    r = (lambda c: f"round({c}, {digits})") if digits else (lambda c: c)
    return f"""
with {_auc_sql(src, fold).strip()},
m as (select {fold}, count(*) as n, avg(y_prob) as mean_p, avg(1e0 * y_true) as mean_y,
             avg(-(y_true * ln(least(greatest(y_prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
                 + (1 - y_true) * ln(1 - least(greatest(y_prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) as logloss,
             avg(power(y_prob - y_true, 2)) as brier,
             avg(case when (y_prob >= 5e-1) = (y_true = 1) then 1e0 else 0e0 end) as accuracy
      from {src} group by {fold})
select m.{fold.replace(', ', ', m.')}, n, {r("mean_p")} as mean_p, {r("mean_y")} as mean_y,
       {r("logloss")} as logloss, {r("brier")} as brier, {r("accuracy")} as accuracy,
       {r("auc")} as auc
from m left join auc_t a using ({fold})"""


@query("q01_fold_metrics_game", _metrics_sql("f_preds_game", "model, season_start"))
def q01_fold_metrics_game(spark, sf_dir):
    """Q1-Q4, Q7: next-game scores per (model, season)."""
    return round_doubles(M.fold_metrics(preds_game(spark, sf_dir), GAME_FOLD))


@query("q09_fold_metrics_checkpoint", _metrics_sql("f_preds_cp", "checkpoint, model, season_start"))
def q09_fold_metrics_checkpoint(spark, sf_dir):
    """Q9 (aggregate part): season-label scores per (checkpoint, model, season)."""
    return round_doubles(M.fold_metrics(preds_checkpoint(spark, sf_dir), CP_FOLD))


@query("w09_top8_by_conference", """
with r as (select *, row_number() over (partition by checkpoint, model, season_start, team_conference
                                        order by y_prob desc, team_id) as rk from f_preds_cp)
select checkpoint, model, season_start, cast(sum(y_true) as bigint) as hits, count(*) as picks,
       round(1e0 * sum(y_true) / count(*), 6) as hit_rate
from r where rk <= 8 group by checkpoint, model, season_start""")
def w09_top8_by_conference(spark, sf_dir):
    return round_doubles(M.top_k_hits(preds_checkpoint(spark, sf_dir), 8, CP_FOLD, ["team_conference"]))


@query("w10_top16_overall", """
with r as (select *, row_number() over (partition by checkpoint, model, season_start
                                        order by y_prob desc, team_id) as rk from f_preds_cp)
select checkpoint, model, season_start, cast(sum(y_true) as bigint) as hits, count(*) as picks,
       round(sum(y_true) / 16e0, 6) as hit_rate
from r where rk <= 16 group by checkpoint, model, season_start""")
def w10_top16_overall(spark, sf_dir):
    return round_doubles(M.top_k_hits(preds_checkpoint(spark, sf_dir), 16, CP_FOLD, None, fixed_divisor=True))


_BIN_SQL = ("(case when y_prob > 9e-1 then 9 when y_prob > 8e-1 then 8 when y_prob > 0.7000000000000001 then 7 "
            "when y_prob > 0.6000000000000001 then 6 when y_prob > 5e-1 then 5 when y_prob > 4e-1 then 4 "
            "when y_prob > 0.30000000000000004 then 3 when y_prob > 2e-1 then 2 when y_prob > 1e-1 then 1 else 0 end)")


@query("q05_calibration_game", f"""
select model, season_start, {_BIN_SQL} as bin, count(*) as n, round(avg(y_prob), 6) as pred_mean,
       round(avg(1e0 * y_true), 6) as actual_rate, round(abs(avg(y_prob) - avg(1e0 * y_true)), 6) as abs_gap
from f_preds_game group by model, season_start, {_BIN_SQL}""")
def q05_calibration_game(spark, sf_dir):
    """Q5: calibration bins per (model, season); right-closed bins, empty bins absent."""
    return round_doubles(M.calibration(preds_game(spark, sf_dir), GAME_FOLD))


@query("q06_ece_game", f"""
with c as (select model, season_start, {_BIN_SQL} as bin, count(*) as n, avg(y_prob) as pm, avg(1e0 * y_true) as ar
           from f_preds_game group by model, season_start, {_BIN_SQL}),
cw as (select *, 1e0 * n / sum(n) over (partition by model, season_start) as w from c)
select model, season_start, round(sum(abs(pm - ar) * w), 6) as ece from cw group by model, season_start""")
def q06_ece_game(spark, sf_dir):
    """ECE per (model, season) from the calibration table."""
    cal = M.calibration(preds_game(spark, sf_dir), GAME_FOLD)
    return round_doubles(M.ece(cal, GAME_FOLD))


@query("a16_prediction_summary", """
select checkpoint, model, count(*) as n, round_even(avg(1e0 * y_true), 3) as actual_rate,
       round_even(avg(y_prob), 3) as mean_p, round_even(quantile_cont(y_prob, 0.1), 3) as p10,
       round_even(quantile_cont(y_prob, 0.5), 3) as p50, round_even(quantile_cont(y_prob, 0.9), 3) as p90,
       round_even(avg(case when y_prob >= 5e-1 then 1e0 else 0e0 end), 3) as frac_over_05
from f_preds_cp group by checkpoint, model""")
def a16_prediction_summary(spark, sf_dir):
    return M.prediction_summary(preds_checkpoint(spark, sf_dir), ["checkpoint", "model"])


@query("a18_threshold_accuracy", """
select checkpoint, model,
       round(avg(case when (y_prob >= 3e-1) = (y_true = 1) then 1e0 else 0e0 end), 6) as acc_at_03,
       round(avg(case when (y_prob >= 5e-1) = (y_true = 1) then 1e0 else 0e0 end), 6) as acc_at_05,
       round(avg(case when (y_prob >= 7e-1) = (y_true = 1) then 1e0 else 0e0 end), 6) as acc_at_07
from f_preds_cp group by checkpoint, model""")
def a18_threshold_accuracy(spark, sf_dir):
    return round_doubles(M.threshold_accuracy(preds_checkpoint(spark, sf_dir), ["checkpoint", "model"]))


@query("a19_backtest_summary", "with fm as (" + _metrics_sql("f_preds_cp", "checkpoint, model, season_start", None).strip()
       + """)
select checkpoint, model, count(distinct season_start) as folds,
       round(avg(auc), 6) as auc_mean, round(stddev_samp(auc), 6) as auc_std,
       round(avg(logloss), 6) as logloss_mean, round(stddev_samp(logloss), 6) as logloss_std,
       round(avg(brier), 6) as brier_mean, round(stddev_samp(brier), 6) as brier_std,
       round(avg(accuracy), 6) as accuracy_mean, round(stddev_samp(accuracy), 6) as accuracy_std
from fm group by checkpoint, model""")
def a19_backtest_summary(spark, sf_dir):
    """Fold metrics summarised over test seasons (folds)."""
    fm = M.fold_metrics(preds_checkpoint(spark, sf_dir), CP_FOLD)
    return round_doubles(M.backtest_summary(fm, ["checkpoint", "model"], "season_start",
                                            ["auc", "logloss", "brier", "accuracy"]))


@query("a20_weighted_means", "with fm as (" + _metrics_sql("f_preds_game", "model, season_start", None).strip() + """)
select model, round(sum(auc * n) / sum(case when auc is not null then n end), 6) as auc_wmean,
       round(sum(logloss * n) / sum(case when logloss is not null then n end), 6) as logloss_wmean,
       round(sum(brier * n) / sum(case when brier is not null then n end), 6) as brier_wmean
from fm group by model""")
def a20_weighted_means(spark, sf_dir):
    fm = M.fold_metrics(preds_game(spark, sf_dir), GAME_FOLD)
    return round_doubles(M.weighted_means(fm, ["model"], "n", ["auc", "logloss", "brier"]))


@query("q08_class_report", """
with c as (select model, sum(case when y_prob >= 5e-1 and y_true = 1 then 1 else 0 end) as tp,
                  sum(case when y_prob >= 5e-1 and y_true = 0 then 1 else 0 end) as fp,
                  sum(case when y_prob < 5e-1 and y_true = 1 then 1 else 0 end) as fn,
                  sum(case when y_prob < 5e-1 and y_true = 0 then 1 else 0 end) as tn
           from f_preds_game group by model),
k as (select model, 1 as cls, tp as a, fp as b, fn as c from c union all select model, 0, tn, fn, fp from c),
pr as (select model, cls, case when a + b > 0 then 1e0 * a / (a + b) else 0e0 end as precision,
              case when a + c > 0 then 1e0 * a / (a + c) else 0e0 end as recall, cast(a + c as bigint) as support from k)
select model, cls, round(precision, 6) as precision, round(recall, 6) as recall,
       round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end, 6) as f1,
       support from pr""")
def q08_class_report(spark, sf_dir):
    return round_doubles(M.class_report(preds_game(spark, sf_dir), ["model"]))


@query("a22_ece_by_experiment", f"""
with e as (select 'raw' as experiment, model, season_start, y_true, y_prob from f_preds_game
           union all
           select 'temp_2', model, season_start, y_true,
                  1e0 / (1e0 + exp(-ln(least(greatest(y_prob, 1e-15), 1 - 1e-15)
                                      / (1 - least(greatest(y_prob, 1e-15), 1 - 1e-15))) / 2e0))
           from f_preds_game),
c as (select experiment, model, {_BIN_SQL} as bin, count(*) as n, avg(y_prob) as pm, avg(1e0 * y_true) as ar
      from e group by experiment, model, {_BIN_SQL}),
cw as (select *, 1e0 * n / sum(n) over (partition by experiment, model) as w from c)
select experiment, model, round(sum(abs(pm - ar) * w), 6) as ece from cw group by experiment, model""")
def a22_ece_by_experiment(spark, sf_dir):
    """ECE of each model under two experiments (raw scores vs temperature 2)."""
    p = preds_game(spark, sf_dir)
    raw = p.withColumn("experiment", F.lit("raw"))
    t2 = p.withColumn("y_prob", E.temperature_scale(F.col("y_prob"), 2.0)).withColumn("experiment", F.lit("temp_2"))
    both = raw.unionByName(t2)
    cal = M.calibration(both, ["experiment", "model"])
    return round_doubles(M.ece(cal, ["experiment", "model"]))


@query("w11_time_split", """
with r as (select season_start, game_id, game_date, team_id,
                  row_number() over (order by game_date, game_id, team_id) as rn, count(*) over () as n
           from f_preds_game where model = 'win_pct_l10')
select season_start, game_id, team_id,
       case when rn <= greatest(least(floor(n * 8e-1), n - 1), 1) then 'fit' else 'calib' end as split
from r""")
def w11_time_split(spark, sf_dir):
    """Chronological 80/20 split of the next-game rows (exact, without a single-partition window)."""
    rows = preds_game(spark, sf_dir).where(F.col("model") == "win_pct_l10")
    s = time_split(rows.select("season_start", "game_id", "game_date", "team_id"),
                   ["game_date", "game_id", "team_id"])
    return s.select("season_start", "game_id", "team_id", "split")
