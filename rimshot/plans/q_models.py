"""Queries: preprocessing (L1, L2, L4), temperature fit (L13) with SQL oracles; model fits, backtests,
tuning, coefficients and permutation importance (L3, L5-L12, L14) as rows-only checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimshot.functions import expressions as E
from rimshot.functions import shuffles as SH
from rimshot.operators import features as FT
from rimshot.operators import folds as FD
from rimshot.operators import metrics as M
from rimshot.operators import models as ML
from rimshot.plans.catalog import query, round_doubles
from rimshot.plans.oracle_sql import register
from rimshot.operators.elo import elo
from rimshot.operators.results import team_game_results
from rimshot.plans.q_features import MATCHUP_FEATURES, base_table, calendar, labels_table, next_game_table, rolled_table
from rimshot.plans.q_metrics import preds_game
from rimshot.session import checkpoint_dir, job, scratch_path, settled
from rimshot.sources import fixtures as fx

LABEL = "made_playoffs"
# The season model's features (rolling point difference and shooting/turnover rates).
MODEL_FEATURES = ["avg_point_diff_s2d", "avg_point_diff_l10", "efg_s2d", "efg_l10", "ts_s2d", "ts_l10",
                  "fg3a_rate_s2d", "fg3a_rate_l10", "fta_rate_s2d", "fta_rate_l10", "tov_rate_s2d", "tov_rate_l10"]
RATES = {"efg": "efg", "ts": "ts", "fg3a_rate": "fg3a_rate", "fta_rate": "fta_rate", "tov_rate": "tov_rate"}


def _until(numbered, checkpoint: int):
    """The games whose results a row of game ``checkpoint`` + 1 or an earlier one may hold, stored: frames end before a
    row's own game, so no later game of a team-season enters them."""
    return numbered.where(F.col("team_game_number") <= checkpoint + 1).checkpoint()


def model_table(spark, sf_dir, checkpoint: int = 40):
    """model_v2_checkpoint_N: state before game N+1 with rate features, conference and season label."""
    b = base_table(spark, sf_dir).select(
        "*", E.efg_pct("fgm", "fg3m", "fga").alias("efg"), E.ts_pct("pts", "fga", "fta").alias("ts"),
        E.rate("fg3a", "fga").alias("fg3a_rate"), E.rate("fta", "fga").alias("fta_rate"),
        E.tov_rate("turnovers", "fga", "fta").alias("tov_rate"))
    spec = {"avg_point_diff_s2d": ("point_diff", None), "avg_point_diff_l10": ("point_diff", 10)}
    for r in RATES:
        spec[f"{r}_s2d"] = (r, None)
        spec[f"{r}_l10"] = (r, 10)
    cal = calendar(spark, sf_dir)
    cp = FT.checkpoint_rows(FT.rolling(_until(FT.with_game_number(b, calendar=cal), checkpoint), spec), checkpoint)
    cp = FT.attach_conference(cp, fx.teams(spark, sf_dir)).withColumnRenamed("conference", "team_conference")
    lab = labels_table(spark, sf_dir).select("season_start", "team_id", LABEL)
    return cp.join(lab, ["season_start", "team_id"], "left").select(
        "season_start", "team_id", "team_conference", LABEL, *MODEL_FEATURES)


def _roll(col, n):
    frame = "unbounded preceding" if n is None else f"{n} preceding"
    return f"avg({col}) over (w rows between {frame} and 1 preceding)"


register("f_model_cp40", f"""
with b as (select f.*,
                  case when fga <> 0 then (fgm + 5e-1 * fg3m) / fga end as efg,
                  case when 2e0 * (fga + 0.44e0 * fta) <> 0 then pts / (2e0 * (fga + 0.44e0 * fta)) end as ts,
                  case when fga <> 0 then 1e0 * fg3a / fga end as fg3a_rate,
                  case when fga <> 0 then 1e0 * fta / fga end as fta_rate,
                  case when fga + 0.44e0 * fta + turnovers <> 0 then turnovers / (fga + 0.44e0 * fta + turnovers) end as tov_rate
           from f_base f),
r as (select season_start, team_id, game_date, game_id,
             row_number() over w as gn,
             {_roll('point_diff', None)} as avg_point_diff_s2d, {_roll('point_diff', 10)} as avg_point_diff_l10,
             {", ".join(f"{_roll(x, None)} as {x}_s2d, {_roll(x, 10)} as {x}_l10" for x in RATES)}
      from b window w as (partition by season_start, team_id order by game_date, game_id))
select r.season_start, r.team_id, t.conference as team_conference, l.made_playoffs, {", ".join("r." + c for c in MODEL_FEATURES)}
from r left join f_teams t on r.team_id = t.team_id
left join f_labels l on r.season_start = l.season_start and r.team_id = l.team_id
where r.gn = 41""", ("f_base", "f_teams", "f_labels"))


@query("l01_median_impute", "\nunion all\n".join([
    *[f"select '{c}' as feature, round(quantile_cont({c}, 0.5), 6) as median from f_model_cp40" for c in MODEL_FEATURES],
    "select 'conference_no', round(quantile_cont(case when team_conference = 'East' then 1 else 2 end + team_id % 2, 0.5), 6) from f_model_cp40",
    "select 'nothing', null"]))
def l01_median_impute(spark, sf_dir):
    """L1: exact medians of the model features, of an integer column and of one without any value."""
    t = model_table(spark, sf_dir).withColumns({
        "conference_no": (F.when(F.col("team_conference") == "East", 1).otherwise(2) + F.col("team_id") % 2).cast("int"),
        "nothing": F.lit(None).cast("double")})
    cols = [*MODEL_FEATURES, "conference_no", "nothing"]
    med = ML.medians(t, cols)
    rows = [(c, round(med[c], 6) if med.get(c) is not None else None) for c in cols]
    return spark.createDataFrame(rows, "feature string, median double")


@query("l02_scaler_stats", "\nunion all\n".join(
    f"select '{c}' as feature, round(avg(coalesce(f_model_cp40.{c}, m.{c})), 6) as mean, "
    f"round(stddev_pop(coalesce(f_model_cp40.{c}, m.{c})), 6) as std from f_model_cp40, "
    f"(select {', '.join(f'quantile_cont({x}, 0.5) as {x}' for x in MODEL_FEATURES)} from f_model_cp40) m"
    for c in MODEL_FEATURES))
def l02_scaler_stats(spark, sf_dir):
    """L2: mean and population std of the imputed features (the scaler's fitted state)."""
    t = model_table(spark, sf_dir)
    st = ML.scaler_stats(ML.impute(t, ML.medians(t, MODEL_FEATURES)), MODEL_FEATURES)
    r6 = lambda x: round(x, 6) if x is not None else None
    return spark.createDataFrame([(k, r6(m), r6(s)) for k, (m, s) in st.items()],
                                 "feature string, mean double, std double")


@query("l04_class_weights", f"""
select {LABEL}, count(*) as n, round(sum(count(*)) over () / (2e0 * count(*)), 6) as weight
from f_model_cp40 group by {LABEL}""")
def l04_class_weights(spark, sf_dir):
    """L4: balanced class weights n / (2 * n_class)."""
    w = ML.with_class_weights(model_table(spark, sf_dir), LABEL)
    return round_doubles(w.groupBy(LABEL, "weight").agg(F.count(F.lit(1)).alias("n")).select(LABEL, "n", "weight"))


@query("l13_temperature_fit", """
with recursive z as materialized (select model, 1e0 * y_true as y, ln(q / (1 - q)) as z
           from (select model, y_true, least(greatest(y_prob, 1e-6), 1 - 1e-6) as q from f_preds_game
                 union all
                 select model || ' relabelled', case when game_id % 4 = 0 then 0 else 1 end * case when y_prob >= 5e-1 then 1 else 0 end
                        + case when game_id % 4 = 0 then 1 else 0 end * case when y_prob >= 5e-1 then 0 else 1 end,
                        least(greatest(y_prob, 1e-6), 1 - 1e-6) from f_preds_game) x),
s as (
  select distinct model, 0 as k, -30e0 as lo, 30e0 as hi from z
  union all
  select model, k + 1, case when slope > 0 then (lo + hi) / 2 else lo end, case when slope > 0 then hi else (lo + hi) / 2 end
  from (select s.model, s.k, s.lo, s.hi, avg((1e0 / (1e0 + exp(-z.z * exp(-(s.lo + s.hi) / 2))) - z.y) * z.z) as slope
        from s join z on z.model = s.model where s.k < 80 group by s.model, s.k, s.lo, s.hi) step),
t as (select model, exp((lo + hi) / 2) as t from s where k = 80)
select t.model, round(t.t, 6) as temperature,
       round(avg(-(y * ln(1e0 / (1e0 + exp(-z / t)) + 1e-15) + (1 - y) * ln(1 - 1e0 / (1e0 + exp(-z / t)) + 1e-15))), 6) as nll
from t join z on z.model = t.model where t.t < 1e10 group by t.model, t.t
union all
select model, 'infinity'::double, round(ln(2e0), 6) from t where t >= 1e10""")
def l13_temperature_fit(spark, sf_dir):
    """Calibration temperature per model, without bounds (the oracle bisects on the slope of the NLL)."""
    p = preds_game(spark, sf_dir).select("model", "game_id", "y_true", "y_prob")
    says = F.col("y_prob") >= 0.5   # labels that follow the predictions, but for every fourth game
    other = p.withColumns({"model": F.concat("model", F.lit(" relabelled")),
                           "y_true": F.when(F.col("game_id") % 4 == 0, ~says).otherwise(says).cast("int")})
    return round_doubles(ML.fit_temperature(p.unionByName(other), ["model"]))


CHECKPOINTS = (20, 40, 60)
# The checkpoint models' wide feature list.
WIDE_FEATURES = ["win_pct_s2d", "win_pct_l10", "avg_point_diff_s2d", "avg_point_diff_l10",
                 "avg_pts_l10", "avg_ast_l10", "avg_reb_l10", "avg_tov_l10", "is_home",
                 "efg_s2d", "efg_l10", "ts_s2d", "ts_l10", "fg3a_rate_s2d", "fg3a_rate_l10", "fta_rate_s2d", "fta_rate_l10",
                 "tov_rate_s2d", "tov_rate_l10", "elo_pre", "net_rtg_s2d", "net_rtg_l10", "off_rtg_s2d", "off_rtg_l10",
                 "def_rtg_s2d", "def_rtg_l10"]


def wide_table(spark, sf_dir):
    """State before game N+1 for N in 20/40/60: rolling form, rates, ratings and Elo, conference, season label."""
    res = team_game_results(fx.games(spark, sf_dir))
    cal = calendar(spark, sf_dir)
    b = FT.advanced_metrics(base_table(spark, sf_dir)).select(
        "*", E.efg_pct("fgm", "fg3m", "fga").alias("efg"), E.ts_pct("pts", "fga", "fta").alias("ts"),
        E.rate("fg3a", "fga").alias("fg3a_rate"), E.rate("fta", "fga").alias("fta_rate"),
        E.tov_rate("turnovers", "fga", "fta").alias("tov_rate"))
    spec = dict(FT.ROLLING_SPEC)
    for c in ("efg", "ts", "fg3a_rate", "fta_rate", "tov_rate", "net_rtg", "off_rtg", "def_rtg"):
        spec |= {f"{c}_s2d": (c, None), f"{c}_l10": (c, 10)}
    cp = FT.checkpoint_rows(FT.rolling(_until(FT.with_game_number(b, calendar=cal), max(CHECKPOINTS)), spec), CHECKPOINTS)
    cp = FT.attach_conference(cp, fx.teams(spark, sf_dir)).withColumnRenamed("conference", "team_conference")
    cp = cp.join(elo(res).select("game_id", "team_id", "elo_pre"), ["game_id", "team_id"], "left")
    lab = labels_table(spark, sf_dir).select("season_start", "team_id", LABEL)
    return cp.join(lab, ["season_start", "team_id"], "left").select(
        "checkpoint", "season_start", "team_id", "team_conference", LABEL, *WIDE_FEATURES)


ALL_MODELS = ("Baseline_BaseRate", *ML.BASELINES, "LogisticRegression", "RandomForest", "GradientBoosting")


def _backtest(spark, sf_dir, models=None, checkpoints=CHECKPOINTS):
    t = wide_table(spark, sf_dir).where(F.col("checkpoint").isin(list(checkpoints)))
    return ML.backtest(t, WIDE_FEATURES, LABEL, groups=["checkpoint"], **({"models": models} if models else {}))


_STORED: dict[tuple[str, str], str] = {}  # (application, tables) -> folder of the predictions of all models


def all_predictions(spark, sf_dir):
    """The backtest of all models at 20/40/60, fitted and stored once for all queries of an application that read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        folder = scratch_path(spark, "predictions")
        _backtest(spark, sf_dir, ALL_MODELS).write.parquet(folder)
        _STORED[key] = folder
    return spark.read.parquet(_STORED[key])


register("f_cp_labels", """
with n as (select season_start, team_id, row_number() over (partition by season_start, team_id order by game_date, game_id) as gn from f_base)
select gn - 1 as checkpoint, n.season_start, n.team_id, t.conference as team_conference, l.made_playoffs
from n join f_labels l using (season_start, team_id) left join f_teams t using (team_id) where gn in (21, 41, 61)""",
         ("f_base", "f_labels", "f_teams"))


@query("l08_base_rate_backtest", """
with p as (select t.checkpoint, t.season_start as test_season, t.team_id, t.team_conference, t.made_playoffs as y_true,
                  'Baseline_BaseRate' as model, avg(1e0 * r.made_playoffs) as y_prob, count(distinct r.made_playoffs) as classes
           from f_cp_labels t join f_cp_labels r on r.checkpoint = t.checkpoint and r.season_start < t.season_start
           where t.made_playoffs is not null and r.made_playoffs is not null group by all)
select cast(checkpoint as integer) as checkpoint, test_season, team_id, team_conference, y_true, model, round(y_prob, 6) as y_prob
from p where classes = 2""")
def l08_base_rate_backtest(spark, sf_dir):
    """L8 at 20/40/60: the base rate of all earlier seasons as every team's probability."""
    return round_doubles(_backtest(spark, sf_dir, ("Baseline_BaseRate",)))


def _fold_scores(p):
    by = ["checkpoint", "model", "test_season"]
    fm = M.fold_metrics(p, by)
    top8 = M.top_k_hits(p, 8, by, ["team_conference"]).select(*by, F.col("hit_rate").alias("top8conf"))
    top16 = M.top_k_hits(p, 16, by, None, fixed_divisor=True).select(*by, F.col("hit_rate").alias("top16"))
    return fm.join(top8, by).join(top16, by)


def _summary(scores):
    return M.backtest_summary(scores, ["checkpoint", "model"], "test_season", ["auc", "logloss", "brier", "accuracy", "top16", "top8conf"])


@query("l10_backtest_checkpoint40")
def l10_backtest_checkpoint40(spark, sf_dir):
    """L8-L10 + L14: predictions of the rolling backtest at checkpoint 40: all baselines and the full LR."""
    return round_doubles(_backtest(spark, sf_dir, checkpoints=(40,)))


@query("l10_backtest_fold_metrics")
def l10_backtest_fold_metrics(spark, sf_dir):
    """Q9 over the backtest of all models at 20/40/60: per (checkpoint, model, test season) AUC, log loss, Brier,
    accuracy, top 16 and top 8 per conference."""
    return round_doubles(_fold_scores(all_predictions(spark, sf_dir)))


@query("l10_backtest_summary")
def l10_backtest_summary(spark, sf_dir):
    """A19 over the backtest of all models: mean and sample std over the folds of every score, per (checkpoint, model)."""
    return round_doubles(_summary(_fold_scores(all_predictions(spark, sf_dir))))


@query("l06_tree_models")
def l06_tree_models(spark, sf_dir):
    """L6 + L7: random forest (400 trees, balanced in each bootstrap) and gradient boosting in every fold at 20/40/60."""
    return round_doubles(all_predictions(spark, sf_dir).where(F.col("model").isin(*ML.TREE_MODELS)))


_FOLDS_SQL = f"""
folds as (select distinct t.checkpoint, t.season_start as test_season from f_cp_labels t
          where t.made_playoffs is not null and exists (
            select 1 from f_cp_labels r where r.checkpoint = t.checkpoint and r.season_start < t.season_start
            having count(distinct r.made_playoffs) = 2))"""


@query("l10_lr_optimality", f"""
with {_FOLDS_SQL},
features as (select * from (values {", ".join(f"('{m}', '{f}')" for m, fs in [*ML.BASELINES.items(), ("LogisticRegression", WIDE_FEATURES)]
                                              for f in [*fs, "(intercept)"])}) v(model, feature))
select cast(checkpoint as integer) as checkpoint, test_season, model, feature, true as at_optimum from folds cross join features""")
def l10_lr_optimality(spark, sf_dir):
    """L3 + L8 + L10: in every fold, at the weights of every logistic model the gradient of the balanced, penalised log
    loss vanishes in every feature. The gradient is stated anew here, with SQL sums over the fold's training rows."""
    models = {**ML.BASELINES, "LogisticRegression": WIDE_FEATURES}
    folds = FD.make_folds(wide_table(spark, sf_dir), WIDE_FEATURES, LABEL, groups=["checkpoint"])
    if folds is None:
        return spark.createDataFrame([], "checkpoint int, test_season long, model string, feature string, at_optimum boolean")
    fitted = FD.fit_logistic(folds, models)
    table = spark.createDataFrame(
        [(f, m, [WIDE_FEATURES.index(x) for x in models[m]], [float(v) for v in w]) for (f, m), w in fitted.weights.items()],
        "fold int, model string, cols array<int>, w array<double>")
    names = spark.createDataFrame([(i, *k) for i, k in enumerate(folds.keys)], "fold int, checkpoint int, test_season long")
    train = folds.rows.where(~F.col("test"))
    n = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    rows = (train.join(n, "fold").join(table, "fold")
            .withColumn("a", F.concat(F.transform("cols", lambda c: F.get("x", c)), F.array(F.lit(1.0)))))
    z = F.aggregate(F.zip_with("a", "w", lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    rest = (F.lit(1.0) / (1 + F.exp(-z)) - F.col("y")) * F.col("n") / (2 * F.when(F.col("y") == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1")))
    g = (rows.select("fold", "model", "n", "w", "cols", rest.alias("rest"), F.posexplode("a").alias("i", "v"))
         .groupBy("fold", "model", "n", "w", "cols", "i").agg(F.sum(F.col("rest") * F.col("v")).alias("g")))
    inner = F.col("i") < F.size("cols")
    gap = F.col("g") + F.when(inner, F.get("w", F.col("i"))).otherwise(0.0)
    feature = F.when(inner, F.get(F.array(*[F.lit(c) for c in WIDE_FEATURES]), F.get("cols", F.col("i")))).otherwise("(intercept)")
    return g.join(names, "fold").select("checkpoint", "test_season", "model", feature.alias("feature"),
                                        (F.abs(gap) < 1e-6 * F.col("n")).alias("at_optimum"))


@query("l10_base_rate_summary", f"""
with {_FOLDS_SQL},
p as (select t.checkpoint, t.season_start as test_season, t.team_id, t.team_conference, t.made_playoffs as y,
             (select avg(1e0 * r.made_playoffs) from f_cp_labels r
              where r.checkpoint = t.checkpoint and r.season_start < t.season_start and r.made_playoffs is not null) as q
      from f_cp_labels t join folds f on f.checkpoint = t.checkpoint and f.test_season = t.season_start
      where t.made_playoffs is not null),
k as (select *, row_number() over (partition by checkpoint, test_season order by team_id) as r16,
             row_number() over (partition by checkpoint, test_season, team_conference order by team_id) as r8 from p),
m as (select checkpoint, test_season, case when count(distinct y) = 2 then 5e-1 end as auc, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) as logloss,
             avg((q - y) * (q - y)) as brier, avg(case when (q >= 5e-1) = (y = 1) then 1e0 else 0e0 end) as accuracy,
             sum(case when r16 <= 16 then y else 0 end) / 16e0 as top16,
             sum(case when r8 <= 8 then 1e0 * y else 0 end) / sum(case when r8 <= 8 then 1 else 0 end) as top8conf
      from k group by checkpoint, test_season)
select cast(checkpoint as integer) as checkpoint, 'Baseline_BaseRate' as model, count(distinct test_season) as folds,
       {", ".join(f"round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std"
                  for c in ("auc", "logloss", "brier", "accuracy", "top16", "top8conf"))}
from m group by checkpoint""")
def l10_base_rate_summary(spark, sf_dir):
    """A19 over the backtest of the base rate: all six scores, with ties by team."""
    return round_doubles(_summary(_fold_scores(_backtest(spark, sf_dir, ("Baseline_BaseRate",)))))


@query("l07_root_gains", f"""
with t as (select row_number() over () as id, * from f_model_cp40 where {LABEL} is not null),
s as (select distinct season_start as test_season from t),
r as (select s.test_season, t.id, 1e0 * t.{LABEL} as y, {", ".join(f"t.{c}" for c in MODEL_FEATURES)} from s join t on t.season_start < s.test_season),
v as (unpivot r on {", ".join(MODEL_FEATURES)} into name feature value x),
a as (select test_season, count(*) as n, sum(y) as n1 from r group by test_season having count(distinct y) = 2),
med as (select test_season, feature, median(x) as x from v group by all),
w as (select r.test_season, r.id, r.y, m.feature, coalesce(v.x, m.x) as x
      from r join med m using (test_season) left join v on v.test_season = r.test_season and v.id = r.id and v.feature = m.feature),
c as (select test_season, feature, x, sum(count(*)) over (partition by test_season, feature order by x) as l,
             sum(sum(y)) over (partition by test_season, feature order by x) as l1
      from w group by test_season, feature, x)
select test_season, n, round(max(case when l < n then
         power(l1 - l * n1 / n, 2) / l + power((n1 - l1) - (n - l) * n1 / n, 2) / (n - l) end), 6) as gain
from c join a using (test_season) group by test_season, n""")
def l07_root_gains(spark, sf_dir):
    """The gain of the first boosted tree's root split in every fold at checkpoint 40; the oracle tries every cut of
    every feature."""
    folds = FD.make_folds(model_table(spark, sf_dir), MODEL_FEATURES, LABEL)
    rows = [] if folds is None else [(k[0], n, round(float(g), 6)) for k, n, g in zip(folds.keys, folds.size, FD.root_gains(folds, FD.binned(folds)))]
    return spark.createDataFrame(rows, "test_season long, n long, gain double")


def _last_season(spark, sf_dir):
    """(train, test) of the season model, prepared on the training seasons and stored once; None without both."""
    checkpoint_dir(spark)
    t = model_table(spark, sf_dir).where(F.col(LABEL).isNotNull()).checkpoint(eager=True)
    last = t.agg(F.max("season_start")).first()[0]
    train, test = t.where(F.col("season_start") < last), t.where(F.col("season_start") == last)
    if last is None or train.select(LABEL).distinct().count() < 2:
        return None
    tr, te = ML.prepare(train, test, MODEL_FEATURES, LABEL, center=False, balanced=True)
    return tr.checkpoint(eager=True), te


@query("l11_lr_coefficients")
def l11_lr_coefficients(spark, sf_dir):
    """Full-LR coefficients on the scaled features, trained on every season but the last."""
    sets, rows = _last_season(spark, sf_dir), []
    if sets:
        m = ML.fit_lr(sets[0], MODEL_FEATURES, LABEL, 1.0, "weight")
        rows = [(f, round(c, 6), round(abs(c), 6)) for f, c in ML.coefficients(m, MODEL_FEATURES)]
    return spark.createDataFrame(rows, "feature string, coef double, abs_coef double")


@query("l03_lr_optimality", "select feature, true as at_optimum from (values "
       + ", ".join(f"('{c}')" for c in [*MODEL_FEATURES, "(intercept)"]) + ") v(feature) where (select count(distinct made_playoffs) from "
       "f_model_cp40 where season_start < (select max(season_start) from f_model_cp40 where made_playoffs is not null)) = 2")
def l03_lr_optimality(spark, sf_dir):
    """L3: at the fitted coefficients the gradient of the weighted, penalised log loss vanishes in every feature."""
    sets = _last_season(spark, sf_dir)
    if not sets:
        return spark.createDataFrame([], "feature string, at_optimum boolean")
    tr = sets[0]
    m = ML.fit_lr(tr, MODEL_FEATURES, LABEL, 1.0, "weight")
    w = dict(zip(MODEL_FEATURES, m.coefficients))
    z = F.lit(float(m.intercept)) + sum(F.col(c) * F.lit(float(v)) for c, v in w.items())
    rest = (1 / (1 + F.exp(-z)) - F.col(LABEL)) * F.col("weight")
    sums = tr.agg(*[F.sum(rest * F.col(c)).alias(c) for c in MODEL_FEATURES], F.sum(rest).alias("(intercept)"),
                  F.sum("weight").alias("_w")).first()
    # sklearn's form: |w|^2 / 2 + C * weighted losses, with C = 1
    gaps = {**{c: sums[c] + w[c] for c in MODEL_FEATURES}, "(intercept)": sums["(intercept)"]}
    return spark.createDataFrame([(c, bool(abs(g) < 1e-3 * sums["_w"])) for c, g in gaps.items()], "feature string, at_optimum boolean")


@query("l12_permutation_importance")
def l12_permutation_importance(spark, sf_dir):
    """AUC drop per model and feature over 30 shuffles of the last season's test rows, for LR, RF and GBT."""
    sets, out = _last_season(spark, sf_dir), []
    if sets:
        tr, te = sets
        fits = {"LogisticRegression": lambda: ML.fit_lr(tr, MODEL_FEATURES, LABEL, 1.0, "weight"),
                "RandomForest": lambda: ML.fit_rf(tr, MODEL_FEATURES, LABEL, "weight"),
                "GradientBoosting": lambda: ML.fit_gbt(tr, MODEL_FEATURES, LABEL)}
        out = [ML.permutation_importance(fit(), te, MODEL_FEATURES, LABEL, "team_id").withColumn("model", F.lit(name))
               for name, fit in fits.items()]
    if not out:
        return spark.createDataFrame([], "feature string, perm_importance_mean double, perm_importance_std double, model string")
    return round_doubles(out[0].unionByName(out[1]).unionByName(out[2]))


# A given score for the oracle of the shuffles: what counts is which values meet, not who learned the weights.
_GIVEN = {"avg_point_diff_s2d": 0.3, "avg_point_diff_l10": 0.1, "efg_s2d": 20.0, "tov_rate_l10": -15.0}
_GIVEN_REPEATS = 10


def _walk_sql() -> str:
    """The rounds of a shuffle of (pos, key, a, b) as one select after another."""
    src = "({src})"
    for turn in range(SH.ROUNDS):
        x, side, size = ("l", "r", "b") if turn % 2 else ("r", "l", "a")
        src = f"(select *, ({x} * 48271 + key * 69621 + {(turn + 1) * 16807}) % {SH.PRIME} as t1 from {src})"
        src = f"(select *, (t1 * t1 + {x} + key) % {SH.PRIME} as t2 from {src})"
        src = f"(select * exclude (t1, t2, {side}), ({side} + (t2 * t2 + {turn}) % {SH.PRIME}) % {size} as {side} from {src})"
    return src


def _once_sql(rows: str) -> str:
    """(f, rep, rn, n, key, a, b, pos) with pos taken one step on."""
    first = f"(select * exclude (pos), pos // b as l, pos % b as r from ({rows}))"
    return f"select f, rep, rn, n, key, a, b, l * b + r as pos from {_walk_sql().replace('({src})', first)}"


@query("l12_permuted_auc", f"""
with recursive t as (select *, row_number() over (order by team_id)::bigint as rn from f_model_cp40
  where season_start = (select max(season_start) from f_model_cp40 where {LABEL} is not null) and {LABEL} is not null),
size as (select n, a, cast(ceil(n / a) as bigint) as b from (select n, cast(ceil(sqrt(n)) as bigint) as a from (select count(*) as n from t) where n > 0)),
feature(i, f) as (values {", ".join(f"({i}, '{c}')" for i, c in enumerate(_GIVEN))}),
start as (select f, rep, rn, n, (i * {_GIVEN_REPEATS} + rep + {ML.SEED % 1000} * 1000003 % 999983)::bigint as key, a, b, rn - 1 as pos
          from t, size, feature, (select unnest(range({_GIVEN_REPEATS})) as rep)),
walk as ({_once_sql("select * from start")}
  union all {_once_sql("select * from walk where pos >= n")}),
p as (select w.f, w.rep, t.{LABEL} as y, {" + ".join(f"{v!r} * coalesce(case when w.f = '{c}' then s.{c} else t.{c} end, 0)" for c, v in _GIVEN.items())} as z
      from walk w join t on t.rn = w.rn join t s on s.rn = w.pos + 1 where w.pos < w.n),
auc as (select x.f, x.rep, avg(case when x.z > o.z then 1e0 when x.z = o.z then 5e-1 else 0e0 end) as auc
        from p x join p o on o.f = x.f and o.rep = x.rep and x.y = 1 and o.y = 0 group by all)
select f as feature, rep::int as rep, round(auc, 6) as auc from auc""")
def l12_permuted_auc(spark, sf_dir):
    """AUC of a given score after each of ten shuffles of each of its features, last season at checkpoint 40."""
    t = model_table(spark, sf_dir).where(F.col(LABEL).isNotNull()).checkpoint()
    test = t.where(F.col("season_start") == t.agg(F.max("season_start")).first()[0])
    rows = ML.permuted(test, list(_GIVEN), "team_id", _GIVEN_REPEATS)
    z = sum((F.lit(v) * F.coalesce(F.col(c), F.lit(0.0)) for c, v in _GIVEN.items()), F.lit(0.0))
    a = M.auc(rows.withColumn("y_prob", z), ["_feature", "_rep"], LABEL, "y_prob")
    return round_doubles(a.select(F.col("_feature").alias("feature"), F.col("_rep").alias("rep"), "auc"))


@query("l05_tune_c_next_game")
def l05_tune_c_next_game(spark, sf_dir):
    """L5 + L9: time-safe choice of C for the next-game model on game-level differences."""
    games = FT.matchup(rolled_table(spark, sf_dir), MATCHUP_FEATURES).where(F.col("home_is_win").isNotNull())
    cols = [f"{f}_diff" for f in MATCHUP_FEATURES]
    c, _, table = ML.tune_c(games.fillna(0.0, subset=cols), cols, "home_is_win", ["game_date", "game_id"])
    return spark.createDataFrame([(cc, round(ll, 6), cc == c) for cc, ll in table],
                                 "c double, logloss double, chosen boolean")


# The next-game feature sets.
_REST = ["elo_diff", "rest_adv_days", "home_is_b2b", "away_is_b2b", "win_pct_l10_diff", "margin_l10_diff"]
_SIX = ["net_rtg", "efg", "ts", "tov", "oreb", "dreb"]


def _diffs(names, n):
    return [f"{x}_{n}_diff" for x in names]


NEXT_GAME_SETS = {
    "M3_adv_l10": _REST + _diffs([*_SIX, "pace", "poss"], "l10"),
    "M4_adv_l10_l5_s2d": _REST + [f for n in ("l10", "l5", "s2d") for f in _diffs([*_SIX, "pace", "poss"], n)],
    "M5_adv_l10_plus_s2d": _REST + _diffs(_SIX, "l10") + _diffs(_SIX, "s2d"),
}
INJURY_TRAVEL = ["core_games_last5_adv", "core_minutes_last5_adv", "travel_miles_adv", "is_travel_game_adv"]
COMPARED_SETS = {"base": NEXT_GAME_SETS["M5_adv_l10_plus_s2d"],
                 "injury_travel": NEXT_GAME_SETS["M5_adv_l10_plus_s2d"] + INJURY_TRAVEL}


def _next_game_scores(p):
    by = ["model", "test_season"]
    fm = M.fold_metrics(p, by)
    raw = M.fold_metrics(p, by, p="y_prob_raw").select(
        *by, *[F.col(c).alias(f"{c}_raw") for c in ("mean_p", "logloss", "brier", "auc")])
    e = M.ece(M.calibration(p, by), by)
    t = p.groupBy(*by).agg(F.max("temperature").alias("temperature"))
    return fm.join(raw, by).join(e, by).join(t, by)


def _next_game(spark, sf_dir, sets, told):
    """``told`` of the predictions of the next-game backtest, a few rows; games and predictions go when it is known."""
    with job(spark):
        games = settled(spark, lambda: ML.next_game_rows(next_game_table(spark, sf_dir), sets))
        return round_doubles(told(ML.next_game_backtest(games, sets))).checkpoint()


@query("l10_next_game")
def l10_next_game(spark, sf_dir):
    """Rolling next-game backtest of M3, M4 and M5 over all seasons: scores before and after the
    temperature, ECE, T, per (model, test season) with at least 500 training games."""
    return _next_game(spark, sf_dir, NEXT_GAME_SETS, _next_game_scores)


@query("l10_next_game_calibration")
def l10_next_game_calibration(spark, sf_dir):
    """Q5 over the next-game backtest (M5), empty bins kept with n = 0."""
    one = {"M5_adv_l10_plus_s2d": NEXT_GAME_SETS["M5_adv_l10_plus_s2d"]}
    return _next_game(spark, sf_dir, one, lambda p: M.calibration(p, ["model", "test_season"], keep_empty=True))


@query("l09_feature_set_comparison")
def l09_feature_set_comparison(spark, sf_dir):
    """Base against base + injury/travel features over all seasons, as in ``l10_next_game``."""
    return _next_game(spark, sf_dir, COMPARED_SETS, _next_game_scores)
