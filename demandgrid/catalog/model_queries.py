"""Global models, recursion, evaluation and the error audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.catalog.base import (
    ENRICHED,
    PREDS,
    SIGNALS,
    VELOCITY,
    day,
    query,
    rnd,
    sql,
    tidy,
)
from demandgrid.catalog.inputs import (
    DAYS,
    enriched,
    holdout_with_metadata,
    merged,
    stacked_predictions,
)
from demandgrid.operators.audit import (
    POISSON_STEPS,
    bias_sign_flip,
    bootstrap_rmsle,
    error_tree_leaves,
    high_error_rows,
    multiaccuracy_audit,
    paired_bootstrap,
    residual_clusters,
)
from demandgrid.operators.encode import Ordinal
from demandgrid.operators.ensembles import fit_log_trees, predict_flat
from demandgrid.operators.metrics import daily_aggregate, slice_scores
from demandgrid.operators.models import TreeSettings, fit_panel_model, tree_columns
from demandgrid.operators.prep import to_long
from demandgrid.plans.boosted import BoostedSettings, boosted_forecast
from demandgrid.operators.recursive import recursive_forecast
from demandgrid.plans.panel import holidays, retail_tables
from demandgrid.plans.training import (
    audit_run,
    audit_summary,
    daily_frame,
    direct_predictions,
    prepare_features,
    recursive_predictions,
    train_panel,
    walk_forward_evaluation,
)
from demandgrid.plans.runs import load_run_model, save_run_model
from demandgrid.session import scratch_path
from demandgrid.settings import FeatureSettings, Roll

HISTORY = FeatureSettings(
    date_features=("month", "dayofweek", "is_weekend", "time_step"),
    lags={"sales": (1, 7, 14, 28)},
    rolls=(Roll("sales", (7, 14, 28), ("mean", "std")),),
    fourier={"dayofweek": (1,)},
    drop_cols=("city", "state", "cluster"),
)


def trained(spark, folder, kind, transform, options=None):
    train, test = merged(spark, folder)
    return train_panel(
        train, test, HISTORY, kind, transform, holidays(spark, folder), DAYS, options, "series"
    )


_TREES = {}  # (application, folder) -> run


def trained_trees(spark, folder):
    """The full-size tree run; its model and written features serve every query of a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TREES:
        _TREES[key] = trained(spark, folder, "trees", "raw")
    return _TREES[key]


# ridge with two features in closed form: yesterday's log sales and the promotion count
TWO = """
rx AS (SELECT store_nbr, family, date, ln(1 + sales) AS y, onpromotion AS x2,
         lag(ln(1 + sales)) OVER (PARTITION BY store_nbr, family ORDER BY date) AS x1 FROM train),
rm AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) + 10 AS s11,
         var_pop(x2) * count(*) + 10 AS s22, covar_pop(x1, x2) * count(*) AS s12,
         covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y
       FROM rx WHERE x1 IS NOT NULL),
rc AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM rm),
rf AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b FROM rc)"""
AR1 = FeatureSettings(lags={"sales": (1,)}, drop_cols=("dcoilwtico", "is_holiday", "cluster"))


def _two_features(spark, folder):
    t = retail_tables(spark, folder)
    rows, used, label = prepare_features(t["train"], t["test"], AR1, "log1p", None, "series")
    names = ["log_sales_lag_1", "onpromotion"]
    model = fit_panel_model(
        rows.filter("is_train"), "ridge", label, [], names, used.history_names(), "log1p",
        {"alpha": 10.0},
    )
    return model, rows, used, label


@query(
    "ridge_coefficients",
    sql(
        f"""SELECT 'log_sales_lag_1' AS feature, {rnd('w1', 'weight', 8)} FROM rf UNION ALL
        SELECT 'onpromotion', {rnd('w2', 'weight', 8)} FROM rf UNION ALL
        SELECT 'intercept', {rnd('b', 'weight', 8)} FROM rf""",
        TWO,
    ),
)
def _(spark, folder):
    model, *_ = _two_features(spark, folder)
    weights = {**model.linear.weights, "intercept": model.linear.intercept}
    return tidy(spark.createDataFrame(list(weights.items()), "feature string, weight double"), 8)


@query(
    "ridge_recursive_two_features",
    sql(
        f"""SELECT store_nbr, family, {day('date')},
        {rnd('greatest(p, 0)', 'log_predicted')} FROM rr WHERE date > (SELECT c - 1 FROM cut)""",
        TWO,
        """
rr AS (SELECT store_nbr, family, date, ln(1 + sales) AS p FROM train
         WHERE date = (SELECT c - 1 FROM cut)
  UNION ALL SELECT v.store_nbr, v.family, v.date, rf.b + rf.w1 * r.p + rf.w2 * v.onpromotion
       FROM rr r JOIN val v ON v.store_nbr = r.store_nbr AND v.family = r.family
         AND v.date = r.date + 1, rf)""",
        recursive=True,
    ),
)
def _(spark, folder):
    model, rows, used, label = _two_features(spark, folder)
    out = recursive_forecast(
        model, rows.filter("is_train"), rows.filter("not is_train"), used, label
    )
    return tidy(out.withColumn("predicted", F.log1p("predicted")).withColumnRenamed(
        "predicted", "log_predicted"))


DIRECT = """
rp AS (SELECT p.store_nbr, p.family, p.date, p.onpromotion AS x2,
         coalesce(rx.x1, ln(1 + l.sales)) AS x1 FROM panel p
       LEFT JOIN rx USING (store_nbr, family, date)
       JOIN train l ON l.uid = p.uid AND l.date = (SELECT c - 1 FROM cut)
       WHERE p.date > (SELECT lo FROM rng))"""
DIRECT_OUT = f"""SELECT store_nbr, family, {day('date')},
  {rnd('greatest(b + w1 * x1 + w2 * x2, 0)', 'log_predicted')} FROM rp, rf"""


def _direct(model, rows):
    out = model.predict(rows).withColumn("log_predicted", F.log1p("predicted"))
    return tidy(out.select("store_nbr", "family", "date", "log_predicted"))


@query("ridge_direct_two_features", sql(DIRECT_OUT, TWO, DIRECT))
def _(spark, folder):
    model, rows, *_ = _two_features(spark, folder)
    return _direct(model, rows)


@query("saved_model_two_features", sql(DIRECT_OUT, TWO, DIRECT))
def _(spark, folder):
    """The same predictions from the stored and loaded model."""
    model, rows, *_ = _two_features(spark, folder)
    path = scratch_path(spark, "model")
    save_run_model(spark, model, path)
    return _direct(load_run_model(spark, path), rows)


GROUP_MEANS = """
gm AS (SELECT type, avg(sales) AS m FROM merged WHERE date < (SELECT c FROM cut) GROUP BY 1)"""


def _by_type(spark, folder, kinds):
    """Models with the store type as only feature, scored once per type."""
    train, _ = merged(spark, folder)
    types = train.select("type").distinct()
    out = []
    for kind, options in kinds.items():
        model = fit_panel_model(train, kind, "sales", ["type"], [], options=options)
        scored = model.predict(types).select("type", F.log1p("predicted").alias("log_predicted"))
        out.append(scored.withColumn("model", F.lit(kind)))
    return tidy(reduce(DataFrame.unionByName, out), 4)


@query(
    "glm_group_means",
    sql(
        f"""SELECT model, type, {rnd('ln(1 + m)', 'log_predicted', 4)} FROM gm,
        (VALUES ('tweedie'), ('poisson')) k(model)""",
        SIGNALS,
        GROUP_MEANS,
    ),
)
def _(spark, folder):
    """Without penalty a log-link model of one grouping predicts the group means."""
    free = {"alpha": 0.0, "tol": 1e-12}
    return _by_type(spark, folder, {"tweedie": free, "poisson": free})


@query(
    "gbt_group_means",
    sql(
        f"SELECT 'trees' AS model, type, {rnd('ln(1 + m)', 'log_predicted', 4)} FROM gm",
        SIGNALS,
        GROUP_MEANS,
    ),
)
def _(spark, folder):
    """A single unsampled tree on one two-valued feature predicts the group means."""
    one = TreeSettings(n_estimators=1, max_depth=1, subsample=1.0, colsample=1.0)
    return _by_type(spark, folder, {"trees": {"trees": one}})


@query("ridge_fit_predict")
def _(spark, folder):
    return tidy(direct_predictions(trained(spark, folder, "ridge", "log1p")), 4)


@query("ridge_recursive")
def _(spark, folder):
    out = recursive_predictions(trained(spark, folder, "ridge", "log1p"))
    return tidy(out.filter("split <> 'train'"), 4)


@query("daily_rescore")
def _(spark, folder):
    """Daily totals of the in-sample and holdout predictions of a run."""
    rows = daily_frame(direct_predictions(trained(spark, folder, "ridge", "log1p")))
    return tidy(daily_aggregate(rows), 2)


@query("tweedie_fit_predict")
def _(spark, folder):
    out = direct_predictions(trained(spark, folder, "tweedie", "raw"))
    return tidy(out.filter("split <> 'train'"), 4)


@query("poisson_fit_predict")
def _(spark, folder):
    out = direct_predictions(trained(spark, folder, "poisson", "raw"))
    return tidy(out.filter("split <> 'train'"), 4)


@query("gbt_fit_predict")
def _(spark, folder):
    out = direct_predictions(trained_trees(spark, folder))
    return tidy(out.filter("split <> 'train'"), 4)


@query("gbt_recursive")
def _(spark, folder):
    out = recursive_predictions(trained_trees(spark, folder))
    return tidy(out.filter("split <> 'train'"), 4)


NEWTON = """
gn AS (SELECT (SELECT ln(avg(sales)) FROM merged WHERE date < (SELECT c FROM cut)) AS s),
gh AS (SELECT type, s, sum(exp(0.9 * s) - sales * exp(-0.1 * s)) AS g,
         sum(0.9 * exp(0.9 * s) + 0.1 * sales * exp(-0.1 * s)) AS h
       FROM merged, gn WHERE date < (SELECT c FROM cut) GROUP BY 1, 2)"""


@query(
    "boosted_log_group_steps",
    sql(
        f"""SELECT type, rounds, {rnd('p', 'log_score', 6)} FROM (
        SELECT type, 1 AS rounds, s - 0.5 * g / h AS p FROM gh UNION ALL
        SELECT type, 30 AS rounds, ln(m) AS p FROM gm)""",
        SIGNALS,
        GROUP_MEANS,
        NEWTON,
    ),
)
def _(spark, folder):
    """One Tweedie round is a Newton step per group; many rounds end at the groups' means."""
    train, _ = merged(spark, folder)
    encoder = Ordinal.fit(train, ["type"])
    coded = tree_columns(train, encoder)
    types = tree_columns(train.select("type").distinct(), encoder)
    parts = []
    for rounds in (1, 30):
        stumps = TreeSettings(rounds, 0.5, max_depth=1, subsample=1.0, colsample=1.0)
        trees = fit_log_trees(coded, ["_x_type"], "sales", stumps, 1.1)
        scored = predict_flat(types, trees, ["_x_type"], "p")
        parts.append(scored.select("type", F.lit(rounds).alias("rounds"), F.log("p").alias("log_score")))
    return tidy(parts[0].unionByName(parts[1]), 6)


@query("boosted_panel")
def _(spark, folder):
    train, test = merged(spark, folder)
    settings = BoostedSettings(
        lags=(7, 14, 28),
        rolling={1: (7,)},
        static=("store_nbr", "family"),
        exogenous=("onpromotion", "is_holiday"),
        objective="tweedie",
        trees=TreeSettings(n_estimators=40, max_bins=64),  # a round is a Spark fit of 1.5 s and more
    )
    return tidy(boosted_forecast(to_long(train), to_long(test), settings), 4)


@query("walk_forward_eval")
def _(spark, folder):
    train, test = merged(spark, folder)
    return tidy(
        walk_forward_evaluation(
            train, test, HISTORY, (16, 30, 60, 90), "ridge", "log1p", holidays(spark, folder),
            strategy="series",
        )
    )


WALK = """
wk AS (SELECT * FROM (VALUES (16, 'val_16d'), (30, 'val_30d')) w(n, label)),
wx AS (SELECT uid, date, ln(1 + sales) AS y, CAST(onpromotion AS DOUBLE) AS x2,
         lag(ln(1 + sales)) OVER (PARTITION BY uid ORDER BY date) AS x1 FROM train),
wr AS (SELECT wk.*, wx.*, date < (SELECT c FROM cut) - n AS before FROM wx, wk
       WHERE x1 IS NOT NULL),
wm AS (SELECT n, label, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
         var_pop(x1) * count(*) + 10 AS s11, var_pop(x2) * count(*) + 10 AS s22,
         covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y,
         covar_pop(x2, y) * count(*) AS s2y, count(*) AS n_train
       FROM wr WHERE before GROUP BY 1, 2),
ww AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM wm),
wf AS (SELECT *, my - w1 * m1 - w2 * m2 AS b FROM ww),
wp AS (SELECT wf.n, x.uid, x.date, x.y AS p, x.y AS y FROM wf JOIN wx x
         ON x.date = (SELECT c FROM cut) - wf.n - 1
  UNION ALL SELECT wf.n, x.uid, x.date, wf.b + wf.w1 * wp.p + wf.w2 * x.x2, x.y
       FROM wp JOIN wf ON wf.n = wp.n JOIN wx x ON x.uid = wp.uid AND x.date = wp.date + 1),
w1 AS (SELECT n, sqrt(avg(pow(y - greatest(b + w1 * x1 + w2 * x2, 0), 2))) AS one, count(*) AS nv
       FROM wr JOIN wf USING (n) WHERE NOT before GROUP BY 1),
w2 AS (SELECT n, sqrt(avg(pow(y - greatest(p, 0), 2))) AS rec FROM wp
       WHERE date >= (SELECT c FROM cut) - n GROUP BY 1)"""


@query(
    "walk_forward_two_features",
    sql(
        f"""SELECT label AS "window", {rnd('one', 'one_shot_rmsle')},
        {rnd('rec', 'recursive_rmsle')}, n_train, nv AS n_val
        FROM wf JOIN w1 USING (n) JOIN w2 USING (n)""",
        WALK,
        recursive=True,
    ),
)
def _(spark, folder):
    t = retail_tables(spark, folder)
    out = walk_forward_evaluation(
        t["train"], t["test"], AR1, (16, 30), "ridge", "log1p", None, {"alpha": 10.0}, "series",
        ([], ["log_sales_lag_1", "onpromotion"]),
    )
    return tidy(out)


ENRICHED_OUT = f"""SELECT {day('date')}, store_nbr, family, actual, predicted, type, cluster, city,
  state, onpromotion, CAST(is_holiday AS BIGINT) AS is_holiday, dcoilwtico,
  {rnd('velocity_mean', 'velocity_mean')}, velocity_tier, CAST(dayofweek AS BIGINT) AS dayofweek,
  {rnd('sle', 'sle')}, {rnd('log_resid', 'log_resid')}, {rnd('abs_log_err', 'abs_log_err')}
  FROM enriched"""


@query("enrich_validation", sql(ENRICHED_OUT, SIGNALS, PREDS, VELOCITY, ENRICHED))
def _(spark, folder):
    return tidy(enriched(spark, folder).drop("id", "split"))


@query(
    "high_error_rows",
    sql(
        f"""SELECT {day('date')}, store_nbr, family, {rnd('abs_log_err', 'abs_log_err')}
        FROM enriched WHERE abs_log_err >= (SELECT quantile_cont(abs_log_err, 0.8) FROM enriched)""",
        SIGNALS,
        PREDS,
        VELOCITY,
        ENRICHED,
    ),
)
def _(spark, folder):
    out = high_error_rows(enriched(spark, folder))
    return tidy(out.select("date", "store_nbr", "family", "abs_log_err"))


@query(
    "bias_sign_flip",
    sql(
        """SELECT count(DISTINCT sign(b)) > 1 AS bias_sign_flip FROM (SELECT velocity_tier,
        sum(predicted - actual) / greatest(sum(actual), 1e-10) * 100 AS b
        FROM enriched GROUP BY 1) WHERE b <> 0""",
        SIGNALS,
        PREDS,
        VELOCITY,
        ENRICHED,
    ),
)
def _(spark, folder):
    return tidy(bias_sign_flip(slice_scores(enriched(spark, folder))))


def sle(col: str) -> str:
    return f"pow(ln(1 + actual) - ln(1 + greatest({col}, 0)), 2)"


TIMES = " + ".join(f"CAST(x >= {t} AS INTEGER)" for t in POISSON_STEPS)
BOOT = f"""
ps AS (SELECT store_nbr, family, count(*) AS n, sum({sle('predicted')}) AS sa,
         sum({sle('naive')}) AS sb FROM preds GROUP BY 1, 2),
dr AS (SELECT b, n, sa, sb, CAST('0x' || substr(md5(b || '-' ||
           md5(CAST(store_nbr AS VARCHAR) || '-' || family) || '-42'), 1, 8) AS BIGINT) AS x
       FROM ps, (SELECT unnest(range(0, 500)) AS b)),
bs AS (SELECT b, nullif(sum(n * w), 0) AS n, sum(sa * w) AS sa, sum(sb * w) AS sb
       FROM (SELECT *, {TIMES} AS w FROM dr) GROUP BY 1)"""


@query(
    "bootstrap_rmsle",
    sql(
        f"""SELECT {rnd('(SELECT sqrt(sum(sa) / sum(n)) FROM ps)', 'val_rmsle')},
        (SELECT count(*) FROM ps) AS n_series, {rnd('avg(s)', 'val_rmsle_boot_mean')},
        {rnd('quantile_cont(s, 0.025)', 'val_rmsle_ci_low')},
        {rnd('quantile_cont(s, 0.975)', 'val_rmsle_ci_high')}, count(*) AS n_boot
        FROM (SELECT sqrt(sa / n) AS s FROM bs)""",
        PREDS,
        BOOT,
    ),
)
def _(spark, folder):
    both = stacked_predictions(spark, folder)
    return tidy(bootstrap_rmsle(both.filter("model = 'SeasonalNaive'")))


@query(
    "paired_bootstrap",
    sql(
        f"""SELECT {rnd('(SELECT sqrt(sum(sa) / sum(n)) - sqrt(sum(sb) / sum(n)) FROM ps)',
                        'delta_rmsle')},
        (SELECT count(*) FROM ps) AS n_series, {rnd('quantile_cont(d, 0.025)', 'delta_ci_low')},
        {rnd('quantile_cont(d, 0.975)', 'delta_ci_high')},
        {rnd('avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END)', 'p_a_worse')}, count(*) AS n_boot
        FROM (SELECT sqrt(sa / n) - sqrt(sb / n) AS d FROM bs)""",
        PREDS,
        BOOT,
    ),
)
def _(spark, folder):
    both = stacked_predictions(spark, folder)
    return tidy(
        paired_bootstrap(
            both.filter("model = 'SeasonalNaive'"), both.filter("model = 'Naive'")
        )
    )


@query("error_tree")
def _(spark, folder):
    return tidy(error_tree_leaves(enriched(spark, folder)))


@query("multiaccuracy")
def _(spark, folder):
    return tidy(multiaccuracy_audit(enriched(spark, folder)))


@query("residual_clusters")
def _(spark, folder):
    out = residual_clusters(enriched(spark, folder))
    maps = ("top_families", "velocity_tier_mix", "type_mix")
    return tidy(out.withColumns({c: F.to_json(c) for c in maps}), 4)


BY_TYPE = f"""SELECT count(*) AS n, {rnd('avg(abs_log_err)', 'mean_abs_log_err')},
  {rnd('sqrt(avg(sle))', 'rmsle')}"""


@query(
    "error_tree_single_split",
    sql(f"{BY_TYPE} FROM enriched GROUP BY type", SIGNALS, PREDS, VELOCITY, ENRICHED),
)
def _(spark, folder):
    """With one two-valued feature and depth one the leaves are its values."""
    out = error_tree_leaves(enriched(spark, folder), ["type"], max_depth=1)
    return tidy(out.drop("leaf_id", "rules"))


@query(
    "residual_clusters_by_type",
    sql(
        f"""{BY_TYPE}, {rnd('sum(predicted - actual) / greatest(sum(actual), 1e-10) * 100',
                            'bias_pct')}, '{{"' || type || '":1.0}}' AS type_mix FROM enriched
        WHERE abs_log_err >= (SELECT quantile_cont(abs_log_err, 0.8) FROM enriched)
        GROUP BY type""",
        SIGNALS,
        PREDS,
        VELOCITY,
        ENRICHED,
    ),
)
def _(spark, folder):
    """Two clusters on one two-valued feature are its values."""
    out = residual_clusters(enriched(spark, folder), ["type"], k=2)
    keep = ("n", "mean_abs_log_err", "rmsle", "bias_pct")
    return tidy(out.select(*keep, F.to_json("type_mix").alias("type_mix")))


MULTI = """
mr AS (SELECT log_resid AS y, CAST(onpromotion AS DOUBLE) AS x1, CAST(dayofweek AS DOUBLE) AS x2,
         row_number() OVER (ORDER BY md5(CAST(date AS VARCHAR) || '-' || store_nbr || '-' || family
           || '-42'), date, store_nbr, family) - 1 AS r, count(*) OVER () AS n FROM enriched),
mt AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) + 1 AS s11,
         var_pop(x2) * count(*) + 1 AS s22, covar_pop(x1, x2) * count(*) AS s12,
         covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y,
         count(*) AS n_train FROM mr WHERE r >= floor(n * 0.25)),
mw AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM mt),
mh AS (SELECT 1 - sum(pow(y - (my + w1 * (x1 - m1) + w2 * (x2 - m2)), 2))
         / (var_pop(y) * count(*)) AS r2, count(*) AS n_val FROM mr, mw WHERE r < floor(n * 0.25))"""


@query(
    "multiaccuracy_two_features",
    sql(
        f"""SELECT {rnd('r2', 'r2')}, n_train, n_val, 'onpromotion' AS feature,
          {rnd('w1', 'coef', 8)} FROM mw, mh UNION ALL
        SELECT {rnd('r2', 'r2')}, n_train, n_val, 'dayofweek', {rnd('w2', 'coef', 8)} FROM mw, mh""",
        SIGNALS,
        PREDS,
        VELOCITY,
        ENRICHED,
        MULTI,
    ),
)
def _(spark, folder):
    out = multiaccuracy_audit(enriched(spark, folder), ["onpromotion", "dayofweek"])
    return tidy(out, 6, coef=8)


@query("audit_job")
def _(spark, folder):
    preds, rows, _ = holdout_with_metadata(spark, folder)
    train, test = merged(spark, folder)
    other = stacked_predictions(spark, folder, ["Naive"]).drop("model")
    parts = audit_run(preds, rows, rows, test, other)
    return tidy(audit_summary(parts), 4)
