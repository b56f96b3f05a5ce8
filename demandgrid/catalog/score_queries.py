"""Scores, slices, summaries and distribution shift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandgrid.catalog.base import (
    ENRICHED,
    ERRORS,
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
    predictions,
    stacked_predictions,
)
from demandgrid.functions.errors import log_residual, squared_log_error
from demandgrid.operators.joins import merge_dimensions
from demandgrid.operators.metrics import (
    daily_aggregate,
    daily_join,
    delta_vs_best,
    extreme_series,
    family_mix_js,
    family_scores,
    global_rmsle,
    improvement_summary,
    model_board,
    model_comparison,
    period_summaries,
    relative_improvement,
    row_metrics,
    series_score_summary,
    series_scores,
    shift_summary,
    slice_scores,
    top_series,
    value_histogram,
    velocity_tiers,
    worst_families,
    zero_share,
)
from demandgrid.operators.prep import display_window
from demandgrid.operators.splits import filter_validation, timeseries_split
from demandgrid.plans.panel import retail_tables, sales_panel, stored_panel

METRICS = f"""{rnd('sqrt(avg(pow(ln(1 + actual) - ln(1 + greatest(predicted, 0)), 2)))', 'rmsle')},
  {rnd('avg(abs(predicted - actual))', 'mae')},
  {rnd('sum(abs(predicted - actual)) / greatest(sum(actual), 1e-10)', 'wmape')},
  {rnd('sum(predicted - actual) / greatest(sum(actual), 1e-10) * 100', 'bias_pct')},
  {rnd('sqrt(avg(pow(predicted - actual, 2)))', 'rmse', 4)}"""
RMSLE = "sqrt(avg(pow(ln(1 + actual) - ln(1 + greatest(predicted, 0)), 2)))"
STACKED = """
stacked AS (SELECT 'SeasonalNaive' AS model, date, store_nbr, family, actual, predicted FROM preds
  UNION ALL SELECT 'Naive', date, store_nbr, family, actual, naive FROM preds)"""


@query(
    "error_terms",
    sql(
        f"""SELECT {day('date')}, store_nbr, family, {rnd('r', 'log_resid', 8)},
        {rnd('r * r', 'sle', 8)}, {rnd('abs(r)', 'abs_log_err', 8)} FROM ln""",
        PREDS,
        ERRORS,
    ),
)
def _(spark, folder):
    p = predictions(spark, folder)
    y, f = F.col("actual"), F.col("predicted")
    return tidy(
        p.select(
            "date", "store_nbr", "family",
            log_residual(y, f).alias("log_resid"),
            squared_log_error(y, f).alias("sle"),
            F.abs(log_residual(y, f)).alias("abs_log_err"),
        ),
        8,
    )


@query("rmsle_global", sql(f"SELECT {rnd(RMSLE, 'rmsle')} FROM preds", PREDS))
def _(spark, folder):
    return tidy(global_rmsle(predictions(spark, folder)))


@query("row_metrics", sql(f"SELECT store_nbr, {METRICS} FROM preds GROUP BY 1", PREDS))
def _(spark, folder):
    return tidy(row_metrics(predictions(spark, folder), by=["store_nbr"]), 6, rmse=4)


AXES = ("family", "store_nbr", "type", "cluster", "velocity_tier", "dayofweek", "onpromotion")
SLICES = " UNION ALL ".join(
    f"""SELECT '{a}' AS axis, CAST({a} AS VARCHAR) AS slice, count(*) AS n, {rnd(RMSLE, 'rmsle')},
    {rnd('avg(abs(predicted - actual))', 'mae', 4)},
    {rnd('sum(predicted - actual) / greatest(sum(actual), 1e-10) * 100', 'bias_pct')},
    {rnd('sum(abs(predicted - actual)) / greatest(sum(actual), 1e-10)', 'wmape')},
    {rnd('sum(sle) / (SELECT sum(sle) FROM enriched)', 'sle_share')} FROM enriched GROUP BY 2"""
    for a in AXES
)


@query("slice_scores", sql(SLICES, SIGNALS, PREDS, VELOCITY, ENRICHED))
def _(spark, folder):
    return tidy(slice_scores(enriched(spark, folder)), 6, mae=4)


@query(
    "velocity_tiers",
    sql(
        f"SELECT store_nbr, family, {rnd('velocity_mean', 'velocity_mean')}, velocity_tier FROM velocity",
        VELOCITY,
    ),
)
def _(spark, folder):
    train, _ = timeseries_split(sales_panel(spark, folder), DAYS)
    return tidy(velocity_tiers(train))


@query(
    "daily_aggregate",
    sql(f"""SELECT {day('date')}, sum(actual) AS actual, sum(predicted) AS predicted
      FROM preds GROUP BY date""", PREDS),
)
def _(spark, folder):
    return tidy(daily_aggregate(predictions(spark, folder)))


@query(
    "daily_display_window",
    sql(
        f"""SELECT {day('date')}, split, sum(actual) AS actual, sum(predicted) AS predicted FROM (
        SELECT date, CASE WHEN date >= (SELECT c FROM cut) THEN 'val' ELSE 'train' END AS split,
          sales AS actual, coalesce(lag(sales, 7) OVER (PARTITION BY uid ORDER BY date), 0)
          AS predicted FROM panel) WHERE date >= (SELECT c FROM cut) - 60 GROUP BY date, split"""
    ),
)
def _(spark, folder):
    panel = stored_panel(spark, folder)
    week_ago = F.lag("sales", 7).over(Window.partitionBy("store_nbr", "family").orderBy("date"))
    preds = panel.select(
        "date", "store_nbr", "family", F.col("sales").alias("actual"),
        F.coalesce(week_ago, F.lit(0.0)).alias("predicted"), F.lit("train").alias("split"),
    )
    shown = display_window(preds, panel, DAYS, 60)
    return tidy(
        shown.groupBy("date", "split").agg(
            F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
        )
    )


@query(
    "daily_actual_vs_predicted",
    sql(
        f"""SELECT {day('a.date', 'date')}, a.actual, p.predicted FROM
        (SELECT date, sum(sales) AS actual FROM panel GROUP BY 1) a JOIN
        (SELECT date, sum(predicted) AS predicted FROM preds GROUP BY 1) p USING (date)""",
        PREDS,
    ),
)
def _(spark, folder):
    actual = sales_panel(spark, folder).withColumnRenamed("sales", "actual")
    return tidy(daily_join(actual, predictions(spark, folder)))


SERIES_SCORES = f"""
ss AS (SELECT store_nbr, family, count(*) AS n, {RMSLE} AS rmsle, avg(actual) AS mean_actual,
         avg(predicted) AS mean_predicted FROM preds GROUP BY 1, 2)"""


@query(
    "series_scores",
    sql(
        f"""SELECT store_nbr, family, n, {rnd('rmsle', 'rmsle')}, {rnd('mean_actual', 'mean_actual')},
        {rnd('mean_predicted', 'mean_predicted')} FROM ss""",
        PREDS,
        SERIES_SCORES,
    ),
)
def _(spark, folder):
    return tidy(series_scores(predictions(spark, folder)))


@query(
    "series_score_summary",
    sql(
        f"""SELECT {rnd('min(rmsle)', 'min_rmsle')}, {rnd('median(rmsle)', 'median_rmsle')},
        {rnd('max(rmsle)', 'max_rmsle')} FROM ss""",
        PREDS,
        SERIES_SCORES,
    ),
)
def _(spark, folder):
    return tidy(series_score_summary(series_scores(predictions(spark, folder))))


@query(
    "extreme_series",
    sql(
        f"""(SELECT store_nbr, family, {rnd('rmsle', 'rmsle')}, 'worst' AS side FROM ss
          ORDER BY ss.rmsle DESC, store_nbr, family LIMIT 5) UNION ALL
        (SELECT store_nbr, family, {rnd('rmsle', 'rmsle')}, 'best' AS side FROM ss
          ORDER BY ss.rmsle, store_nbr, family LIMIT 5)""",
        PREDS,
        SERIES_SCORES,
    ),
)
def _(spark, folder):
    out = extreme_series(series_scores(predictions(spark, folder)), 5)
    return tidy(out.select("store_nbr", "family", "rmsle", "side"))


@query(
    "family_scores",
    sql(f"SELECT family, count(*) AS n, {rnd(RMSLE, 'rmsle')} FROM preds GROUP BY 1", PREDS),
)
def _(spark, folder):
    return tidy(family_scores(predictions(spark, folder)))


@query(
    "worst_families",
    sql(
        f"""SELECT family, count(*) AS n, {rnd(RMSLE, 'rmsle')} FROM preds GROUP BY 1
        ORDER BY {RMSLE} DESC, family LIMIT 3""",
        PREDS,
    ),
)
def _(spark, folder):
    return tidy(worst_families(predictions(spark, folder), 3))


@query(
    "hero_series",
    sql("""SELECT store_nbr, family, sum(sales) AS total FROM panel GROUP BY 1, 2
      ORDER BY total DESC, store_nbr, family LIMIT 5"""),
)
def _(spark, folder):
    return tidy(top_series(sales_panel(spark, folder), 5))


@query(
    "zero_share",
    sql(f"""SELECT {rnd('avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END) * 100', 'pct_zero')},
      {rnd('median(sales)', 'median')} FROM panel"""),
)
def _(spark, folder):
    return tidy(zero_share(sales_panel(spark, folder)))


@query(
    "value_histogram",
    sql(
        f"""SELECT bin, {rnd('lo + bin * w', 'bin_start')}, count(*) AS n FROM (
        SELECT CAST(least(floor((v - lo) / w), 49) AS BIGINT) AS bin, lo, w FROM
          (SELECT ln(1 + predicted) AS v FROM preds WHERE predicted > 0),
          (SELECT min(ln(1 + predicted)) AS lo,
             (max(ln(1 + predicted)) - min(ln(1 + predicted))) / 50.0 AS w
           FROM preds WHERE predicted > 0)) GROUP BY bin, lo, w""",
        PREDS,
    ),
)
def _(spark, folder):
    sold = predictions(spark, folder).filter(F.col("predicted") > 0)
    return tidy(value_histogram(sold.select(F.log1p("predicted").alias("v")), "v", 50))


PERIODS = """
pd AS (SELECT CASE WHEN date >= (SELECT c FROM cut) THEN 'test'
         WHEN date >= (SELECT c FROM cut) - 16 THEN 'val' ELSE 'train' END AS period, family,
         CASE WHEN date < (SELECT c FROM cut) THEN sales END AS sales,
         CASE WHEN date < (SELECT c FROM cut) THEN sales ELSE 1.0 END AS mix,
         onpromotion, is_holiday, dcoilwtico FROM merged),
mx AS (SELECT period, family, sum(coalesce(sales, 0)) AS s FROM pd GROUP BY 1, 2),
sh AS (SELECT period, s / CASE WHEN sum(s) OVER (PARTITION BY period) = 0 THEN 1
         ELSE sum(s) OVER (PARTITION BY period) END AS p FROM mx),
en AS (SELECT period, coalesce(-sum(CASE WHEN p > 0 THEN p * ln(greatest(p, 1e-300)) END), 0)
         AS family_mix_entropy FROM sh GROUP BY 1)"""
PERIOD_COLS = f"""period, count(*) AS n_rows, {rnd('avg(onpromotion)', 'promotion_rate')},
  {rnd('avg(is_holiday)', 'holiday_rate')}, {rnd('avg(dcoilwtico)', 'oil_mean', 4)},
  {rnd('stddev_samp(dcoilwtico)', 'oil_std', 4)},
  {rnd('any_value(family_mix_entropy)', 'family_mix_entropy')}"""


def js(a: str, b: str) -> str:
    return f"""(SELECT 0.5 * sum(CASE WHEN pa > 0 THEN pa * ln(greatest(pa, 1e-300) / m)
        ELSE 0 END) + 0.5 * sum(CASE WHEN pb > 0 THEN pb * ln(greatest(pb, 1e-300) / m)
        ELSE 0 END) FROM (SELECT *, greatest(0.5 * (pa + pb), 1e-12) AS m FROM (
      SELECT sa / (sum(sa) OVER () + 1e-12) AS pa, sb / (sum(sb) OVER () + 1e-12) AS pb FROM (
        SELECT family, coalesce(sum(CASE WHEN period = '{a}' THEN mix END), 0) AS sa,
          coalesce(sum(CASE WHEN period = '{b}' THEN mix END), 0) AS sb FROM pd
        WHERE period IN ('{a}', '{b}') GROUP BY 1))))"""


def _periods(spark, folder):
    """Merged rows of train, validation and test; the test days come without target."""
    train, test = merge_dimensions(retail_tables(spark, folder))
    fit, val = timeseries_split(train, DAYS)
    return fit, val, test


@query(
    "period_summary",
    sql(f"SELECT {PERIOD_COLS} FROM pd JOIN en USING (period) GROUP BY 1", SIGNALS, PERIODS),
)
def _(spark, folder):
    fit, val, test = _periods(spark, folder)
    rows = (
        fit.withColumn("period", F.lit("train"))
        .unionByName(val.withColumn("period", F.lit("val")))
        .unionByName(test.withColumn("period", F.lit("test")), allowMissingColumns=True)
    )
    return tidy(period_summaries(rows), 6, oil_mean=4, oil_std=4)


@query(
    "family_mix_js",
    sql(f"SELECT {rnd(js('train', 'val'), 'js', 8)}", SIGNALS, PERIODS),
)
def _(spark, folder):
    fit, val, _ = _periods(spark, folder)
    rows = fit.select(F.lit("train").alias("period"), "family", "sales")
    rows = rows.unionByName(
        val.select(F.lit("val").alias("period"), "family", "sales")
    )
    return tidy(family_mix_js(rows, "train", "val"), 8)


@query(
    "shift_summary",
    sql(
        f"""SELECT {PERIOD_COLS}, {rnd(f'''CASE period WHEN 'val' THEN {js('train', 'val')}
        WHEN 'test' THEN {js('train', 'test')} ELSE 0 END''', 'js_from_train', 8)}
        FROM pd JOIN en USING (period) GROUP BY 1""",
        SIGNALS,
        PERIODS,
    ),
)
def _(spark, folder):
    out = shift_summary(*_periods(spark, folder))
    return tidy(out, 6, oil_mean=4, oil_std=4, js_from_train=8)


GAINS = f"""
ga AS (SELECT store_nbr, family, r AS ref_rmsle, n AS new_rmsle,
         CASE WHEN r > 1e-9 THEN (r - n) / r * 100 END AS g FROM (
       SELECT store_nbr, family, {RMSLE.replace('predicted', 'naive')} AS r, {RMSLE} AS n
       FROM preds GROUP BY 1, 2))"""


def _gains(spark, folder):
    both = stacked_predictions(spark, folder)
    ref = series_scores(both.filter("model = 'Naive'"))
    new = series_scores(both.filter("model = 'SeasonalNaive'"))
    return relative_improvement(ref, new)


@query(
    "relative_improvement",
    sql(
        f"""SELECT store_nbr, family, {rnd('ref_rmsle', 'ref_rmsle')},
        {rnd('new_rmsle', 'new_rmsle')}, {rnd('g', 'improvement_pct')} FROM ga""",
        PREDS,
        GAINS,
    ),
)
def _(spark, folder):
    return tidy(_gains(spark, folder))


@query(
    "improvement_summary",
    sql(
        f"""SELECT count(*) FILTER (g > 0) AS wins,
        {rnd('avg(CASE WHEN g > 0 THEN 1.0 WHEN g IS NOT NULL THEN 0.0 END)', 'win_share')},
        {rnd('median(g)', 'median_improvement')} FROM ga""",
        PREDS,
        GAINS,
    ),
)
def _(spark, folder):
    return tidy(improvement_summary(_gains(spark, folder)))


@query(
    "model_comparison",
    sql(f"SELECT model, count(*) AS n, {METRICS} FROM stacked GROUP BY 1", PREDS, STACKED),
)
def _(spark, folder):
    return tidy(model_comparison(stacked_predictions(spark, folder)), 6, rmse=4)


@query(
    "delta_vs_best",
    sql(
        f"""SELECT model, {rnd('r', 'rmsle')}, {rnd('r - min(r) OVER ()', 'delta')}
        FROM (SELECT model, {RMSLE} AS r FROM stacked GROUP BY 1)""",
        PREDS,
        STACKED,
    ),
)
def _(spark, folder):
    scores = model_comparison(stacked_predictions(spark, folder)).select("model", "rmsle")
    return tidy(delta_vs_best(scores))


@query(
    "model_board",
    sql(
        f"""SELECT model, {rnd('r', 'rmsle')}, {rnd('d', 'daily_rmsle')}, {rnd('s', 'series_rmsle')},
        {rnd('r - min(r) OVER ()', 'delta')} FROM
        (SELECT model, {RMSLE} AS r FROM stacked GROUP BY 1) JOIN
        (SELECT model, {RMSLE} AS d FROM (SELECT model, date, sum(actual) AS actual,
           sum(predicted) AS predicted FROM stacked GROUP BY 1, 2) GROUP BY 1) USING (model) JOIN
        (SELECT model, avg(x) AS s FROM (SELECT model, store_nbr, family, {RMSLE} AS x
           FROM stacked GROUP BY 1, 2, 3) GROUP BY 1) USING (model)""",
        PREDS,
        STACKED,
    ),
)
def _(spark, folder):
    return tidy(model_board(stacked_predictions(spark, folder)))


@query(
    "holdout_filter",
    sql(
        f"""SELECT {day('date')}, store_nbr, family, actual, predicted FROM (
        SELECT date, store_nbr, family, sales AS actual, sales + 1 AS predicted FROM train
        WHERE date >= (SELECT c FROM cut) - 10)"""
    ),
)
def _(spark, folder):
    """All days before the last 16 are labelled train, the others test."""
    panel = sales_panel(spark, folder)
    train, test = timeseries_split(panel, DAYS)
    preds = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )
    preds = preds.select(
        "date", "store_nbr", "family", F.col("sales").alias("actual"),
        (F.col("sales") + 1).alias("predicted"), "split",
    )
    return tidy(filter_validation(preds, 10).drop("split"))
