"""Per-series forecasts, cross-validation and submissions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from demandgrid.catalog.base import PREDS, day, query, rnd, sql, tidy
from demandgrid.catalog.inputs import DAYS
from demandgrid.functions.errors import rmsle
from demandgrid.operators.batch import panel_batch_forecast
from demandgrid.operators.metrics import cv_summary, row_metrics, score_models
from demandgrid.operators.series import (
    cross_validate,
    ets,
    forecast,
    forecast_on_rows,
    future_keys,
    holdout_score,
    naive,
    refit_winner,
    seasonal_naive,
    theta,
    to_submission,
)
from demandgrid.operators.splits import timeseries_split
from demandgrid.operators.windows import lag_roll_features
from demandgrid.plans.panel import long_panel, retail_tables, stored_panel
from demandgrid.settings import FeatureSettings, Roll

RMSLE = "sqrt(avg(pow(ln(1 + actual) - ln(1 + greatest(predicted, 0)), 2)))"
AHEAD = """
ah AS (SELECT k.store_nbr, k.family, CAST(k.store_nbr AS VARCHAR) || '_' || k.family AS uid,
         i AS step, (SELECT hi FROM rng) + CAST(i AS INTEGER) AS ds
       FROM k, (SELECT unnest(range(1, 17)) AS i))"""

SLICE = FeatureSettings(lags={"sales": (1, 7)}, rolls=(Roll("sales", (7,), ("mean",)),))


@query(
    "holdout_slice",
    sql(
        f"""SELECT family, count(*) AS n, {rnd(RMSLE, 'rmsle')}, sum(l7) AS lag_7_total,
        {rnd('avg(m7)', 'mean_roll_7', 4)} FROM (
          SELECT uid, date, lag(sales, 7) OVER (PARTITION BY uid ORDER BY date) AS l7,
            avg(sales) OVER (PARTITION BY uid ORDER BY date
              ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM panel) JOIN preds
        USING (uid, date) GROUP BY 1""",
        PREDS,
    ),
)
def _(spark, folder):
    """History features, 16-day holdout, seasonal naive forecast, score per family."""
    feats = lag_roll_features(stored_panel(spark, folder), SLICE, "series")
    train, val = timeseries_split(feats, DAYS)
    uid = F.concat_ws("_", "store_nbr", "family").alias("unique_id")
    hist = train.select(uid, F.col("date").alias("ds"), F.col("sales").alias("y"))
    rows = val.select("*", uid, F.col("date").alias("ds"))
    scored = forecast_on_rows(rows, seasonal_naive(hist, DAYS))
    return tidy(
        scored.groupBy("family").agg(
            F.count(F.lit(1)).alias("n"),
            rmsle(F.col("sales"), F.col("predicted")).alias("rmsle"),
            F.sum("sales_lag_7").alias("lag_7_total"),
            F.avg("sales_roll_7_mean").alias("mean_roll_7"),
        ),
        6,
        mean_roll_7=4,
    )


@query("future_keys", sql(f"SELECT uid AS unique_id, {day('ds')}, step FROM ah", AHEAD))
def _(spark, folder):
    return tidy(future_keys(long_panel(spark, folder), DAYS))


@query(
    "naive_forecast",
    sql(
        f"""SELECT a.uid AS unique_id, {day('a.ds', 'ds')}, p.sales AS forecast FROM ah a
        JOIN panel p ON p.uid = a.uid AND p.date = (SELECT hi FROM rng)""",
        AHEAD,
    ),
)
def _(spark, folder):
    return tidy(naive(long_panel(spark, folder), DAYS))


@query(
    "seasonal_naive_forecast",
    sql(
        f"""SELECT a.uid AS unique_id, {day('a.ds', 'ds')}, p.sales AS forecast FROM ah a
        JOIN panel p ON p.uid = a.uid
          AND p.date = (SELECT hi FROM rng) - 6 + CAST((a.step - 1) % 7 AS INTEGER)""",
        AHEAD,
    ),
)
def _(spark, folder):
    return tidy(seasonal_naive(long_panel(spark, folder), DAYS))


THETA_SQL = """
tb AS (SELECT uid, date, sales AS y, row_number() OVER w AS t, count(*) OVER (PARTITION BY uid) AS n,
         avg(sales) OVER (PARTITION BY uid) AS mean, min(sales) OVER (PARTITION BY uid) AS low,
         avg(sales) OVER (PARTITION BY uid ORDER BY date
           ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS cma
       FROM panel WINDOW w AS (PARTITION BY uid ORDER BY date)),
tl AS (SELECT *, (t - 1) % 7 AS pos, y - mean AS dev,
         CASE WHEN t > 3 AND t <= n - 3 THEN
           CASE WHEN low > 0 THEN y / cma ELSE y - cma END END AS raw,
         lag(y, 1) OVER w - mean AS d1, lag(y, 2) OVER w - mean AS d2, lag(y, 3) OVER w - mean AS d3,
         lag(y, 4) OVER w - mean AS d4, lag(y, 5) OVER w - mean AS d5, lag(y, 6) OVER w - mean AS d6,
         lag(y, 7) OVER w - mean AS d7
       FROM tb WINDOW w AS (PARTITION BY uid ORDER BY date)),
ta AS (SELECT uid, max(n) AS n, min(low) AS low, sum(dev * dev) AS ss, sum(dev * d1) AS c1,
         sum(dev * d2) AS c2, sum(dev * d3) AS c3, sum(dev * d4) AS c4, sum(dev * d5) AS c5,
         sum(dev * d6) AS c6, sum(dev * d7) AS c7 FROM tl GROUP BY 1),
tt AS (SELECT uid, n, low, coalesce(n >= 14 AND abs(c7 / nullif(ss, 0)) > 1.645 * sqrt((1 + 2 * (c1*c1 + c2*c2 +
         c3*c3 + c4*c4 + c5*c5 + c6*c6) / nullif(ss * ss, 0)) / n), false) AS seasonal FROM ta),
tp AS (SELECT uid, pos, avg(raw) AS a FROM tl GROUP BY 1, 2),
tx AS (SELECT uid, pos, CASE WHEN NOT seasonal THEN CASE WHEN low > 0 THEN 1.0 ELSE 0.0 END
         WHEN low > 0 THEN a / avg(a) OVER (PARTITION BY uid)
         ELSE a - avg(a) OVER (PARTITION BY uid) END AS idx FROM tp JOIN tt USING (uid)),
tz AS (SELECT l.uid, l.t, CASE WHEN l.low > 0 THEN y / idx ELSE y - idx END AS z
       FROM tl l JOIN tx x ON x.uid = l.uid AND x.pos = l.pos),
ts AS (SELECT uid, regr_slope(z, t) AS slope, count(*) AS n FROM tz GROUP BY 1),
tg AS (SELECT unnest(range(1, 20)) * 0.05 AS a),
tr AS (SELECT uid, a, t, z AS l, CAST(0 AS DOUBLE) AS sse FROM tz, tg WHERE t = 1
  UNION ALL SELECT r.uid, r.a, z.t, r.l + r.a * (z.z - r.l), r.sse + (z.z - r.l) * (z.z - r.l)
    FROM tr r JOIN tz z ON z.uid = r.uid AND z.t = r.t + 1),
te AS (SELECT uid, arg_min(a, sse) AS a, arg_min(l, sse) AS l FROM tr JOIN ts USING (uid)
       WHERE tr.t = ts.n GROUP BY 1),
theta AS (SELECT uid, ds, step, CASE WHEN low > 0 THEN (l + d) * idx ELSE l + d + idx END AS forecast
        FROM (SELECT h.uid, h.ds, h.step, e.l, x.idx, tt.low, s.slope / 2 *
            ((h.step - 1) + 1 / e.a - pow(1 - e.a, s.n) / e.a) AS d
          FROM ah h JOIN te e USING (uid) JOIN ts s USING (uid) JOIN tt USING (uid)
          JOIN tx x ON x.uid = h.uid AND x.pos = (s.n + h.step - 1) % 7))"""


@query(
    "theta_forecast",
    sql(
        f"SELECT uid AS unique_id, {day('ds')}, {rnd('forecast', 'forecast', 3)} FROM theta",
        AHEAD,
        THETA_SQL,
        recursive=True,
    ),
)
def _(spark, folder):
    return tidy(theta(long_panel(spark, folder), DAYS), 3)


ETS_SQL = """
ey AS (SELECT uid, sales AS y, row_number() OVER (PARTITION BY uid ORDER BY date) AS t,
         count(*) OVER (PARTITION BY uid) AS n FROM panel),
ei AS (SELECT uid, max(n) AS n, avg(y) FILTER (t <= 7) AS m1,
         (avg(y) FILTER (t BETWEEN 8 AND 14) - avg(y) FILTER (t <= 7)) / 7 AS b0,
         list(y ORDER BY t) FILTER (t <= 7) AS season FROM ey GROUP BY 1),
ec AS (SELECT 'ANN' AS kind, 3 AS k, a, 0.0 AS b, 0.0 AS g
         FROM unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS t(a)
  UNION ALL SELECT 'AAN', 5, a, b, 0.0
         FROM unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS t(a), unnest([0.01, 0.05, 0.1]) AS u(b)
  UNION ALL SELECT 'AAA', 12, a, b, g FROM unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS t(a),
         unnest([0.01, 0.05, 0.1]) AS u(b), unnest([0.05, 0.1]) AS v(g)),
er AS (SELECT uid, kind, k, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b,
         CAST(g AS DOUBLE) AS g, CAST(0 AS BIGINT) AS t,
         CASE kind WHEN 'ANN' THEN m1 ELSE m1 - b0 * 4.0 END AS l,
         CASE kind WHEN 'ANN' THEN 0.0 ELSE b0 END AS s,
         CASE kind WHEN 'AAA' THEN list_transform(season, lambda x: x - m1)
           ELSE [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] END AS c,
         CAST(0 AS DOUBLE) AS sse FROM ei, ec
  UNION ALL SELECT r.uid, kind, k, a, b, g, r.t + 1, l + s + a * (y.y - l - s - c[1]),
         s + b * (y.y - l - s - c[1]), list_append(c[2:7], c[1] + g * (y.y - l - s - c[1])),
         sse + (y.y - l - s - c[1]) * (y.y - l - s - c[1])
       FROM er r JOIN ey y ON y.uid = r.uid AND y.t = r.t + 1),
eb AS (SELECT uid, arg_min({'kind': kind, 'l': l, 's': s, 'c': c}, n * ln(greatest(sse / n, 1e-12))
         + 2 * k + 2.0 * k * (k + 1) / (n - k - 1)) AS f
       FROM er JOIN ei USING (uid) WHERE er.t = ei.n GROUP BY 1)"""


@query(
    "ets_grid_forecast",
    sql(
        f"""SELECT a.uid AS unique_id, {day('a.ds', 'ds')}, f.kind AS kind,
        {rnd('f.l + f.s * a.step + f.c[(a.step - 1) % 7 + 1]', 'forecast', 3)}
        FROM ah a JOIN eb USING (uid)""",
        AHEAD,
        ETS_SQL,
        recursive=True,
    ),
)
def _(spark, folder):
    return tidy(ets(long_panel(spark, folder), DAYS), 3)


def per_cutoff(part: str) -> str:
    """A forecast's SQL over the history up to each cutoff (``cvp``) and the days after it (``cva``)."""
    return part.replace("FROM panel", "FROM cvp").replace("FROM ah", "FROM cva")


NAIVE_CV_SQL = """
cc AS (SELECT (SELECT hi FROM rng) - CAST(16 + 8 * i AS INTEGER) AS cutoff
       FROM (SELECT unnest(range(0, 3)) AS i)),
nv AS MATERIALIZED (SELECT p.uid, p.date, c.cutoff, p.sales AS y, n.sales AS naive, s.sales AS snaive
       FROM cc c JOIN panel p ON p.date > c.cutoff AND p.date <= c.cutoff + 16
       JOIN panel n ON n.uid = p.uid AND n.date = c.cutoff
       JOIN panel s ON s.uid = p.uid AND s.date = c.cutoff - 6
         + CAST((date_diff('day', c.cutoff, p.date) - 1) % 7 AS INTEGER))"""
CV_SQL = f"""{NAIVE_CV_SQL},
cw AS (SELECT cutoff FROM cc UNION ALL SELECT hi FROM rng),
cvp AS MATERIALIZED (SELECT concat(p.uid, '@', c.cutoff) AS uid, p.date, p.sales
       FROM panel p JOIN cw c ON p.date <= c.cutoff),
cva AS (SELECT concat(uid, '@', cutoff) AS uid, step, cutoff + CAST(step AS INTEGER) AS ds
       FROM (SELECT DISTINCT uid FROM panel), cw, (SELECT unnest(range(1, 17)) AS step)),
{per_cutoff(THETA_SQL)},{per_cutoff(ETS_SQL)},
ets AS (SELECT a.uid, a.ds, f.l + f.s * a.step + f.c[(a.step - 1) % 7 + 1] AS forecast FROM cva a JOIN eb USING (uid)),
cv AS MATERIALIZED (SELECT nv.*, t.forecast AS theta, e.forecast AS ets FROM nv
       JOIN theta t ON t.uid = concat(nv.uid, '@', nv.cutoff) AND t.ds = nv.date
       JOIN ets e ON e.uid = t.uid AND e.ds = t.ds)"""
# fixed values: candidates of the cross-validation and their columns in the SQL
CANDIDATES = {"Naive": "naive", "SeasonalNaive": "snaive", "Theta": "theta", "AutoETS": "ets"}


def cv_rmsle(col: str) -> str:
    return f"sqrt(avg(pow(ln(1 + y) - ln(1 + greatest({col}, 0)), 2)))"


BOARD_SQL = "board AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, {cv_rmsle(c)} AS rmsle FROM cv" for m, c in CANDIDATES.items()
) + ")"


def _cv(spark, folder):
    long = long_panel(spark, folder, stored=True)
    return cross_validate(long, DAYS, list(CANDIDATES), n_windows=3, step=8)


@query(
    "rolling_origin_cv",
    sql(
        f"""SELECT uid AS unique_id, {day('date', 'ds')}, {day('cutoff')}, y, naive AS "Naive",
        snaive AS "SeasonalNaive", {rnd('theta', '"Theta"', 3)}, {rnd('ets', '"AutoETS"', 3)} FROM cv""",
        CV_SQL,
        recursive=True,
    ),
)
def _(spark, folder):
    return tidy(_cv(spark, folder), Theta=3, AutoETS=3)


@query(
    "score_models",
    sql(f"SELECT model, {rnd('rmsle', 'rmsle')} FROM board", CV_SQL, BOARD_SQL, recursive=True),
)
def _(spark, folder):
    return tidy(score_models(_cv(spark, folder), list(CANDIDATES)))


@query(
    "cv_summary",
    sql(
        f"""SELECT {rnd('avg(r)', 'mean')}, {rnd('stddev_pop(r)', 'std')}, {rnd('min(r)', 'min')},
        {rnd('max(r)', 'max')} FROM (SELECT cutoff, {cv_rmsle('snaive')} AS r FROM nv GROUP BY 1)""",
        NAIVE_CV_SQL,
    ),
)
def _(spark, folder):
    cv = cross_validate(long_panel(spark, folder, stored=True), DAYS, ["SeasonalNaive"], n_windows=3, step=8)
    per_window = row_metrics(cv, "y", "SeasonalNaive", by=["cutoff"])
    return tidy(cv_summary(per_window, "rmsle"))


WINNER_SQL = """
picked AS (SELECT w.model, h.uid, h.ds, CASE w.model WHEN 'Naive' THEN n.sales
         WHEN 'SeasonalNaive' THEN s.sales WHEN 'Theta' THEN t.forecast ELSE e.forecast END AS forecast
       FROM (SELECT model FROM board ORDER BY rmsle, model LIMIT 1) w, ah h
       JOIN panel n ON n.uid = h.uid AND n.date = (SELECT hi FROM rng)
       JOIN panel s ON s.uid = h.uid
         AND s.date = (SELECT hi FROM rng) - 6 + CAST((h.step - 1) % 7 AS INTEGER)
       JOIN theta t ON t.uid = concat(h.uid, '@', (SELECT hi FROM rng)) AND t.ds = h.ds
       JOIN ets e ON e.uid = t.uid AND e.ds = t.ds)"""


@query(
    "cv_winner_refit",
    sql(
        f"SELECT model, uid AS unique_id, {day('ds')}, {rnd('forecast', 'forecast', 3)} FROM picked",
        CV_SQL,
        BOARD_SQL,
        AHEAD,
        WINNER_SQL,
        recursive=True,
    ),
)
def _(spark, folder):
    winner, out = refit_winner(
        long_panel(spark, folder, stored=True), DAYS, list(CANDIDATES), n_windows=3, step=8
    )
    return tidy(out.withColumn("model", F.lit(winner)), 3)


@query(
    "forecast_to_submission",
    sql(
        """SELECT id, CASE WHEN store_nbr = 4 THEN 0.0 ELSE predicted END AS sales,
        store_nbr = 4 AS is_cold_start FROM preds""",
        PREDS,
    ),
)
def _(spark, folder):
    """Store 4 has no history: its rows get zero and are marked."""
    long = long_panel(spark, folder, stored=True)
    train, val = timeseries_split(long, DAYS, "ds")
    fc = seasonal_naive(train.filter("store_nbr <> 4"), DAYS)
    rows = forecast_on_rows(val.select("id", "unique_id", "ds"), fc)
    return tidy(rows.select("id", F.col("predicted").alias("sales"), "is_cold_start"))


@query("submission_rows", sql("SELECT id, predicted AS sales FROM preds", PREDS))
def _(spark, folder):
    t = retail_tables(spark, folder)
    uid = F.concat_ws("_", "store_nbr", "family").alias("unique_id")
    hist = t["train"].select(uid, F.col("date").alias("ds"), F.col("sales").alias("y"))
    future = t["test"].select(uid, F.col("date").alias("ds"), "id")
    return tidy(to_submission(future, forecast(hist, DAYS, ["SeasonalNaive"]), "SeasonalNaive"))


@query("holdout_score", sql(f"SELECT {rnd(RMSLE, 'rmsle')} FROM preds", PREDS))
def _(spark, folder):
    return tidy(holdout_score(long_panel(spark, folder, stored=True), "SeasonalNaive", DAYS))


def repeat_last_week(values: np.ndarray, known: np.ndarray, horizon: int) -> np.ndarray:
    """Stand-in for an outside model: the last seven days again."""
    return values[:, -7:][:, np.arange(horizon) % 7]


@query(
    "panel_batch_scoring",
    sql(
        f"""SELECT a.uid AS unique_id, {day('a.ds', 'ds')},
        CAST(p.sales AS FLOAT)::DOUBLE AS forecast FROM ah a JOIN panel p ON p.uid = a.uid
          AND p.date = (SELECT hi FROM rng) - 6 + CAST((a.step - 1) % 7 AS INTEGER)""",
        AHEAD,
    ),
)
def _(spark, folder):
    out = panel_batch_forecast(
        long_panel(spark, folder, stored=True), DAYS, repeat_last_week, 768, chunk=8)
    return tidy(out)
