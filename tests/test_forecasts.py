import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.operators.batch import panel_batch_forecast
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
from demandgrid.operators.smoothing import additive_path, ses_path
from demandgrid.plans.panel import densify


def long(panel):
    return panel.select(
        F.concat_ws("_", "store_nbr", "family").alias("unique_id"), F.col("date").alias("ds"),
        F.col("sales").alias("y"), "id",
    )


def path(df, name="forecast"):
    return [r[name] for r in df.orderBy("unique_id", "ds").collect()]


def test_naive_and_seasonal(panel_of):
    h = long(panel_of({(1, "A"): range(10), (2, "A"): [4, 5]}))
    assert path(naive(h, 2)) == [9, 9, 5, 5]
    got = path(seasonal_naive(h, 9).filter("unique_id = '1_A'"))
    assert got == [3, 4, 5, 6, 7, 8, 9, 3, 4]
    assert path(seasonal_naive(h, 1).filter("unique_id = '2_A'")) == [None]
    keys = future_keys(h, 3).filter("unique_id = '2_A'").orderBy("step").collect()
    assert [r["ds"] for r in keys] == [dt.date(2017, 1, d) for d in (3, 4, 5)]


def test_theta_of_a_line_keeps_rising(panel_of):
    h = long(panel_of({(1, "A"): [2.0 * i + 10 for i in range(60)]}))
    got = path(theta(h, 5))
    assert np.all(np.diff(got) == pytest.approx(1.0)) and got[0] > 120


def test_theta_matches_a_loop(panel_of):
    y = np.random.default_rng(3).normal(100, 5, 40)  # no weekly correlation
    grid = [0.1, 0.5, 0.9]
    best = None
    for a in grid:
        level, sse = y[0], 0.0
        for v in y[1:]:
            sse += (v - level) ** 2
            level += a * (v - level)
        best = min(best, (sse, a, level)) if best else (sse, a, level)
    _, a, level = best
    slope, n = np.polyfit(np.arange(1, 41), y, 1)[0], len(y)
    want = [level + slope / 2 * (k + 1 / a - (1 - a) ** n / a) for k in range(3)]
    got = path(theta(long(panel_of({(1, "A"): y})), 3, alphas=grid))
    season = np.abs(np.array(got) - want).max()
    assert season < 1e-6


def test_ets_follows_trend_and_season(panel_of):
    week = [0, 5, 9, 3, -2, -6, -9]
    y = [50 + 0.5 * i + week[i % 7] for i in range(84)]
    got = path(ets(long(panel_of({(1, "A"): y, (2, "A"): [7.0, 7.0]})), 7))
    want = [50 + 0.5 * i + week[i % 7] for i in range(84, 91)]
    assert np.abs(np.array(got[:7]) - want).max() < 1.0
    assert got[7:] == [7.0] * 7  # too short for a season: level only


def test_smoothing_blocks_respect_lengths():
    y = np.array([[1.0, 2, 3, 4], [5, 6, np.nan, np.nan]])
    level, sse = ses_path(y, np.array([4, 2]), np.array([0.5]))
    assert level[1, 0] == 5.5 and sse[1, 0] == 1.0
    z = np.vstack([np.tile([1.0, 3.0], 4), np.append(np.tile([1.0, 3.0], 3), [np.nan] * 2)])
    level, _, ahead, sse = additive_path(
        z, np.array([8, 6]), 2, np.array([[0.1, 0.1, 0.1]]), True, True
    )
    assert np.allclose(sse, 0) and np.allclose(ahead[:, :, 0], [[-1, 1], [-1, 1]])
    assert np.allclose(level, 2.0)


def test_unknown_model(panel_of):
    with pytest.raises(ValueError, match="Prophet"):
        forecast(long(panel_of({(1, "A"): [1]})), 1, ["Prophet"])


def test_cv_hides_the_future(panel_of):
    h = long(panel_of({(1, "A"): range(60)}))
    cv = cross_validate(h, 5, ["Naive", "SeasonalNaive"], n_windows=2, step=5)
    rows = cv.orderBy("cutoff", "ds").collect()
    assert len(rows) == 10 and {r["Naive"] for r in rows} == {49.0, 54.0}
    assert all(r["ds"] > r["cutoff"] for r in rows)
    assert [r["y"] for r in rows] == [float(v) for v in range(50, 60)]


def test_cv_of_smoothing_models_equals_a_forecast_per_cutoff(panel_of):
    rng = np.random.default_rng(4)
    week = [9, 4, 6, 2, 8, 1, 5]
    made = {(s, "A"): [10 * s + week[i % 7] + rng.normal() + 0.05 * i for i in range(n)] for s, n in ((1, 90), (2, 70))}
    h = long(panel_of(made)).cache()
    models = ["Theta", "AutoETS", "Naive"]
    cv = cross_validate(h, 5, models, n_windows=3, step=4)
    rows = cv.collect()
    cutoffs = sorted({r["cutoff"] for r in rows})
    assert len(cutoffs) == 3
    got = {(r["cutoff"], r["unique_id"], r["ds"]): [r[m] for m in models] for r in rows}
    want = {}
    for c in cutoffs:
        for r in forecast(h.filter(F.col("ds") <= F.lit(c)), 5, models).collect():
            want[c, r["unique_id"], r["ds"]] = [r[m] for m in models]
    assert set(got) <= set(want)  # a forecast beyond the known days has nothing to be scored on
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_cv_exchanges_history_once_by_series(panel_of):
    h = long(panel_of({(1, "A"): range(60)}))
    plan = cross_validate(h, 5, ["Theta", "AutoETS"], n_windows=3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(unique_id" in plan
    # the forecasts alone, a row a day ahead, are exchanged by series and cutoff
    assert plan.count("hashpartitioning(unique_id#") - plan.count("REPARTITION_BY_COL") <= 4


def test_winner_is_refitted_on_everything(panel_of):
    week = [1, 9, 2, 8, 3, 7, 4]
    h = long(panel_of({(1, "A"): [week[i % 7] for i in range(70)]}))
    name, out = refit_winner(h, 7, ["Naive", "SeasonalNaive"])
    assert name == "SeasonalNaive" and path(out) == week
    assert holdout_score(h, "SeasonalNaive", 7).head()["rmsle"] == 0


def test_submission_fills_and_marks_cold_starts(panel_of, spark):
    h = long(panel_of({(1, "A"): [1, 2, -3]}))
    rows = spark.createDataFrame(
        [(8, "1_A", dt.date(2017, 1, 4)), (7, "9_Z", dt.date(2017, 1, 4)),
         (9, "1_A", dt.date(2017, 3, 1))],
        "id bigint, unique_id string, ds date",
    )
    fc = naive(h, 2)
    assert [tuple(r) for r in to_submission(rows, fc).collect()] == [(7, 0.0), (8, 0.0), (9, 0.0)]
    marks = {r["id"]: r["is_cold_start"] for r in forecast_on_rows(rows, fc).collect()}
    assert marks == {7: True, 8: False, 9: False}


def test_batch_scoring_maps_chunks_back(panel_of):
    data = {(s, f): [100.0 * s + (d % 7) for d in range(80)] for s in (1, 2, 3) for f in "AB"}
    h = long(panel_of(data))
    seen = []

    def score(values, known, horizon):
        assert values.shape[1] == 64 and values.shape[0] <= 4 and known.all()
        return values[:, -horizon:] - 150

    out = panel_batch_forecast(h, 3, score, context_length=70, chunk=4)
    got = {(r["unique_id"], r["ds"]): r["forecast"] for r in out.collect()}
    assert len(got) == 18 and seen == []
    assert got[("3_A", dt.date(2017, 3, 22))] == 300 + 77 % 7 - 150
    assert got[("1_B", dt.date(2017, 3, 22))] == 0  # negative values are clamped


def test_batch_scoring_masks_missing_days(panel_of):
    h = long(panel_of({(1, "A"): range(32), (2, "A"): range(32)}))
    h = h.filter("not (unique_id = '2_A' and y < 30)")

    def score(values, known, horizon):
        return known.sum(axis=1, keepdims=True).repeat(horizon, axis=1)

    out = panel_batch_forecast(h, 1, score, None)
    assert {r["unique_id"]: r["forecast"] for r in out.collect()} == {"1_A": 32.0, "2_A": 2.0}


def test_densify_fills_every_day(spark):
    facts = spark.createDataFrame(
        [(1, "A", dt.date(2017, 1, 3), 5.0, 1), (1, "A", dt.date(2017, 1, 5), 7.0, 0),
         (2, "A", dt.date(2017, 1, 1), 1.0, 0)],
        "store_nbr bigint, family string, date date, sales double, onpromotion bigint",
    )
    ends = [F.lit(d).cast("date") for d in ("2017-01-01", "2017-01-06")]
    rows = densify(facts, *ends).orderBy("store_nbr", "date").collect()
    assert [r["sales"] for r in rows] == [0, 0, 5, 0, 7, 0, 1, 0, 0, 0, 0, 0]
