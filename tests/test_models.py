import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.operators import models
from demandgrid.operators.models import Linear
from demandgrid.operators.models import FittedPanelModel
from demandgrid.operators.encode import OneHot
from demandgrid.operators.recursive import recursive_forecast
from demandgrid.operators.models import TreeSettings, fit_ridge, fit_tweedie
from demandgrid.plans.boosted import BoostedSettings, boosted_forecast
from demandgrid.plans.runs import load_run_model, save_run_model
from demandgrid.plans.training import (
    direct_predictions,
    recursive_predictions,
    train_panel,
    walk_forward_evaluation,
)
from demandgrid.session import scratch_path
from demandgrid.settings import FeatureSettings, Roll

LAG1 = FeatureSettings(lags={"sales": (1,)})
FULL = FeatureSettings(
    date_features=("dayofweek", "time_step"),
    lags={"sales": (1, 7)},
    rolls=(Roll("sales", (7,), ("mean", "std", "min", "max", "median")),),
)


def horizon(panel_of, keys, start, days):
    return panel_of({k: [0] * days for k in keys}, start).drop("sales")


def by_day(df, store=1):
    rows = df.filter(F.col("store_nbr") == store).orderBy("date").collect()
    return [r["predicted"] for r in rows]


def design(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 2, 0.5]
    return x, rng


def test_ridge_matches_the_normal_equations(spark):
    x, rng = design(spark)
    y = x @ [2.0, -1.0, 0.5] + 3 + rng.normal(size=len(x))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                               "a double, b double, c double, y double")
    got = fit_ridge(df, ["a", "b", "c"], "y", 5.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(got.coefficients, want, atol=1e-9)
    assert got.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


@pytest.mark.parametrize("power", [1.0, 1.5])
def test_tweedie_matches_newton(spark, power):
    x, rng = design(spark, 300, 1)
    mu = np.exp(x @ [0.3, -0.2, 0.1] + 1)
    y = rng.poisson(mu).astype(float)  # zeros included
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                               "a double, b double, c double, y double")
    got = fit_tweedie(df, ["a", "b", "c"], "y", power, 0.3, tol=1e-12)
    z, b = np.c_[np.ones(len(x)), x], np.r_[np.log(y.mean()), 0, 0, 0]
    pen = np.diag([0, 0.3, 0.3, 0.3])
    for _ in range(200):
        m = np.exp(z @ b)
        grad = z.T @ (m ** (2 - power) - y * m ** (1 - power)) / len(y) + pen @ b
        hess = (z * (m ** (2 - power))[:, None]).T @ z / len(y) + pen
        b = b - 0.5 * np.linalg.solve(hess, grad)
    np.testing.assert_allclose([got.intercept, *got.coefficients], b, atol=1e-5)


def test_constant_series_stays_constant(panel_of):
    train = panel_of({(1, "A"): [10] * 40})
    run = train_panel(train, horizon(panel_of, [(1, "A")], dt.date(2017, 2, 10), 5), FULL,
                      "ridge", "log1p", val_days=5)
    out = by_day(recursive_predictions(run).filter("split = 'test'"))
    assert len(out) == 5 and all(abs(v - 10) < 2 and v >= 0 for v in out)


def test_alternating_series_alternates(panel_of):
    train = panel_of({(1, "A"): [10, 20] * 30})
    run = train_panel(train, horizon(panel_of, [(1, "A")], dt.date(2017, 3, 2), 4), LAG1,
                      "ridge", "raw", val_days=4)
    out = by_day(recursive_predictions(run).filter("split = 'test'"))
    assert out[0] < 15 < out[1] and out[2] < 15 < out[3]


def test_series_do_not_mix(panel_of):
    data = {(1, "A"): [10] * 40, (2, "A"): [100] * 40}
    test = horizon(panel_of, list(data), dt.date(2017, 2, 10), 5)
    run = train_panel(panel_of(data), test, FULL, "ridge", "log1p", val_days=5)
    out = recursive_predictions(run).filter("split = 'test'")
    assert np.mean(by_day(out, 2)) > 5 * np.mean(by_day(out, 1))


@pytest.mark.parametrize("kind", ["ridge", "trees"])
def test_recursion_matches_a_day_loop(panel_of, kind):
    """Direct scoring of day d on history plus the earlier predictions."""
    rng = np.random.default_rng(5)
    data = {(s, "A"): rng.integers(1, 30, 60).astype(float) for s in (1, 2)}
    data[(3, "A")] = np.array([4.0, 6.0])  # shorter than the longest lag
    days, start = 3, dt.date(2017, 3, 2)
    opts = {"trees": TreeSettings(n_estimators=3, max_depth=2, min_child_samples=2)}
    test = horizon(panel_of, list(data), start, days)
    run = train_panel(panel_of(data), test, FULL, kind, "raw", val_days=10,
                      options=opts if kind == "trees" else None)
    got = recursive_predictions(run).filter("split = 'test'").toPandas()
    assert len(got) == 9
    for store in (1, 2):
        values = list(data[(store, "A")])
        want = []
        for i in range(days):
            d = start + dt.timedelta(days=i)
            w = np.array(values[-7:])
            row = {
                "sales_lag_1": float(values[-1]), "sales_lag_7": float(values[-7]),
                "sales_roll_7_mean": float(w.mean()), "sales_roll_7_std": float(w.std(ddof=1)),
                "sales_roll_7_min": float(w.min()), "sales_roll_7_max": float(w.max()),
                "sales_roll_7_median": float(np.median(w)), "dayofweek": d.weekday(),
                "time_step": (d - dt.date(2017, 1, 1)).days, "onpromotion": 0,
                "store_nbr": store, "family": "A",
            }
            df = run.future.sparkSession.createDataFrame([row])
            p = run.model.predict(df).head()["predicted"]
            want.append(p)
            values.append(p)
        mine = got[got.store_nbr == store].sort_values("date")["predicted"]
        np.testing.assert_allclose(mine, want, atol=1e-8)


def test_first_step_equals_direct_prediction(panel_of):
    data = {(1, "A"): np.random.default_rng(2).integers(1, 30, 60).astype(float)}
    run = train_panel(panel_of(data), horizon(panel_of, list(data), dt.date(2017, 3, 2), 3),
                      FULL, "ridge", "log1p", val_days=4)
    direct = by_day(direct_predictions(run).filter("split = 'val'"))
    rolled = by_day(recursive_predictions(run).filter("split = 'val'"))
    assert direct[0] == pytest.approx(rolled[0])
    assert len(rolled) == 4


def test_label_can_not_be_a_feature(panel_of):
    from demandgrid.operators.models import fit_panel_model

    with pytest.raises(ValueError, match="label"):
        fit_panel_model(panel_of({(1, "A"): [1, 2]}), "ridge", "sales", [], ["sales"])
    with pytest.raises(ValueError, match="unknown"):
        fit_panel_model(panel_of({(1, "A"): [1, 2]}), "lasso", "sales", [], ["onpromotion"])


@pytest.mark.parametrize("kind", ["ridge", "trees"])
def test_stored_model_scores_the_same(spark, panel_of, kind):
    data = {(s, f): [s * 5 + i % 7 for i in range(40)] for s in (1, 2) for f in "AB"}
    opts = {"trees": TreeSettings(n_estimators=2, max_depth=2)} if kind == "trees" else None
    run = train_panel(panel_of(data), horizon(panel_of, list(data), dt.date(2017, 2, 10), 2),
                      FULL, kind, "raw", val_days=5, options=opts)
    folder = scratch_path(spark, "model")
    save_run_model(spark, run.model, folder)
    again = load_run_model(spark, folder)
    a = run.model.predict(run.known).select("id", "predicted")
    b = again.predict(run.known).select("id", "predicted")
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_walk_forward_table(panel_of):
    data = {(1, "A"): [10 + i % 7 for i in range(80)]}
    out = walk_forward_evaluation(
        panel_of(data), horizon(panel_of, list(data), dt.date(2017, 3, 22), 2), FULL, (7, 14, 500)
    )
    rows = {r["window"]: r for r in out.collect()}
    assert set(rows) == {"val_7d", "val_14d"}
    assert rows["val_7d"]["n_train"] == 72 and rows["val_7d"]["n_val"] == 7
    assert rows["val_14d"]["one_shot_rmsle"] < 0.2 and rows["val_14d"]["recursive_rmsle"] < 0.3


def test_boosted_panel_undoes_differences(panel_of):
    data = {(1, "A"): [float(3 * i) for i in range(60)], (2, "A"): [50.0] * 60}
    uid = F.concat_ws("_", "store_nbr", "family").alias("unique_id")
    hist = panel_of(data).select(uid, F.col("date").alias("ds"), F.col("sales").alias("y"))
    future = horizon(panel_of, list(data), dt.date(2017, 3, 2), 3).select(
        uid, F.col("date").alias("ds")
    )
    settings = BoostedSettings(
        lags=(1, 2), rolling={1: (3,)}, differences=(1,), date_features=("dayofweek",),
        trees=TreeSettings(n_estimators=20, learning_rate=0.5, max_depth=2, subsample=1.0,
                           colsample=1.0),
    )
    rows = boosted_forecast(hist, future, settings).orderBy("unique_id", "ds").collect()
    got = [r["forecast"] for r in rows]
    np.testing.assert_allclose(got, [180, 183, 186, 50, 50, 50], atol=0.5)


def test_recursion_keeps_weights_of_lags_that_are_known_ahead(spark, panel_of):
    """Intercept 1 and weight 5 on yesterday's promotions, which are 2: 11 each day."""
    linear = Linear(["onpromotion_lag_1"], [5.0], 1.0)
    model = FittedPanelModel(
        "ridge", "sales", "raw", (), ("onpromotion_lag_1",), OneHot({}, ["onpromotion_lag_1"]),
        linear=linear, history=("onpromotion_lag_1",),
    )
    settings = FeatureSettings(lags={"onpromotion": (1,)})
    days = panel_of({(1, "A"): [0, 0]}, dt.date(2017, 1, 4)).withColumn("onpromotion_lag_1", F.lit(2.0))
    got = recursive_forecast(model, panel_of({(1, "A"): [3, 4, 5]}), days, settings, "sales")
    assert [r["predicted"] for r in got.collect()] == [11.0, 11.0]


def test_boosted_panel_keeps_series_that_end_early_or_are_new(panel_of):
    data = {(1, "A"): range(1, 41), (2, "A"): range(1, 36)}
    uid = F.concat_ws("_", "store_nbr", "family").alias("unique_id")
    hist = panel_of(data).select(uid, F.col("date").alias("ds"), F.col("sales").alias("y"))
    ahead = panel_of({(s, "A"): [0] * 3 for s in (1, 2, 3)}, dt.date(2017, 2, 10))
    settings = BoostedSettings(
        lags=(1,), differences=(1,), date_features=(),
        trees=TreeSettings(n_estimators=1, max_depth=1, min_child_samples=1),
    )
    rows = boosted_forecast(hist, ahead.select(uid, F.col("date").alias("ds")), settings).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["unique_id"], r["ds"])):
        got.setdefault(r["unique_id"], []).append(r["forecast"])
    # every difference is 1: each series goes on from its own last value
    assert got == {"1_A": [41.0, 42.0, 43.0], "2_A": [36.0, 37.0, 38.0], "3_A": [1.0, 2.0, 3.0]}


def test_boosted_rows_are_dealt_by_their_size(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 8)
    assert models.few_tasks(rows, 3).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "CELLS", 600)
    assert models.few_tasks(rows, 3).rdd.getNumPartitions() == 5
    assert models.few_tasks(rows, 30).rdd.getNumPartitions() == 8  # never more than there are
    assert models.few_tasks(rows.limit(0), 3).count() == 0
