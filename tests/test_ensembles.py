"""Flat ensembles against Spark's own scores, log-link boosting against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.operators.ensembles import (
    FlatTrees, fit_log_trees, flat_trees, lag_term, predict_flat, window_term,
)
from demandgrid.operators.models import TreeSettings, fit_trees
from demandgrid.plans.boosted import BoostedSettings, boosted_forecast


def rows_of(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = rng.poisson(np.exp(0.5 + x[:, 0] + 0.4 * (x[:, 1] > 0)))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    return df, x, y.astype(float)


def test_flat_scores_are_those_of_the_model(spark):
    df, x, _ = rows_of(spark)
    model = fit_trees(df, ["a", "b", "c"], "y", TreeSettings(n_estimators=30, max_depth=5, min_child_samples=3))
    flat = flat_trees(spark, model)
    want = [r["_prediction"] for r in model.transform(df).select("_prediction").collect()]
    got = [r["p"] for r in predict_flat(df, flat, ["a", "b", "c"], "p").select("p").collect()]
    np.testing.assert_allclose(got, want, atol=1e-9)
    np.testing.assert_allclose(flat.predict(x), want, atol=1e-9)


def test_a_single_leaf_is_a_constant():
    flat = FlatTrees.from_rows(
        [{"tree": 0, "id": 0, "prediction": 2.0, "left": -1, "right": -1, "feature": 0, "threshold": 0.0}], [0.5], 1.0)
    assert flat.depth == 0 and flat.predict(np.zeros((3, 1))).tolist() == [2.0, 2.0, 2.0]


def plain_boosting(x, y, rounds, rate, power):
    """Stumps on one two-valued column: each side takes its own Newton step."""
    score = np.full(len(y), np.log(y.mean()))
    for _ in range(rounds):
        fall, rise = y * np.exp((1 - power) * score), np.exp((2 - power) * score)
        g, h = rise - fall, (2 - power) * rise + (power - 1) * fall
        for side in (x <= 0, x > 0):
            score[side] -= rate * g[side].sum() / h[side].sum()
    return np.exp(score)


@pytest.mark.parametrize("power", [1.0, 1.1, 1.5])
def test_log_boosting_takes_newton_steps(spark, power):
    df, x, y = rows_of(spark)
    side = df.withColumn("s", (F.col("b") > 0).cast("double"))
    one = TreeSettings(n_estimators=14, learning_rate=0.3, max_depth=1, min_child_samples=1, subsample=1.0, colsample=1.0)
    flat = fit_log_trees(side, ["s"], "y", one, power)
    got = flat.predict((x[:, 1] > 0).astype(float)[:, None])
    np.testing.assert_allclose(got, plain_boosting(x[:, 1], y, 14, 0.3, power), rtol=1e-9)


def test_log_boosting_lowers_the_deviance_and_stays_positive(spark):
    df, x, y = rows_of(spark, 600, 3)
    flat = fit_log_trees(df, ["a", "b", "c"], "y", TreeSettings(n_estimators=25, learning_rate=0.2, max_depth=3), 1.1)
    mu = flat.predict(x)
    half = lambda m: np.mean(m**0.9 / 0.9 + y * m**-0.1 / 0.1)
    assert (mu > 0).all() and half(mu) < half(np.full(len(y), y.mean())) - 0.2


def test_terms_see_only_known_values():
    a = np.array([[np.nan, 1.0, 2.0, 4.0], [np.nan, np.nan, np.nan, 3.0]])
    assert lag_term(2)(a)[0] == 2.0 and np.isnan(lag_term(9)(a)).all()
    np.testing.assert_allclose(window_term(3, "mean")(a), [7 / 3, 3.0])
    np.testing.assert_allclose(window_term(3, "mean", full=True)(a), [7 / 3, np.nan])
    np.testing.assert_allclose(window_term(2, "mean", lag=2, full=True)(a), [1.5, np.nan])
    np.testing.assert_allclose(window_term(3, "std")(a), [np.std([1, 2, 4], ddof=1), np.nan])


def test_tweedie_panel_follows_two_levels(spark):
    rows = [(u, f"2017-01-{d:02d}", float(v)) for u, v in (("a", 4), ("b", 40)) for d in range(1, 31)]
    hist = spark.createDataFrame(rows, "unique_id string, ds string, y double").withColumn("ds", F.to_date("ds"))
    ahead = hist.select("unique_id", F.date_add("ds", 30).alias("ds")).where("ds < '2017-02-03'")
    settings = BoostedSettings(
        lags=(1,), date_features=(), objective="tweedie",
        trees=TreeSettings(n_estimators=15, learning_rate=0.5, max_depth=1, min_child_samples=1, subsample=1.0, colsample=1.0))
    got = [r["forecast"] for r in boosted_forecast(hist, ahead, settings).orderBy("unique_id", "ds").collect()]
    np.testing.assert_allclose(got, [4.0] * (len(got) // 2) + [40.0] * (len(got) // 2), rtol=1e-3)
    with pytest.raises(ValueError):
        boosted_forecast(hist, ahead, BoostedSettings(objective="other"))
