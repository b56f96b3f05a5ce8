"""Matrix-free linear fits against dense normal equations and Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.operators import wide
from demandgrid.operators.wide import fit_wide, numbered_levels


def table(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 400, n), rng.choice(["x", "y", "z"], n)
    x = rng.normal(size=n).round(3)
    eta = 0.3 * x + 0.002 * a + (b == "y") * 0.5
    y = rng.poisson(np.exp(eta)).astype(float)
    rows = [(int(i), str(j), float(v), float(w)) for i, j, v, w in zip(a, b, x, y)]
    rows += [(None, None, None, 2.0), (7, "x", 1.0, None)]
    return spark.createDataFrame(rows, "a long, b string, x double, y double").repartition(5), rows[:-1]


def dense(rows):
    la, lb = sorted({r[0] for r in rows if r[0] is not None}), sorted({r[1] for r in rows if r[1] is not None})
    m = np.zeros((len(rows), 2 + len(la) - 1 + len(lb) - 1))
    for i, (a, b, x, _) in enumerate(rows):
        m[i, 0], m[i, 1] = 1.0, x or 0.0
        if a is not None and a != la[0]:
            m[i, 1 + la.index(a)] = 1.0
        if b is not None and b != lb[0]:
            m[i, len(la) + lb.index(b)] = 1.0
    return m, np.array([r[3] for r in rows]), la, lb


def all_weights(model, la, lb):
    got = {c: {r["level"]: r["weight"] for r in t.collect()} for c, t in model.levels.items()}
    assert got["a"][la[0]] == 0.0 and got["b"][lb[0]] == 0.0
    return np.array([model.intercept, model.numbers["x"], *[got["a"][v] for v in la[1:]], *[got["b"][v] for v in lb[1:]]])


def test_levels_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(v,) for v in ["c", "b", "b", None, "a", "d"] * 3], "v string")
    got = {r["level"]: r["id"] for r in numbered_levels(df, "v").collect()}
    assert sorted(got) == ["a", "b", "c", "d"] and sorted(got.values()) == [0, 1, 2, 3] and got["a"] == 0
    assert numbered_levels(df.where("v is null"), "v").count() == 0


def test_wide_ridge_solves_the_normal_equations(spark):
    df, rows = table(spark)
    m, y, la, lb = dense(rows)
    pen = 3.0 * np.eye(m.shape[1])
    pen[0, 0] = 0.0
    want = np.linalg.lstsq(m.T @ m + pen, m.T @ y, rcond=None)[0]
    model = fit_wide(df, ["x"], ["a", "b"], "y", alpha=3.0)
    np.testing.assert_allclose(all_weights(model, la, lb), want, atol=1e-8)
    got = model.predict(df.where("y is not null")).select("a", "b", "x", "y", "predicted").collect()
    back = {(r["a"], r["b"], r["x"], r["y"]): r["predicted"] for r in got}
    assert all(abs(back[r] - p) < 1e-7 for r, p in zip(rows, m @ want))


@pytest.mark.parametrize("power", [1.0, 1.5])
def test_wide_tweedie_is_where_newton_ends(spark, power):
    df, rows = table(spark, 1500, 1)
    m, y, la, lb = dense(rows)
    pen = 0.01 * np.eye(m.shape[1])
    pen[0, 0] = 0.0
    beta = np.zeros(m.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(60):
        mu = np.exp(m @ beta)
        grad = m.T @ (mu ** (2 - power) - y * mu ** (1 - power)) / len(y) + pen @ beta
        hess = (m * (mu ** (2 - power))[:, None]).T @ m / len(y) + pen
        beta = beta - 0.7 * np.linalg.lstsq(hess, grad, rcond=None)[0]
    model = fit_wide(df, ["x"], ["a", "b"], "y", alpha=0.01, power=power)
    assert model.link == "log"
    np.testing.assert_allclose(all_weights(model, la, lb), beta, atol=1e-6)


def test_wide_fit_without_categories_or_rows(spark):
    df, rows = table(spark, 200)
    x, y = np.array([r[2] or 0.0 for r in rows]), np.array([r[3] for r in rows])
    w = ((x - x.mean()) @ (y - y.mean())) / ((x - x.mean()) @ (x - x.mean()) + 1.0)
    model = fit_wide(df, ["x"], [], "y")
    assert model.numbers["x"] == pytest.approx(w) and model.intercept == pytest.approx(y.mean() - w * x.mean())
    assert model.predict(df, "x").columns == ["a", "b", "y", "x"]
    with pytest.raises(ValueError):
        fit_wide(df.where(F.lit(False)), ["x"], ["a"], "y")


@pytest.mark.parametrize(("power", "names", "narrow", "most"), [(None, ["a", "b"], 2, 4), (1.5, ["a"], 1, 2)])
def test_coefficients_of_wide_categories_stay_in_tables(spark, monkeypatch, power, names, narrow, most):
    rows = [(i * i % 7, "xyz"[i % 3], float(i % 4), float(i % 5)) for i in range(40)] + [(None, None, None, 2.0)]
    df = spark.createDataFrame(rows, "a long, b string, x double, y double").coalesce(2)

    def fitted():
        model = fit_wide(df, ["x"], names, "y", alpha=2.0, power=power, steps=1)
        levels = [sorted(map(tuple, model.levels[c].collect())) for c in names]
        return [model.intercept, model.numbers["x"], *(w for t in levels for _, w in t)]

    want, held, state = fitted(), [], wide._State
    monkeypatch.setattr(wide, "_State", lambda beta, *rest: held.append(len(beta)) or state(beta, *rest))
    monkeypatch.setattr(wide, "NARROW", narrow)
    np.testing.assert_allclose(fitted(), want, atol=1e-8)
    assert max(held) == most  # arrays of the driver: intercept, x and the levels of a narrow b
