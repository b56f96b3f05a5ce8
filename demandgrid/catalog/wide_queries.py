"""Linear models over categories of any width, on the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.catalog.base import query, rnd, tidy
from demandgrid.operators.wide import fit_wide

# ridge on one category in closed form: given the intercept each level shrinks by itself
LEVELS = f"""WITH g AS (SELECT l_orderkey AS level, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
c AS (SELECT *, level = (SELECT min(level) FROM g) AS base FROM g),
b AS (SELECT sum(k * m) / sum(k) AS b FROM (SELECT m, CASE WHEN base THEN n ELSE n * 2.0 / (n + 2.0) END AS k FROM c))
SELECT level, {rnd('CASE WHEN base THEN 0 ELSE n * (m - b) / (n + 2.0) END', 'weight')}, {rnd('b', 'intercept')} FROM c, b"""


def _lines(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet")


@query("ridge_wide_levels", LEVELS)
def _(spark, folder):
    """A weight for every order: many more levels than a dense fit can hold."""
    model = fit_wide(_lines(spark, folder), [], ["l_orderkey"], "l_quantity", alpha=2.0)
    return tidy(model.levels["l_orderkey"].withColumn("intercept", F.lit(model.intercept)))


def _newton(steps: int) -> str:
    """Newton steps of a Tweedie fit (power 1.5) with two features, by Cramer's rule."""
    parts = []
    for i in range(steps):
        parts.append(f"""s{i} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, avg(r) AS g0,
          avg(r * x1) + 0.05 * any_value(b1) AS g1, avg(r * x2) + 0.05 * any_value(b2) AS g2, avg(w) AS a, avg(w * x1) AS b,
          avg(w * x2) AS c, avg(w * x1 * x1) + 0.05 AS e, avg(w * x1 * x2) AS f, avg(w * x2 * x2) + 0.05 AS k
        FROM (SELECT *, sqrt(mu) AS w, sqrt(mu) - y / sqrt(mu) AS r FROM (SELECT *, exp(b0 + b1 * x1 + b2 * x2) AS mu FROM x, n{i})))""")
        parts.append(f"""n{i + 1} AS (SELECT
          b0 - (g0 * (e * k - f * f) - b * (g1 * k - f * g2) + c * (g1 * f - e * g2)) / d AS b0,
          b1 - (a * (g1 * k - f * g2) - g0 * (b * k - f * c) + c * (b * g2 - g1 * c)) / d AS b1,
          b2 - (a * (e * g2 - g1 * f) - b * (b * g2 - g1 * c) + g0 * (b * f - e * c)) / d AS b2
        FROM (SELECT *, a * (e * k - f * f) - b * (b * k - f * c) + c * (b * f - e * c) AS d FROM s{i}))""")
    return ",\n".join(parts)


TWEEDIE = f"""WITH x AS MATERIALIZED (SELECT l_quantity AS y, l_discount AS x1,
    CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS x2 FROM lineitem),
n0 AS (SELECT ln(avg(y)) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM x),
{_newton(12)}
SELECT 'intercept' AS feature, {rnd('b0', 'weight')} FROM n12 UNION ALL
SELECT 'l_discount', {rnd('b1', 'weight')} FROM n12 UNION ALL SELECT 'l_linestatus_O', {rnd('b2', 'weight')} FROM n12"""


@query("tweedie_two_features", TWEEDIE)
def _(spark, folder):
    """Penalised log-link fit of a number and a category."""
    model = fit_wide(_lines(spark, folder), ["l_discount"], ["l_linestatus"], "l_quantity", alpha=0.05, power=1.5)
    found = model.levels["l_linestatus"].where("level = 'O'")
    out = found.select(F.concat(F.lit("l_linestatus_"), "level").alias("feature"), "weight")
    head = [("intercept", model.intercept), ("l_discount", model.numbers["l_discount"])]
    return tidy(out.unionByName(spark.createDataFrame(head, "feature string, weight double")))
