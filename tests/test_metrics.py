import math

import pytest
from pyspark.sql import functions as F

from demandgrid.functions.errors import clamp
from demandgrid.operators.metrics import (
    cv_summary,
    distinct_counts,
    global_rmsle,
    period_summaries,
    row_metrics,
    score_models,
    slice_scores,
    value_histogram,
    velocity_tiers,
)
from demandgrid.operators.quantiles import exact_quantiles


def pairs(spark, rows):
    return spark.createDataFrame(rows, "actual double, predicted double")


@pytest.mark.parametrize(
    "rows, check",
    [
        ([(1.0, 1.0), (5.0, 5.0)], lambda v: v == 0),
        ([(1.0, 2.0), (5.0, 6.0)], lambda v: v > 0),
        ([(0.0, -1.0)], lambda v: v == 0),
        ([(0.0, 0.0)], lambda v: v == 0),
    ],
)
def test_rmsle(spark, rows, check):
    assert check(global_rmsle(pairs(spark, rows)).head()["rmsle"])


def test_row_metrics_closed_form(spark):
    got = row_metrics(pairs(spark, [(10.0, 12.0), (20.0, 16.0)])).head()
    assert got["mae"] == pytest.approx(3.0)
    assert got["wmape"] == pytest.approx(0.2)
    assert got["bias_pct"] == pytest.approx(-2 / 30 * 100)
    assert got["rmse"] == pytest.approx(math.sqrt(10))


def test_zero_totals_use_the_floor(spark):
    got = row_metrics(pairs(spark, [(0.0, 1.0)])).head()
    assert got["wmape"] == pytest.approx(1e10)


def test_clamp_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (3.0,)], "p double")
    assert [r[0] for r in df.select(clamp(F.col("p"))).collect()] == [None, 0.0, 3.0]


def test_slices_share_sums_to_one_per_axis(spark, audit_preds):
    df = audit_preds.withColumn("dayofweek", F.weekday("date"))
    slices = slice_scores(df)
    assert {r["axis"] for r in slices.select("axis").distinct().collect()} == {
        "family", "store_nbr", "dayofweek",
    }
    for r in slices.groupBy("axis").agg(F.sum("sle_share").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)


def test_slices_keep_missing_values_in_the_total_only(spark):
    df = spark.createDataFrame(
        [("A", 1.0, 3.0), (None, 1.0, 3.0)], "family string, actual double, predicted double"
    )
    got = slice_scores(df).collect()
    assert [(r["slice"], round(r["sle_share"], 6)) for r in got] == [("A", 0.5)]


def test_tiers_are_tertiles(audit_history):
    got = {r["velocity_tier"]: r["count"] for r in
           velocity_tiers(audit_history).groupBy("velocity_tier").count().collect()}
    assert sum(got.values()) == 9 and set(got) == {"slow", "mid", "fast"}


def test_equal_series_are_all_mid(panel_of):
    tiers = velocity_tiers(panel_of({(s, "A"): [5, 5] for s in range(4)}))
    assert {r["velocity_tier"] for r in tiers.collect()} == {"mid"}


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 60_001])
def test_exact_quantiles_match_percentile(spark, n):
    # a third of the rows share one value
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.rand(7) * 100).alias("v")
    )
    df = df.cache()
    probs = [0.0, 0.2, 1 / 3, 0.5, 0.975, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = exact_quantiles(df, "v", probs, names).head()
    want = df.select(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).head()[0]
    assert [got[c] for c in names] == pytest.approx(want)


def test_exact_quantiles_by_group_ignore_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0)], "g string, v double"
    )
    got = {r["g"]: r["m"] for r in exact_quantiles(df, "v", [0.5], ["m"], by=["g"]).collect()}
    assert got == {"a": 2.0, "b": 5.0}


def test_score_models_and_summary(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 2.0, 0.0)], "y double, good double, bad double")
    got = [r["model"] for r in score_models(df, ["bad", "good"]).collect()]
    assert got == ["good", "bad"]
    s = cv_summary(spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double"), "v").head()
    assert (s["mean"], s["std"], s["min"], s["max"]) == (2.0, 1.0, 1.0, 3.0)


def test_histogram_counts_every_value(spark):
    df = spark.range(101).select((F.col("id") / 10).alias("v"))
    bins = value_histogram(df, "v", 10).collect()
    assert sum(r["n"] for r in bins) == 101 and max(r["bin"] for r in bins) == 9


def test_entropy_of_even_mix(spark):
    df = spark.createDataFrame(
        [("p", "A", 5.0, 1, 0, 40.0), ("p", "B", 5.0, 0, 0, 42.0)],
        "period string, family string, sales double, onpromotion int, is_holiday int,"
        " dcoilwtico double",
    )
    got = period_summaries(df).head()
    assert got["family_mix_entropy"] == pytest.approx(math.log(2))
    assert got["promotion_rate"] == 0.5 and got["oil_std"] == pytest.approx(math.sqrt(2))


def test_distinct_counts(panel_of):
    got = distinct_counts(panel_of({(1, "A"): [1, 2], (1, "B"): [3]})).head()
    assert (got["n_series"], got["n_dates"], got["n_stores"], got["n_families"]) == (2, 2, 1, 2)
