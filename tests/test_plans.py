"""Physical plans: exchanges, pushdown and where Python runs."""

import re

import pytest
from pyspark.sql import functions as F

from demandgrid.operators.prep import recent_history
from demandgrid.operators.series import seasonal_naive
from demandgrid.operators.windows import history_features, lag_roll_features
from demandgrid.plans.panel import densify
from demandgrid.session import materialize
from demandgrid.settings import FeatureSettings, Roll

SET = FeatureSettings(
    lags={"sales": (1, 7)}, rolls=(Roll("sales", (7, 28), ("mean", "std", "min", "max")),)
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange hashpartitioning", plan(df)))


@pytest.fixture
def stored(panel_of):
    return materialize(panel_of({(1, "A"): range(60), (2, "A"): range(60)}))


def test_history_features_share_one_exchange(stored):
    rows = stored.withColumn("is_train", F.lit(True))
    out = history_features(rows, SET, "series")
    assert exchanges(out) == 1
    assert "Python" not in plan(out)


def test_dense_panel_keeps_its_partitioning_for_windows(stored):
    facts = stored.groupBy("store_nbr", "family", "date").agg(
        F.sum("sales").alias("sales"), F.sum("onpromotion").alias("onpromotion")
    )
    dense = densify(facts, F.lit("2017-01-01").cast("date"), F.lit("2017-03-31").cast("date"))
    # facts by (series, date), then by series once for the stretch and all features
    assert exchanges(lag_roll_features(dense, SET, "series")) == 2


def test_recent_history_prunes_the_scan(stored):
    text = plan(recent_history(stored.select("date", "sales"), 28))
    assert "ReadSchema: struct<date:date,sales:double>" in text
    assert re.search(r"DataFilters: \[isnotnull\(date[^]]*", text)


def test_last_season_limits_rows_before_the_shuffle(stored):
    long = stored.select(F.concat_ws("_", "store_nbr", "family").alias("unique_id"),
                         F.col("date").alias("ds"), F.col("sales").alias("y"))
    assert "WindowGroupLimit" in plan(seasonal_naive(long, 3))
