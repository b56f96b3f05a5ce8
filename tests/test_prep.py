import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandgrid.operators.joins import holiday_distance, merge_dimensions, oil_by_date
from demandgrid.operators.prep import (
    display_window,
    to_wide,
    trim_context,
    trim_pre_activation_zeros,
    trim_stats,
)
from demandgrid.operators.splits import (
    filter_validation,
    timeseries_split,
    walk_forward_roles,
    walk_forward_split,
)
from demandgrid.settings import from_config


def values(df):
    return [r["sales"] for r in df.orderBy("store_nbr", "family", "date").collect()]


@pytest.mark.parametrize(
    "given, kept",
    [([0, 0, 5, 0, 3], [5, 0, 3]), ([0, 0, 0], [0, 0, 0]), ([1, 2, 3], [1, 2, 3])],
)
def test_trim_one_series(panel_of, given, kept):
    assert values(trim_pre_activation_zeros(panel_of({(1, "A"): given}))) == kept


def test_trim_counts_per_series(panel_of):
    df = panel_of({(1, "A"): [0, 0, 2], (2, "A"): [0, 0, 0], (3, "A"): [1, 0, 4]})
    assert trim_pre_activation_zeros(df).count() == 7
    got = trim_stats(df).head()
    assert (got["rows_dropped"], got["series_trimmed"], got["pct_dropped"]) == (2, 1, 22.22)


def test_trim_stats_of_nothing(panel_of):
    got = trim_stats(panel_of({})).head()
    assert tuple(got) == (0, 0, 0.0)


def test_trim_switch():
    assert not from_config({}).trim_pre_activation
    on = from_config({"preprocessing": {"trim_pre_activation_zeros": True}})
    assert on.trim_pre_activation


def test_config_reading():
    s = from_config(
        {
            "features": {
                "lag_features": [["log_sales", [1, 7]]],
                "rolling_features": [{"col": "log_sales", "windows": [7], "aggs": ["mean", "std"]}],
                "fourier_features": {"dayofweek": [1]},
            }
        }
    )
    assert s.history_names() == [
        "log_sales_lag_1", "log_sales_lag_7", "log_sales_roll_7_mean", "log_sales_roll_7_std",
    ]
    assert s.lookback() == 7


def test_split_on_distinct_dates(panel_of):
    df = panel_of({(1, "A"): range(20), (2, "A"): range(20)})
    train, val = timeseries_split(df, 5)
    assert train.count() == 30 and val.count() == 10
    assert val.agg(F.min("date")).head()[0] == dt.date(2017, 1, 16)


def test_walk_forward_skips_long_windows(panel_of):
    df = panel_of({(1, "A"): range(20)})
    labels = [(n, t.count(), v.count()) for t, v, n in walk_forward_split(df, [25, 5, 10, 5])]
    assert labels == [("val_5d", 15, 5), ("val_10d", 10, 10)]
    roles = walk_forward_roles(df, [5, 10, 20, 25]).groupBy("label", "role").count().collect()
    assert {(r["label"], r["role"], r["count"]) for r in roles} == {
        ("val_5d", "train", 15), ("val_5d", "val", 5),
        ("val_10d", "train", 10), ("val_10d", "val", 10),
    }
    with pytest.raises(ValueError):
        walk_forward_split(df, [20])


def test_holdout_prefers_val_rows(panel_of):
    df = panel_of({(1, "A"): range(10)})
    late = F.col("date") >= F.lit("2017-01-09").cast("date")
    labelled = df.withColumn("split", F.when(late, "val").otherwise("train"))
    assert filter_validation(labelled, 5).count() == 2
    only_train = df.withColumn("split", F.when(late, "test").otherwise("train"))
    got = filter_validation(only_train, 5)
    assert got.count() == 5 and got.agg(F.max("date")).head()[0] == dt.date(2017, 1, 8)
    assert filter_validation(only_train, 50).count() == 8
    assert filter_validation(only_train.filter("split = 'test'"), 5).count() == 0


def test_display_window_relabels(panel_of):
    df = panel_of({(1, "A"): range(30)})
    shown = display_window(df.withColumn("split", F.lit("train")), df, 5, 7)
    got = {r["split"]: r["count"] for r in shown.groupBy("split").count().collect()}
    assert got == {"train": 7, "val": 5}


def test_context_is_cut_from_the_oldest_side(panel_of):
    df = panel_of({(1, "A"): range(100)})
    kept = trim_context(df, None)
    assert kept.count() == 96 and kept.agg(F.min("sales")).head()[0] == 4
    assert trim_context(df, 70).agg(F.min("sales")).head()[0] == 36
    assert trim_context(df, 20).count() == 0


def test_oil_and_holiday_edges(spark):
    days = [dt.date(2017, 1, d) for d in range(1, 8)]
    spine = spark.createDataFrame([(d,) for d in days], "date date")
    oil = spark.createDataFrame([(days[1], 50.0), (days[3], None), (days[4], 60.0)],
                                "date date, dcoilwtico double")
    fill = lambda b: [r[1] for r in oil_by_date(spine, oil, b).orderBy("date").collect()]  # noqa
    assert fill(False) == [None, 50.0, 50.0, 50.0, 60.0, 60.0, 60.0]
    assert fill(True)[0] == 50.0
    hol = spark.createDataFrame([(days[2],), (days[4],), (days[4],)], "date date")
    got = [tuple(r)[1:] for r in holiday_distance(spine, hol).orderBy("date").collect()]
    # before the first and after the last holiday the distance turns negative
    assert got == [(-2, 2), (-1, 1), (0, 2), (1, 1), (0, 0), (1, -1), (2, -2)]


def test_merge_fills_missing_signals(spark, panel_of):
    train = panel_of({(1, "A"): [1, 2, 3]})
    test = panel_of({(1, "A"): [0]}, dt.date(2017, 1, 4)).drop("sales")
    day = dt.date(2017, 1, 2)
    tables = {
        "train": train,
        "test": test,
        "stores": spark.createDataFrame(
            [(2, "c", "s", "A", 1)],
            "store_nbr bigint, city string, state string, type string, cluster bigint",
        ),
        "oil": spark.createDataFrame([(day, 50.0)], "date date, dcoilwtico double"),
        "holidays": spark.createDataFrame([(day,), (day,)], "date date"),
        "transactions": spark.createDataFrame(
            [(day, 1, 9)], "date date, store_nbr bigint, transactions bigint"
        ),
    }
    a, b = merge_dimensions(tables)
    rows = a.orderBy("date").collect()
    assert len(rows) == 3  # the doubled holiday does not double rows
    assert [r["transactions"] for r in rows] == [-1, 9, -1]
    assert [r["is_holiday"] for r in rows] == [0, 1, 0]
    assert [r["type"] for r in rows] == [None] * 3
    # one fill runs over train and test dates
    assert b.head()["dcoilwtico"] == 50.0


def test_wide_layout(panel_of):
    df = panel_of({(1, "A"): range(5), (2, "B"): range(3)})
    long = df.select(F.concat_ws("_", "store_nbr", "family").alias("unique_id"),
                     F.col("date").alias("ds"), F.col("sales").alias("y"))
    wide = to_wide(long, ["1_A", "2_B"]).orderBy("ds")
    assert wide.columns == ["ds", "1_A", "2_B"] and wide.count() == 5
    assert wide.collect()[4]["2_B"] is None
