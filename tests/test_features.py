import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandgrid.operators.encode import OneHot, Ordinal, standardized
from demandgrid.operators.prep import union_with_origin
from demandgrid.operators.ranks import digest_bound, hashed_rank, series_position
from demandgrid.operators.windows import history_features, lag_roll_features
from demandgrid.plans.features import feature_roles, make_features
from demandgrid.settings import FeatureSettings, Roll

SET = FeatureSettings(
    lags={"sales": (1, 3)}, rolls=(Roll("sales", (3,), ("mean", "std", "min", "max", "median")),)
)


def noise(n, seed):
    return np.random.default_rng(seed).integers(0, 50, n).astype(float)


@pytest.mark.parametrize("strategy", ["series", "blocked"])
def test_lags_and_rolls_match_pandas(panel_of, strategy):
    data = {(1, "A"): noise(40, 1), (2, "A"): noise(25, 2)}
    out = lag_roll_features(panel_of(data), SET, strategy, block_rows=7)
    got = out.orderBy("store_nbr", "date").toPandas()
    for (store, _), v in data.items():
        rows = got[got.store_nbr == store]
        s = pd.Series(v)
        r = s.shift(1).rolling(3, min_periods=1)
        for name, want in {
            "sales_lag_1": s.shift(1), "sales_lag_3": s.shift(3),
            "sales_roll_3_mean": r.mean(), "sales_roll_3_std": r.std(),
            "sales_roll_3_min": r.min(), "sales_roll_3_max": r.max(),
            "sales_roll_3_median": r.median(),
        }.items():
            np.testing.assert_allclose(rows[name].to_numpy(float), want.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("strategy", ["series", "blocked"])
def test_first_row_goes_and_horizon_is_filled(panel_of, strategy):
    train = panel_of({(1, "A"): [10, 20, 30]})
    test = panel_of({(1, "A"): [0, 0]}, dt.date(2017, 1, 4)).drop("sales")
    s = FeatureSettings(lags={"sales": (1,)})
    out = history_features(union_with_origin(train, test), s, strategy).orderBy("date")
    assert [(r["is_train"], r["sales_lag_1"]) for r in out.collect()] == [
        (True, 10.0), (True, 20.0), (False, 30.0), (False, 30.0),
    ]


def test_without_lags_all_rows_stay(panel_of):
    train, test = make_features(
        panel_of({(1, "A"): [1, 2, 3]}),
        panel_of({(1, "A"): [0]}, dt.date(2017, 1, 4)).drop("sales"),
        FeatureSettings(date_features=("dayofweek",)),
    )
    assert train.count() == 3 and test.count() == 1
    assert "sales" not in test.columns


def test_no_look_ahead(panel_of):
    short = panel_of({(1, "A"): noise(20, 3)})
    long = panel_of({(1, "A"): np.concatenate([noise(20, 3), noise(10, 4)])})
    cut = F.lit("2017-01-20").cast("date")
    a = lag_roll_features(short, SET).filter(F.col("date") <= cut)
    b = lag_roll_features(long, SET).filter(F.col("date") <= cut)
    assert a.exceptAll(b).count() == 0


def test_target_never_becomes_a_feature(panel_of):
    df = panel_of({(1, "A"): [1, 2]}).withColumns(
        {"log_sales": F.lit(1.0), "transactions": F.lit(5), "type": F.lit("A")}
    )
    cat, num = feature_roles(df, SET)
    assert not {"sales", "log_sales", "transactions", "id"} & {*cat, *num}
    assert "type" in cat and "onpromotion" in num


def test_time_step_starts_at_the_first_training_day(panel_of):
    train, test = make_features(
        panel_of({(1, "A"): [1, 2, 3]}),
        panel_of({(1, "A"): [0]}, dt.date(2017, 1, 4)).drop("sales"),
        FeatureSettings(date_features=("time_step",)),
    )
    assert [r["time_step"] for r in train.orderBy("date").collect()] == [0, 1, 2]
    assert test.head()["time_step"] == 3


def test_onehot_drops_the_first_level(spark):
    fit = spark.createDataFrame([(1, "A", 1.0), (10, "B", 2.0), (2, "A", None)],
                                "store_nbr int, family string, x double")
    enc = OneHot.fit(fit, ["store_nbr", "family"], ["x"])
    assert enc.names == ["x", "store_nbr_2", "store_nbr_10", "family_B"]
    new = spark.createDataFrame([(3, "C", 7.0)], "store_nbr int, family string, extra double")
    assert list(enc.transform(new).head()) == [0.0, 0.0, 0.0, 0.0]


def test_ordinal_codes(spark):
    fit = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, None)], "t string, x double")
    enc = Ordinal.fit(fit, ["t", "x"])
    new = spark.createDataFrame([("a", 1.0), ("zz", None), (None, 3.0)], "t string, x double")
    got = new.select(*[e.alias(n) for n, e in enc.columns().items()]).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0), (-1.0, 0.0), (2.0, 3.0)]


def test_standardized_moments(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"))
    z = standardized(df, ["a", "b"]).toPandas()
    assert z["a"].mean() == pytest.approx(0) and z["a"].std(ddof=0) == pytest.approx(1)
    assert set(z["b"]) == {0.0}


def test_ranks_are_dense(spark, panel_of):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    got = sorted(r["r"] for r in hashed_rank(df, F.col("k"), ["k"], "r").collect())
    assert got == list(range(500))
    pos = series_position(panel_of({(1, "A"): range(50)}), ["store_nbr", "family"], "date", "p", 7)
    assert all(r["p"] == r["sales"] for r in pos.collect())


def test_sparse_vectors_hold_the_same_columns(spark):
    fit = spark.createDataFrame([(1, "A", 1.0), (10, "B", 2.0), (2, "A", None)],
                                "store_nbr int, family string, x double")
    enc = OneHot.fit(fit, ["store_nbr", "family"], ["x"])
    new = fit.unionByName(
        spark.createDataFrame([(3, "C", 7.0), (None, None, 1.0)], fit.schema)
    ).withColumn("id", F.monotonically_increasing_id())
    dense = {r["id"]: list(r)[1:] for r in enc.transform(new, keep=["id"]).collect()}
    sparse = {r["id"]: list(r["v"]) for r in enc.vectors(new, "v", keep=["id"]).collect()}
    assert dense == sparse and len(dense) == 5


@pytest.mark.parametrize("k", [1, 7, 250, 999, 1000, 1001])
def test_digest_bound_takes_exactly_the_smallest(spark, k):
    df = spark.range(1000).withColumn("d", F.md5(F.col("id").cast("string")))
    bound = digest_bound(df, "d", k)
    want = sorted(r["d"] for r in df.collect())[:k]
    assert sorted(r["d"] for r in df.filter(F.col("d") < bound).collect()) == want


def test_digest_bound_keeps_equal_digests_together(spark):
    df = spark.createDataFrame([("aa",)] * 3 + [("ab",)] * 3 + [("ac",)], "d string")
    assert df.filter(F.col("d") < digest_bound(df, "d", 2)).count() == 3
