"""Row selection and cleaning of the sales panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.operators.splits import nth_last_date

SERIES = ("store_nbr", "family")


def fill_missing(df: DataFrame) -> DataFrame:
    """Default values of optional columns, for those that are present."""
    # fixed values: what an absent value of each column means
    defaults = {
        "onpromotion": 0,
        "is_holiday": 0,
        "transactions": -1,
        "velocity_tier": "mid",
        "velocity_mean": 0.0,
    }
    return df.na.fill({c: v for c, v in defaults.items() if c in df.columns})


def subsample_stores(train: DataFrame, test: DataFrame, max_stores: int):
    """Keep the stores with the ``max_stores`` smallest numbers in both frames."""
    keep = train.select("store_nbr").distinct().orderBy("store_nbr").limit(max_stores)
    keep = F.broadcast(keep)  # at most max_stores rows
    return train.join(keep, "store_nbr", "left_semi"), test.join(keep, "store_nbr", "left_semi")


def since(df: DataFrame, start: str, date: str = "date") -> DataFrame:
    return df.filter(F.col(date) >= F.lit(start).cast("date"))


def with_first_sale(
    df: DataFrame, target: str = "sales", keys: Sequence[str] = SERIES, date: str = "date"
) -> DataFrame:
    """Adds ``first_sale``, the first date of a series with a positive target, or NULL.

    One aggregate with map-side combine; the join back is left to AQE, which splits a
    series that holds many rows. A row has sold by its date iff ``date >= first_sale``.
    """
    firsts = df.groupBy(*keys).agg(
        F.min(F.when(F.col(target) > 0, F.col(date))).alias("first_sale")
    )
    return df.join(firsts, list(keys), "left")


def sale_flags(df: DataFrame, target: str = "sales", date: str = "date") -> DataFrame:
    """``ever_sold`` of the series and the running ``has_sold`` of the row."""
    return (
        with_first_sale(df, target, date=date)
        .withColumn("ever_sold", F.col("first_sale").isNotNull())
        .withColumn("has_sold", F.coalesce(F.col(date) >= F.col("first_sale"), F.lit(False)))
        .drop("first_sale")
    )


def _active(date: str) -> Column:
    return F.col("first_sale").isNull() | (F.col(date) >= F.col("first_sale"))


def trim_pre_activation_zeros(
    train: DataFrame,
    target: str = "sales",
    keys: Sequence[str] = SERIES,
    date: str = "date",
) -> DataFrame:
    """Drop the rows of a series before its first sale; a never-sold series stays whole."""
    return with_first_sale(train, target, keys, date).filter(_active(date)).drop("first_sale")


def trim_stats(
    train: DataFrame,
    target: str = "sales",
    keys: Sequence[str] = SERIES,
    date: str = "date",
) -> DataFrame:
    """One row: rows dropped, series trimmed and percentage dropped."""
    marked = with_first_sale(train, target, keys, date)
    per_series = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(_active(date), 0).otherwise(1)).alias("_dropped"),
    )
    n, dropped = F.sum("_n"), F.coalesce(F.sum("_dropped"), F.lit(0))
    return per_series.agg(
        dropped.alias("rows_dropped"),
        F.coalesce(F.sum((F.col("_dropped") > 0).cast("bigint")), F.lit(0)).alias(
            "series_trimmed"
        ),
        F.coalesce(F.round(F.try_divide(dropped, n) * 100.0, 2), F.lit(0.0)).alias("pct_dropped"),
    )


def display_window(
    preds: DataFrame, train: DataFrame, val_days: int = 16, days_back: int = 120
) -> DataFrame:
    """Recent rows of a prediction frame; late train rows are relabelled ``val``."""
    start = nth_last_date(train, val_days)
    late = (F.col("split") == "train") & (F.col("date") >= start)
    return preds.filter(F.col("date") >= F.date_sub(start, days_back)).withColumn(
        "split", F.when(late, "val").otherwise(F.col("split"))
    )


def recent_history(df: DataFrame, lookback: int, date: str = "date") -> DataFrame:
    """Rows within ``lookback`` days of the latest date; the cutoff reaches the scan."""
    latest = df.agg(F.max(date).alias("d")).scalar()
    return df.filter(F.col(date) >= F.date_sub(latest, lookback))


def trim_context(
    df: DataFrame, context_length: int | None, date: str = "date", multiple: int = 32
) -> DataFrame:
    """Keep the newest dates, a multiple of ``multiple`` and at most ``context_length``.

    The cut is made on the distinct dates of the panel, oldest dropped first.
    """
    days = df.select(date).distinct()
    n = days.count() if context_length is None else days.limit(context_length).count()
    keep = n - n % multiple
    if keep == 0:
        return df.limit(0)
    return df.filter(F.col(date) >= nth_last_date(df, keep, date))


def union_with_origin(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test stacked by name, target NULL in test, with an ``is_train`` flag."""
    return train.withColumn("is_train", F.lit(True)).unionByName(
        test.withColumn("is_train", F.lit(False)), allowMissingColumns=True
    )


def split_by_origin(df: DataFrame, target: str = "sales") -> tuple[DataFrame, DataFrame]:
    return (
        df.filter("is_train").drop("is_train"),
        df.filter("not is_train").drop("is_train", target),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """DISTINCT on ``keys`` with the other columns, which the keys must determine."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols if c not in keys])


def to_long(
    df: DataFrame,
    store: str = "store_nbr",
    family: str = "family",
    date: str = "date",
    target: str = "sales",
) -> DataFrame:
    """``unique_id, ds[, y]`` plus keys, known exogenous columns and the row id."""
    keep = [store, family, "onpromotion", "id", "dcoilwtico", "is_holiday", "transactions"]
    cols = [F.concat_ws("_", store, family).alias("unique_id"), F.col(date).alias("ds")]
    if target in df.columns:
        cols.append(F.col(target).alias("y"))
        keep.remove("id")
    return df.select(*cols, *[c for c in keep if c in df.columns])


def future_exogenous(future: DataFrame) -> DataFrame:
    """Id, time and whatever exogenous columns the horizon frame has."""
    known = ("onpromotion", "dcoilwtico", "is_holiday", "transactions")
    return future.select("unique_id", "ds", *[c for c in known if c in future.columns])


def to_wide(long: DataFrame, series: Sequence[str]) -> DataFrame:
    """Date rows, one column per named series, summed; absent cells are NULL.

    The caller names the columns, which bounds the width; unlimited numbers of series
    stay in long form.
    """
    return long.groupBy("ds").pivot("unique_id", list(series)).agg(F.sum("y"))
