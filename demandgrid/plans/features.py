"""The full feature plan of a sales panel as one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.calendar import calendar_columns, fourier_columns
from demandgrid.operators.encode import categorical_columns
from demandgrid.operators.joins import calendar_spine, holiday_distance
from demandgrid.operators.prep import (
    fill_missing,
    split_by_origin,
    trim_pre_activation_zeros,
    union_with_origin,
)
from demandgrid.operators.windows import history_features
from demandgrid.settings import FeatureSettings

# fixed values: signals known ahead for the horizon, usable as features
KNOWN_AHEAD = ("onpromotion", "dcoilwtico", "is_holiday", "cluster")


def date_features(
    df: DataFrame,
    settings: FeatureSettings,
    ref_date,
    holidays: DataFrame | None,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Calendar, Fourier and holiday-distance columns.

    They depend on the date alone, so they are computed once per calendar day and joined
    as one broadcast table. ``spine`` names the days where they are known more cheaply
    than from ``df``.
    """
    date = settings.date_col
    spine = calendar_spine(df, date=date) if spine is None else spine
    day = F.col(date)
    cols = calendar_columns(day, settings.date_features, ref_date)
    cols |= fourier_columns(day, settings.fourier)
    if not cols and holidays is None:
        return df
    daily = spine.withColumns(cols) if cols else spine
    if holidays is not None:
        distance = holiday_distance(spine.withColumnRenamed(date, "date"), holidays)
        daily = daily.join(F.broadcast(distance.withColumnRenamed("date", date)), date, "left")
    return df.join(F.broadcast(daily), date, "left")


def combined_features(
    train: DataFrame,
    test: DataFrame,
    settings: FeatureSettings,
    holidays: DataFrame | None = None,
    strategy: str = "series",
) -> DataFrame:
    """Train and test rows with every feature and the ``is_train`` flag.

    History features are windows over both frames in one exchange; the target of the test
    rows is NULL, so nothing of the horizon leaks back.
    """
    spine = calendar_spine(train, test, date=settings.date_col)
    first = train.agg(F.min(settings.date_col).alias("d")).scalar()
    rows = union_with_origin(train, test)
    if settings.trim_pre_activation:
        rows = _trimmed(rows, settings, strategy)
        first = _first_kept_day(train, settings)
    rows = history_features(rows, settings, strategy)
    return fill_missing(date_features(rows, settings, first, holidays, spine))


def _first_kept_day(train: DataFrame, settings: FeatureSettings):
    """Earliest day that trimming leaves: from one row per series, no join."""
    date, y = settings.date_col, settings.target
    per_series = train.groupBy(*settings.keys).agg(
        F.min(date).alias("all"), F.min(F.when(F.col(y) > 0, F.col(date))).alias("sold")
    )
    return per_series.agg(F.min(F.coalesce("sold", "all")).alias("d")).scalar()


def _trimmed(rows: DataFrame, settings: FeatureSettings, strategy: str) -> DataFrame:
    """Train rows before a series' first sale dropped.

    As a window it shares the exchange of the history features that follow; with very
    long series the aggregate and join of the stand-alone operator is used.
    """
    keys, date, y = settings.keys, settings.date_col, settings.target
    if strategy != "series":
        train, test = rows.filter("is_train"), rows.filter("not is_train")
        return trim_pre_activation_zeros(train, y, keys, date).unionByName(test)
    sold = F.when(F.col("is_train") & (F.col(y) > 0), F.col(date))
    start = F.min(sold).over(Window.partitionBy(*keys))
    kept = ~F.col("is_train") | F.col("_first").isNull() | (F.col(date) >= F.col("_first"))
    return rows.withColumn("_first", start).filter(kept).drop("_first")


def make_features(
    train: DataFrame,
    test: DataFrame,
    settings: FeatureSettings,
    holidays: DataFrame | None = None,
    strategy: str = "series",
) -> tuple[DataFrame, DataFrame]:
    both = combined_features(train, test, settings, holidays, strategy)
    return split_by_origin(both, settings.target)


def feature_roles(df: DataFrame, settings: FeatureSettings) -> tuple[list[str], list[str]]:
    """(categorical, numeric) model inputs: an allow-list.

    The target, its transforms, ids and signals unknown ahead (traffic) can not get in.
    """
    dropped = {*settings.drop_cols, settings.target, "log_sales", "id", settings.date_col}
    dropped -= set(settings.keys)
    categorical = [
        c for c in categorical_columns(df, settings.keys) if c not in dropped and c != "split"
    ]
    made = [*settings.date_features, *fourier_columns(F.lit(None).cast("date"), settings.fourier)]
    made += ["days_since_holiday", "days_until_holiday", *settings.history_names()]
    numeric = [c for c in [*KNOWN_AHEAD, *made] if c in df.columns and c not in dropped]
    return categorical, numeric
