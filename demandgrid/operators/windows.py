"""Lag, rolling and forward-filled history features.

Two physical strategies give the same columns:

* ``series``, the default: one window per series. All columns share one exchange and one sort.
  Right whenever a series fits a task, which daily data always does (a row per calendar day).
* ``blocked``: rows are numbered inside their series and cut into blocks that carry a
  halo of the preceding ``lookback`` rows, so no task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from demandgrid.functions.arrays import median
from demandgrid.operators.ranks import series_position
from demandgrid.settings import FeatureSettings

BLOCK_ROWS = 8_192

# fixed values: statistic name -> value over a frame of preceding rows
ROLLING = {
    "mean": lambda col, frame: F.avg(col).over(frame),
    "std": lambda col, frame: F.stddev_samp(col).over(frame),
    "min": lambda col, frame: F.min(col).over(frame),
    "max": lambda col, frame: F.max(col).over(frame),
    # no built-in median takes a frame; the frame's few values are sorted instead
    "median": lambda col, frame: median(F.collect_list(col).over(frame)),
}


def history_columns(settings: FeatureSettings, w: WindowSpec) -> dict[str, Column]:
    """Lag and rolling expressions over one ordered window."""
    out: dict[str, Column] = {}
    for col, lags in settings.lags.items():
        for k in lags:
            out[f"{col}_lag_{k}"] = F.lag(col, k).over(w)
    for roll in settings.rolls:
        for size in roll.windows:
            frame = w.rowsBetween(-size, -1)
            for agg in roll.aggs:
                out[f"{roll.col}_roll_{size}_{agg}"] = ROLLING[agg](roll.col, frame)
    return out


def lag_roll_features(
    df: DataFrame,
    settings: FeatureSettings,
    strategy: str = "series",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` plus every configured lag and rolling column, NULL where there is no history."""
    keys, date = settings.keys, settings.date_col
    if strategy == "series":
        w = Window.partitionBy(*keys).orderBy(date)
        return df.withColumns(history_columns(settings, w))
    reach = settings.lookback()
    size = max(block_rows, reach)
    placed = series_position(df, keys, date, "_pos").withColumn(
        "_block", F.floor(F.col("_pos") / size)
    )
    copies = F.when(
        F.col("_pos") % size >= size - reach,
        F.array(
            F.struct(F.col("_block").alias("b"), F.lit(False).alias("halo")),
            F.struct((F.col("_block") + 1).alias("b"), F.lit(True).alias("halo")),
        ),
    ).otherwise(F.array(F.struct(F.col("_block").alias("b"), F.lit(False).alias("halo"))))
    w = Window.partitionBy(*keys, "_part").orderBy("_pos")
    return (
        placed.withColumn("_copy", F.explode(copies))
        .withColumn("_part", F.col("_copy.b"))
        .withColumns(history_columns(settings, w))
        .filter(~F.col("_copy.halo"))
        .drop("_pos", "_block", "_copy", "_part")
    )


def keep_rows_with_history(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop train rows whose history columns are all missing; without any keep all rows."""
    if not names:
        return df
    return df.filter(~F.col("is_train") | F.coalesce(*names).isNotNull())


def forward_fill(
    df: DataFrame,
    names: Sequence[str],
    keys: Sequence[str],
    date: str,
    strategy: str = "series",
    block_days: int = 8_192,
) -> DataFrame:
    """Last known value per series, then zero, for the named columns."""
    if not names:
        return df
    if strategy == "series":
        seen = (
            Window.partitionBy(*keys)
            .orderBy(date)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        return df.withColumns(
            {c: F.coalesce(F.last(c, ignorenulls=True).over(seen), F.lit(0.0)) for c in names}
        )
    chunk = F.floor(F.date_diff(F.col(date), F.lit("1970-01-01").cast("date")) / block_days)
    rows = df.withColumn("_chunk", chunk)
    newest = rows.groupBy(*keys, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(f"_end_{c}") for c in names]
    )
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = newest.select(
        *keys,
        "_chunk",
        *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in names],
    )
    seen = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(date)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = rows.join(carry, [*keys, "_chunk"])
    return joined.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(seen), F.col(f"_in_{c}"), F.lit(0.0))
            for c in names
        }
    ).select(*df.columns)


def history_features(
    combined: DataFrame, settings: FeatureSettings, strategy: str = "series"
) -> DataFrame:
    """Lags and rolling statistics, rows without history dropped, then gaps filled.

    ``combined`` holds train and test rows with an ``is_train`` flag. The order matters:
    rows are dropped before the fill, so no filled value can save them.
    """
    names = settings.history_names()
    rows = keep_rows_with_history(lag_roll_features(combined, settings, strategy), names)
    return forward_fill(rows, names, settings.keys, settings.date_col, strategy)
