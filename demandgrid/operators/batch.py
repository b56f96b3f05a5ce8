"""Scoring a whole panel with an outside multivariate model, in bounded chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.errors import decode_target, encode_target
from demandgrid.operators.prep import trim_context
from demandgrid.operators.ranks import hashed_rank

# fixed value: series per scoring call
CHUNK = 256


def panel_batch_forecast(
    long: DataFrame,
    horizon: int,
    score: Callable[[np.ndarray, np.ndarray, int], np.ndarray],
    context_length: int | None = 768,
    chunk: int = CHUNK,
    transform: str = "raw",
    multiple: int = 32,
) -> DataFrame:
    """Apply ``score(values, known, horizon) -> medians`` to chunks of series.

    ``values`` is (series, days) float32 with zeros where ``known`` is False. Spark trims
    the context, numbers the days and deals the series into equal chunks; a task sees at
    most ``chunk`` x context values. Returns ``unique_id, ds, forecast``.
    """
    kept = trim_context(long.select("unique_id", "ds", "y"), context_length, "ds", multiple)
    days = kept.select("ds").distinct()
    numbered = days.withColumn("_day", F.row_number().over(Window.orderBy("ds")) - 1)
    chunks = hashed_rank(
        kept.select("unique_id").distinct(), F.col("unique_id"), ["unique_id"], "_rank"
    ).select("unique_id", F.floor(F.col("_rank") / chunk).alias("_chunk"))
    value = encode_target(F.greatest("y", F.lit(0.0)) if transform == "log1p" else F.col("y"),
                          transform)
    cells = (
        kept.join(F.broadcast(numbered), "ds")  # at most one row per kept calendar day
        .join(chunks, "unique_id")
        .select("_chunk", "unique_id", "_day", value.cast("float").alias("_v"))
    )
    n_days = kept.agg(F.countDistinct("ds").alias("n")).head()["n"]

    def one_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, ids = pd.factorize(pdf["unique_id"], sort=True)
        grid = np.full((len(ids), n_days), np.nan, dtype=np.float32)
        grid[rows, pdf["_day"].to_numpy()] = pdf["_v"].to_numpy()
        known = np.isfinite(grid)
        medians = np.asarray(score(np.where(known, grid, 0.0), known, horizon), dtype=float)
        return pd.DataFrame(
            {
                "unique_id": np.repeat(np.asarray(ids, dtype=object), horizon),
                "step": np.tile(np.arange(1, horizon + 1), len(ids)),
                "raw": medians.reshape(-1),
            }
        )

    last = kept.agg(F.max("ds").alias("d")).scalar()
    return (
        cells.groupBy("_chunk")
        .applyInPandas(one_chunk, "unique_id string, step int, raw double")
        .withColumn("_last", last)
        .select(
            "unique_id",
            F.date_add("_last", F.col("step")).alias("ds"),
            decode_target(F.col("raw"), transform).alias("forecast"),
        )
    )
