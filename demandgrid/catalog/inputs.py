"""DataFrame counterparts of the shared SQL fragments, built with the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.errors import clamp
from demandgrid.operators.audit import enrich_holdout
from demandgrid.operators.joins import merge_dimensions
from demandgrid.operators.metrics import velocity_tiers
from demandgrid.operators.series import forecast
from demandgrid.operators.splits import timeseries_split
from demandgrid.plans.panel import as_long, long_panel, retail_tables, stored_panel
from demandgrid.session import materialize

DAYS = 16


def merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Merged train and test; the test rows are the last 16 days without target."""
    return merge_dimensions(retail_tables(spark, folder))


def stacked_from(long: DataFrame, models=("Naive", "SeasonalNaive")) -> DataFrame:
    """Holdout rows once per model: model, id, date, keys, actual, predicted, split."""
    train, val = timeseries_split(long, DAYS, "ds")
    wide = forecast(train, DAYS, list(models))
    melted = wide.unpivot(["unique_id", "ds"], list(models), "model", "forecast")
    grid = val.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return grid.join(melted, ["unique_id", "ds", "model"], "left").select(
        "model", "id", F.col("ds").alias("date"), "store_nbr", "family",
        F.col("y").alias("actual"),
        F.coalesce(clamp(F.col("forecast")), F.lit(0.0)).alias("predicted"),
        F.lit("val").alias("split"),
    )


def stacked_predictions(
    spark: SparkSession, folder: str, models=("Naive", "SeasonalNaive")
) -> DataFrame:
    return stacked_from(long_panel(spark, folder, stored=True), models)


def predictions(spark: SparkSession, folder: str, model: str = "SeasonalNaive") -> DataFrame:
    """Holdout predictions of one statistical model."""
    return stacked_predictions(spark, folder, [model]).drop("model")


def holdout_with_metadata(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """(predictions, merged rows of all days, training rows) over one stored panel."""
    panel = stored_panel(spark, folder)
    tables = retail_tables(spark, folder, panel=panel)
    tables["train"] = panel.drop("n_orders")
    rows, _ = merge_dimensions(tables)
    train, _ = timeseries_split(panel, DAYS)
    return stacked_from(as_long(panel), ["SeasonalNaive"]).drop("model"), rows, train


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Holdout predictions with metadata, tiers and errors, written once."""
    preds, rows, train = holdout_with_metadata(spark, folder)
    return materialize(enrich_holdout(preds, rows, velocity_tiers(train)), "enriched")
