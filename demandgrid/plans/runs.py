"""Storing fitted runs and their forecasts in run folders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.errors import rmsle
from demandgrid.operators.encode import OneHot, Ordinal
from demandgrid.operators.models import FittedPanelModel, Linear
from demandgrid.sources.runs import write_run


def run_record(metrics: DataFrame, params: Mapping[str, str | None], seconds: float) -> DataFrame:
    """One row with the metrics map, the params map and the run time."""
    cells = [x for c in metrics.columns for x in (F.lit(c), F.col(c).cast("double"))]
    pairs = [x for k, v in params.items() if v is not None for x in (F.lit(k), F.lit(v))]
    return metrics.select(
        F.create_map(*cells).alias("metrics"),
        F.create_map(*pairs).alias("params"),
        F.lit(float(seconds)).alias("elapsed_seconds"),
    )


def store_prediction_runs(preds: DataFrame, folder: str, runs: Mapping[str, tuple]) -> None:
    """Write one run folder per entry: name -> (forecast column, model type, scope).

    ``preds`` has ``id`` and ``actual``. Runs are few; each write is a distributed job.
    """
    for name, (value, model_type, scope) in runs.items():
        sub = preds.select("id", "actual", value.alias("sales"))
        scores = sub.agg(
            rmsle(F.col("actual"), F.col("sales")).alias("val_rmsle"),
            F.count(F.lit(1)).alias("n_features"),
        )
        record = run_record(scores, {"model_type": model_type, "run_scope": scope}, 0.0)
        write_run(f"{folder}/{name}", record, sub)


def save_run_model(spark: SparkSession, model: FittedPanelModel, folder: str) -> None:
    """Store a fitted model: weights and encodings as rows, trees as a Spark ML model."""
    categories = model.encoder.categories if model.linear else model.encoder.codes
    facts = [
        ("kind", 0, model.kind), ("target", 0, model.target), ("transform", 0, model.transform),
        *[("categorical", i, c) for i, c in enumerate(model.categorical)],
        *[("numeric", i, c) for i, c in enumerate(model.numeric)],
        *[("history", i, c) for i, c in enumerate(model.history)],
        *[("encoded_numeric", i, c) for i, c in enumerate(model.encoder.numeric)],
        *[
            (f"levels_{type(v).__name__}:{c}", i, str(v))
            for c, vs in categories.items()
            for i, v in enumerate(vs)
        ],
    ]
    if model.linear:
        facts += [("link", 0, model.linear.link), ("intercept", 0, repr(model.linear.intercept))]
        facts += [("weight", i, repr(w)) for i, w in enumerate(model.linear.coefficients)]
    else:
        model.trees.save(f"{folder}/trees")
    rows = spark.createDataFrame(facts, "part string, place int, value string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/encoding")


def load_run_model(spark: SparkSession, folder: str) -> FittedPanelModel:
    """The model stored by ``save_run_model``; its size is the number of features."""
    parts: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{folder}/encoding").orderBy("part", "place").collect():
        parts.setdefault(r["part"], []).append(r["value"])
    levels = {}
    for name, values in parts.items():
        if name.startswith("levels_"):
            kind, col = name.removeprefix("levels_").split(":", 1)
            levels[col] = [int(v) for v in values] if kind == "int" else values
    kind = parts["kind"][0]
    common = dict(
        kind=kind,
        target=parts["target"][0],
        transform=parts["transform"][0],
        categorical=parts.get("categorical", []),
        numeric=parts.get("numeric", []),
        history=parts.get("history", []),
    )
    numeric = parts.get("encoded_numeric", [])
    ordered = {c: levels[c] for c in common["categorical"] if c in levels}
    if kind == "trees":
        trees = PipelineModel.load(f"{folder}/trees")
        return FittedPanelModel(**common, encoder=Ordinal(ordered, numeric), trees=trees)
    encoder = OneHot(ordered, numeric)
    linear = Linear(
        encoder.names,
        [float(w) for w in parts["weight"]],
        float(parts["intercept"][0]),
        parts["link"][0],
    )
    return FittedPanelModel(**common, encoder=encoder, linear=linear)
