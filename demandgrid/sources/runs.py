"""Run folders: ``<runs>/<name>/metrics.json`` and ``submission.csv``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandgrid.sources.schemas import RUN_RECORD, SUBMISSION

MODEL_FOLDER = "model"  # where a run keeps its fitted model

RUN_ROWS = (
    "run string, val_rmsle double, n_features int, model_type string, run_scope string,"
    " elapsed_seconds double"
)


def _run_name() -> Column:
    return F.regexp_extract(F.input_file_name(), r"/([^/]+)/(?:metrics\.json|submission\.csv|model/encoding)", 1)


def _missing(err: AnalysisException) -> bool:
    return err.getCondition() == "PATH_NOT_FOUND"


def write_run(folder: str, record: DataFrame, submission: DataFrame | None = None) -> None:
    """Store one run; ``record`` has the columns metrics, params, elapsed_seconds."""
    record.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics.json")
    if submission is not None:
        submission.select("id", "sales").write.mode("overwrite").option("header", True).csv(
            f"{folder}/submission.csv"
        )


def _one(run: str) -> str:
    """Path pattern that means the folder of this very name."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", run)


def scan_submissions(spark: SparkSession, runs: str, run: str | None = None) -> DataFrame:
    """Submissions of a runs folder in one scan: run, id, sales; of one run only its file is read."""
    part = "*" if run is None else _one(run)
    try:
        raw = spark.read.schema(SUBMISSION).option("header", True).csv(f"{runs}/{part}/submission.csv")
    except AnalysisException as err:
        if not _missing(err):
            raise
        return spark.createDataFrame([], "run string, id bigint, sales double")
    return raw.select(_run_name().alias("run"), "id", "sales")


def load_runs(
    spark: SparkSession, runs: str, scope: str | None = None, run: str | None = None
) -> DataFrame:
    """One row per run that has metrics; with ``run`` only that run's folder is read.

    A run without a scope passes every scope filter; a text that is no number gives
    a missing ``n_features``.
    """
    part = "*" if run is None else _one(run)
    try:
        raw = (
            spark.read.schema(RUN_RECORD)
            .option("multiLine", True)
            .json(f"{runs}/{part}/metrics.json")
            .filter(F.col("metrics").isNotNull())
        )
    except AnalysisException as err:
        if not _missing(err):
            raise
        return spark.createDataFrame([], RUN_ROWS + ", has_submission boolean")
    rows = raw.select(
        _run_name().alias("run"),
        F.col("metrics")["val_rmsle"].alias("val_rmsle"),
        F.coalesce(
            F.col("metrics")["n_features"].cast("int"),
            F.expr("try_cast(params['n_features'] as int)"),
        ).alias("n_features"),
        F.coalesce(F.col("params")["model_type"], F.lit("?")).alias("model_type"),
        F.col("params")["run_scope"].alias("run_scope"),
        "elapsed_seconds",
    )
    if scope is not None:
        rows = rows.filter(F.col("run_scope").isNull() | (F.col("run_scope") == scope))
    have = scan_submissions(spark, runs, run).select("run").distinct()
    return rows.join(have.withColumn("_sub", F.lit(True)), "run", "left").select(
        *rows.columns, F.coalesce("_sub", F.lit(False)).alias("has_submission")
    )


def _on_test_rows(subs: DataFrame, test: DataFrame, types: DataFrame) -> DataFrame:
    """Each run of ``subs`` on the keys of ``test``."""
    subs = subs.withColumnRenamed("sales", "predicted")
    names = subs.select("run").distinct()
    grid = test.select("id", "date", "store_nbr", "family").withColumn(
        "run", F.explode(names.agg(F.collect_set("run").alias("r")).scalar())
    )
    return (
        grid.join(subs, ["run", "id"], "left")
        .join(types.select("run", "model_type"), "run", "left")
        .select(
            "run",
            F.coalesce("model_type", F.lit("?")).alias("model_type"),
            "id",
            "date",
            "store_nbr",
            "family",
            "predicted",
            F.lit(None).cast("double").alias("actual"),
            F.lit("test").alias("split"),
        )
    )


def load_all_submissions(spark: SparkSession, runs: str, test: DataFrame) -> DataFrame:
    """Every run's forecasts on the keys of ``test``; ids without forecast stay NULL."""
    return _on_test_rows(scan_submissions(spark, runs), test, load_runs(spark, runs))


def load_submission_predictions(
    spark: SparkSession, runs: str, run: str, test: DataFrame
) -> DataFrame:
    """One run's forecasts on the keys of ``test``: its two files are all that is read.

    A run without a submission gives no row.
    """
    subs = scan_submissions(spark, runs, run)
    return _on_test_rows(subs, test, load_runs(spark, runs, run=run))


def rank_runs(runs: DataFrame) -> DataFrame:
    """Board order: best score first, unscored runs last."""
    return runs.orderBy(F.col("val_rmsle").asc_nulls_last(), "run")


def pick_best(
    runs: DataFrame, scope: str | None = None, model_type: str | None = None
) -> DataFrame:
    """The run with the smallest score among those that have a submission."""
    rows = runs.filter(F.col("has_submission") & F.col("val_rmsle").isNotNull())
    if scope is not None:
        rows = rows.filter(F.col("run_scope").isNull() | (F.col("run_scope") == scope))
    if model_type is not None:
        rows = rows.filter(F.col("model_type") == model_type)
    return rows.orderBy("val_rmsle", "run").limit(1)


def best_per_type(runs: DataFrame) -> DataFrame:
    """Best run of each model type, best first."""
    w = Window.partitionBy("model_type").orderBy("val_rmsle", "run")
    return (
        runs.filter(F.col("val_rmsle").isNotNull())
        .withColumn("_r", F.row_number().over(w))
        .filter("_r = 1")
        .drop("_r")
        .orderBy("val_rmsle", "run")
    )


def preferred_runs(runs: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Per name pattern the best run not taken by an earlier pattern.

    The plain ``log-ridge`` pattern leaves Fourier variants aside. Without any match
    the best run per model type is returned. The choice walks over the patterns, which
    are a few words, with one small query each.
    """
    scored = runs.filter(F.col("val_rmsle").isNotNull())
    taken: list[str] = []
    for pattern in patterns:
        hits = scored.filter(F.col("run").contains(pattern) & ~F.col("run").isin(taken))
        if pattern == "log-ridge":
            hits = hits.filter(~F.col("run").contains("+fourier"))
        best = hits.orderBy("val_rmsle", "run").select("run").head()
        if best is not None:
            taken.append(best["run"])
    if not taken:
        return best_per_type(runs)
    order = F.array_position(F.array(*[F.lit(t) for t in taken]), F.col("run"))
    return scored.filter(F.col("run").isin(taken)).orderBy(order)


def discover_runs(
    spark: SparkSession, runs: str, scope: str | None = "full", patterns: Sequence[str] = ()
) -> DataFrame:
    """The runs a comparison starts from: scored, of the scope, with a stored model.

    The ``sandbox`` folder is none, and a run without a scope fits any. Which of the others are
    taken is the rule of ``preferred_runs``; without patterns the best of each model type.
    """
    try:
        stored = spark.read.parquet(f"{runs}/*/{MODEL_FOLDER}/encoding")
    except AnalysisException as err:
        if not _missing(err):
            raise
        return load_runs(spark, runs, scope).limit(0)
    have = stored.filter("part = 'kind'").select(_run_name().alias("run")).distinct()
    rows = load_runs(spark, runs, scope).filter(F.col("run") != "sandbox")
    return preferred_runs(rows.join(have, "run", "left_semi"), patterns)


def latest_run(runs: DataFrame, label: str) -> DataFrame:
    """Most recent finished run whose name ends with ``label`` (names start with a stamp)."""
    return (
        runs.filter(F.col("run").endswith(label) & F.col("has_submission"))
        .orderBy(F.col("run").desc())
        .limit(1)
    )
