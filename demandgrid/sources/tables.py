"""Table bundle scan and the submission / report sinks."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.functions.errors import nan_to_null
from demandgrid.sources.schemas import TABLES

log = logging.getLogger(__name__)


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: aggregates skip only the latter."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            nan_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    # header order may differ from the schema, so columns are taken by name
    with_text = spark.read.option("header", True).csv(path)
    have = set(with_text.columns)
    cols = [
        (F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in have
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return with_text.select(*cols)


def load_tables(
    spark: SparkSession, folder: str, files: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """Lazy scans of the seven named tables; a missing file gives an empty table."""
    out: dict[str, DataFrame] = {}
    for name, (default, schema) in TABLES.items():
        path = f"{folder.rstrip('/')}/{(files or {}).get(name, default)}"
        try:
            out[name] = nulls_for_nans(_scan(spark, path, schema))
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("missing table %s at %s", name, path)
            out[name] = spark.createDataFrame([], schema)
    return out


def holiday_dates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct non-null holiday dates."""
    return tables["holidays"].select("date").dropna().distinct()


def save_submission(predictions: DataFrame, path: str, value: str = "predicted") -> None:
    """Write ``id, sales``; the pair comes from one row, never from positions."""
    rows = predictions.select("id", F.col(value).cast("double").alias("sales"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_audit_outputs(folder: str, summary: DataFrame, slices: DataFrame) -> None:
    """Summary rows as JSON lines and the slice table as CSV."""
    summary.write.mode("overwrite").json(f"{folder}/audit_summary.json")
    write_table_csv(slices, f"{folder}/audit_slices.csv")
