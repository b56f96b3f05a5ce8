"""Forecast error expressions per row and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: smallest denominator of a relative error
DENOM_FLOOR = 1e-10


def clamp(p: Column) -> Column:
    """Negative forecasts become zero; a missing forecast stays missing."""
    return F.when(p < 0, F.lit(0.0)).otherwise(p)


def log_residual(y: Column, p: Column) -> Column:
    return F.log1p(y) - F.log1p(clamp(p))


def squared_log_error(y: Column, p: Column) -> Column:
    d = log_residual(y, p)
    return d * d


def encode_target(y: Column, transform: str) -> Column:
    return F.log1p(y) if transform == "log1p" else y


def decode_target(p: Column, transform: str) -> Column:
    """Back to sales units, never negative."""
    return clamp(F.expm1(p) if transform == "log1p" else p)


def rmsle(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(squared_log_error(y, p)))


def metric_aggregates(y: Column, p: Column) -> dict[str, Column]:
    """Row metrics as aggregates of one pass."""
    e = p - y
    denom = F.greatest(F.sum(y), F.lit(DENOM_FLOOR))
    return {
        "rmsle": rmsle(y, p),
        "mae": F.avg(F.abs(e)),
        "wmape": F.sum(F.abs(e)) / denom,
        "bias_pct": F.sum(e) / denom * 100.0,
        "rmse": F.sqrt(F.avg(e * e)),
    }


def finite(x: Column) -> Column:
    """True where the value is present and an ordinary number."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
