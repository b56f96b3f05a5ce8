"""Calendar and Fourier columns of a date; all JVM-side expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: cycle length in days (or months) per Fourier base column
PERIODS = {"dayofyear": 365.25, "dayofweek": 7.0, "month": 12.0}


def calendar_columns(
    date: Column, names: Sequence[str], ref_date: Column | None = None
) -> dict[str, Column]:
    """The asked-for calendar parts; unknown names are left out.

    ``dayofweek`` starts at Monday = 0, ``weekofyear`` is the ISO week and
    ``time_step`` counts days since ``ref_date``.
    """
    parts = {
        "year": F.year(date),
        "month": F.month(date),
        "dayofweek": F.weekday(date),
        "dayofmonth": F.dayofmonth(date),
        "quarter": F.quarter(date),
        "weekofyear": F.weekofyear(date),
        "dayofyear": F.dayofyear(date),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
    }
    if ref_date is not None:
        parts["time_step"] = F.date_diff(date, ref_date)
    return {n: parts[n] for n in names if n in parts}


def fourier_columns(date: Column, harmonics: Mapping[str, Sequence[int]]) -> dict[str, Column]:
    """Sine and cosine pairs per base column and harmonic; unknown bases are skipped."""
    out: dict[str, Column] = {}
    for base, orders in harmonics.items():
        if base not in PERIODS:
            continue
        value = calendar_columns(date, [base])[base]
        for h in orders:
            angle = value * F.lit(2.0 * math.pi * h) / F.lit(PERIODS[base])
            out[f"fourier_{base}_sin_{h}"] = F.sin(angle)
            out[f"fourier_{base}_cos_{h}"] = F.cos(angle)
    return out
