"""Exact quantiles of any number of rows, without one task that holds them all.

``percentile`` keeps every distinct value of a group in one task. Here a
Greenwald-Khanna summary (``percentile_approx``) first brackets each wanted rank;
a second pass counts the rows between the brackets and lists distinct values only
inside them, so what is sorted is a fixed small share of the rows. That share grows with
the rows, so it is sorted by ranges of the value; only range counts come together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.session import materialize

ACCURACY = 100_000
MARGIN = 5.0 / ACCURACY


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group with linearly interpolated quantiles.

    Nulls are ignored. A failed bracket raises instead of giving a wrong value.
    """
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(*by, v.alias("_v"))
    low = [max(0.0, p - MARGIN) for p in probs]
    high = [min(1.0, p + MARGIN) for p in probs]
    sketch = [
        F.percentile_approx("_v", low, ACCURACY).alias("_lo"),
        F.percentile_approx("_v", high, ACCURACY).alias("_hi"),
    ]
    if by:
        brackets = materialize(rows.groupBy(*by).agg(*sketch), "brackets")
        tagged = (
            rows.alias("_r")
            .join(brackets.alias("_b"), _same("_r", "_b", by))
            .select("_r.*", "_lo", "_hi")
        )
    else:
        band = rows.agg(*sketch).head()  # a few numbers
        edges = {c: F.array(*[F.lit(v) for v in band[c] or ()]) for c in ("_lo", "_hi")}
        tagged = rows.withColumns({c: e.cast("array<double>") for c, e in edges.items()})

    inside = F.exists(
        F.arrays_zip("_lo", "_hi"),
        lambda b: (F.col("_v") >= b["_lo"]) & (F.col("_v") <= b["_hi"]),
    )
    passed = F.size(F.filter("_hi", lambda h: h < F.col("_v")))
    cells = (
        tagged.withColumn("_in", F.when(inside, F.col("_v")))
        .withColumn("_gap", F.when(F.col("_in").isNull(), passed))
        .groupBy(*by, "_in", "_gap")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        )
    )
    # written, so that the ranges stay as they are for both readers
    placed = materialize(
        cells.repartitionByRange(*by, "_min").withColumn("_part", F.spark_partition_id()), "cells"
    )
    # a row per range and group
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*by, "_part")
        .agg(F.sum("_n").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy(*by)))
    )
    inside_part = (
        Window.partitionBy(*by, "_part")
        .orderBy("_min")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = (
        placed.withColumn("_sum", F.sum("_n").over(inside_part))
        .alias("_c")
        .join(starts.alias("_s"), _same("_c", "_s", [*by, "_part"]))
        .select("_c.*", "_start", "_total")
        .withColumn("_end", F.col("_start") + F.col("_sum"))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            F.max(_value_at(F.floor(pos))).alias(f"_a{i}"),
            F.max(_value_at(F.ceil(pos))).alias(f"_z{i}"),
            F.max(pos - F.floor(pos)).alias(f"_t{i}"),
        ]
    got = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for i, name in enumerate(names):
        a, z, t = F.col(f"_a{i}"), F.col(f"_z{i}"), F.col(f"_t{i}")
        missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
        exact = F.when(a.isNull() | z.isNull(), missed).otherwise(a + (z - a) * t)
        out.append(F.when(F.col("_total").isNotNull(), exact).alias(name))
    return got.select(*by, *out)


def _same(left: str, right: str, cols: Sequence[str]) -> Column:
    """Equal columns of two aliased frames, missing values included."""
    hits = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols]
    return reduce(lambda a, b: a & b, hits)


def _value_at(rank: Column) -> Column:
    """Value of the row with this 0-based rank, where the cell determines it."""
    first = F.col("_begin")
    last = F.col("_end") - 1
    held = (rank >= first) & (rank <= last)
    return (
        F.when(held & F.col("_in").isNotNull(), F.col("_in"))
        .when(rank == first, F.col("_min"))
        .when(rank == last, F.col("_max"))
    )
