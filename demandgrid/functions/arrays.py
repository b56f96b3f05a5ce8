"""Statistics of short value arrays as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind an intermediate value inside a higher-order expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def back(values: Column, k: int) -> Column:
    """The k-th last value, NULL if there are fewer."""
    return F.get(values, F.size(values) - k)


def known_tail(values: Column, w: int) -> Column:
    """The non-null ones of the last ``w`` values."""
    start = F.greatest(F.size(values) - (w - 1), F.lit(1))
    return F.filter(F.slice(values, start, F.lit(w)), lambda x: x.isNotNull())


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def std(v: Column) -> Column:
    """Sample deviation; needs two values."""
    squares = lambda m: total(F.transform(v, lambda x: (x - m) * (x - m)))
    below = F.greatest(F.size(v) - 1, F.lit(1))
    return F.when(F.size(v) > 1, F.sqrt(let(mean(v), squares) / below))


def median(v: Column) -> Column:
    def middle(s: Column) -> Column:
        lo = F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
        hi = F.get(s, F.floor(F.size(s) / 2).cast("int"))
        return (lo + hi) / 2

    return F.when(F.size(v) > 0, let(F.array_sort(v), middle))


# fixed values: statistic name -> expression over an array without NULLs
STATS = {"mean": mean, "std": std, "min": F.array_min, "max": F.array_max, "median": median}
