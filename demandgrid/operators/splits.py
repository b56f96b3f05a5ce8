"""Time based splits; cutoffs are scalar subqueries, so everything stays lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_dates(df: DataFrame, n: int, date: str = "date") -> Column:
    """The ``n`` latest distinct dates, newest first, as an array scalar."""
    top = df.select(date).dropna().distinct().orderBy(F.col(date).desc()).limit(n)
    return top.agg(F.sort_array(F.collect_list(date), asc=False).alias("d")).scalar()


def nth_last_date(df: DataFrame, n: int, date: str = "date") -> Column:
    """The n-th last distinct date; with fewer dates the first one."""
    top = df.select(date).dropna().distinct().orderBy(F.col(date).desc()).limit(n)
    return top.agg(F.min(date).alias("d")).scalar()


def timeseries_split(
    df: DataFrame, days: int = 16, date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Rows before the ``days`` last distinct dates, and the rows on them."""
    cut = nth_last_date(df, days, date)
    return df.filter(F.col(date) < cut), df.filter(F.col(date) >= cut)


def calendar_split(
    df: DataFrame, days: int = 16, date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Like ``timeseries_split`` but by calendar days instead of distinct dates."""
    cut = F.date_sub(df.agg(F.max(date).alias("d")).scalar(), days - 1)
    return df.filter(F.col(date) < cut), df.filter(F.col(date) >= cut)


def usable_windows(df: DataFrame, windows: Sequence[int], date: str = "date") -> list[int]:
    """Sorted unique window lengths that leave at least one training date."""
    asked = sorted(set(windows))
    have = df.select(date).dropna().distinct().limit(max(asked) + 1).count()
    good = [n for n in asked if n < have]
    if not good:
        raise ValueError(f"no valid walk-forward window among {asked}: only {have} dates")
    return good


def walk_forward_split(
    df: DataFrame, windows: Sequence[int] = (16, 30, 60, 90), date: str = "date"
) -> list[tuple[DataFrame, DataFrame, str]]:
    """(train, validation, label) per usable window, all lazy filters on one input."""
    good = usable_windows(df, windows, date)
    latest = last_dates(df, max(good), date)
    out = []
    for n in good:
        cut = F.get(latest, F.lit(n - 1))
        out.append((df.filter(F.col(date) < cut), df.filter(F.col(date) >= cut), f"val_{n}d"))
    return out


def walk_forward_roles(
    df: DataFrame, windows: Sequence[int] = (16, 30, 60, 90), date: str = "date"
) -> DataFrame:
    """Every row once per window with its ``label`` and ``role``, from one scan.

    Windows with no training date are dropped inside the plan.
    """
    asked = sorted(set(windows))
    latest = last_dates(df, max(asked) + 1, date)
    folds = F.filter(
        F.transform(
            F.array(*[F.lit(n) for n in asked]),
            lambda n: F.struct(n.alias("n"), F.get(F.col("_latest"), n - 1).alias("cut"),
                               (F.size("_latest") > n).alias("ok")),
        ),
        lambda f: f["ok"],
    )
    return (
        df.withColumn("_latest", latest)
        .withColumn("_fold", F.explode(folds))
        .select(
            *df.columns,
            F.format_string("val_%dd", F.col("_fold.n")).alias("label"),
            F.when(F.col(date) < F.col("_fold.cut"), "train").otherwise("val").alias("role"),
        )
    )


def filter_validation(preds: DataFrame, days: int = 16, date: str = "date") -> DataFrame:
    """Holdout rows of a prediction frame.

    Rows labelled ``val`` are the holdout where there are any; otherwise it is the last
    ``days`` distinct dates labelled ``train``. ``test`` rows never count.
    """
    known = preds.filter(F.col("split") != "test")
    train_rows = known.filter(F.col("split") == "train")
    has_val = known.agg(
        F.coalesce(F.max(F.col("split") == "val"), F.lit(False)).alias("v")
    ).scalar()
    cut = nth_last_date(train_rows, days, date)
    late = (F.col("split") == "train") & (F.col(date) >= cut)
    return known.filter(F.when(has_val, F.col("split") == "val").otherwise(late))
