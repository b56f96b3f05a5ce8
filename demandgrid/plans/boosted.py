"""Boosted trees on a long panel: lags of a differenced target, fed back recursively."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.arrays import back
from demandgrid.functions.calendar import calendar_columns
from demandgrid.functions.errors import clamp
from demandgrid.operators.encode import Ordinal
from demandgrid.operators.ensembles import Term, fit_log_trees, flat_trees, lag_term, roll_forward, window_term
from demandgrid.operators.models import TreeSettings, fit_trees, tree_columns
from demandgrid.operators.recursive import series_tails
from demandgrid.session import materialize

# fixed values: other names of calendar parts in run files
ALIASES = {"day": "dayofmonth", "week": "weekofyear"}


@dataclass(frozen=True)
class BoostedSettings:
    """``rolling`` maps a lag to window sizes: the mean of that many values ending there.

    ``objective`` is ``tweedie`` (log link, ``power``) or ``squared``. Differences may be negative, which
    a log link can not predict: there the Tweedie objective sees them as zero.
    """

    lags: tuple[int, ...] = (7, 14, 28)
    rolling: dict[int, tuple[int, ...]] = field(default_factory=dict)
    differences: tuple[int, ...] = ()
    date_features: tuple[str, ...] = ("dayofweek", "month", "day", "year")
    static: tuple[str, ...] = ()
    exogenous: tuple[str, ...] = ()
    trees: TreeSettings = field(default_factory=TreeSettings)
    objective: str = "squared"
    power: float = 1.1

    def reach(self) -> int:
        spans = [lag + w - 1 for lag, ws in self.rolling.items() for w in ws]
        return max([*self.lags, *spans], default=1)


def _difference(history: DataFrame, by: Sequence[str], orders: Sequence[int]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("ds")
    out = history.withColumn("_z", F.col("y"))
    for i, d in enumerate(orders):
        out = out.withColumn(f"_level{i}", F.col("_z")).withColumn(
            "_z", F.col("_z") - F.lag("_z", d).over(w)
        )
    return out


def _window_terms(s: BoostedSettings, by: Sequence[str]) -> dict[str, Column]:
    w = Window.partitionBy(*by).orderBy("ds")
    out = {f"lag{k}": F.lag("_z", k).over(w) for k in s.lags}
    for lag, sizes in s.rolling.items():
        for size in sizes:
            frame = w.rowsBetween(-(lag + size - 1), -lag)
            full = F.count("_z").over(frame) == size
            out[f"rolling_mean_lag{lag}_window{size}"] = F.when(full, F.avg("_z").over(frame))
    return out


def _row_terms(s: BoostedSettings) -> dict[str, Term]:
    out = {f"lag{k}": lag_term(k) for k in s.lags}
    for lag, sizes in s.rolling.items():
        for size in sizes:
            out[f"rolling_mean_lag{lag}_window{size}"] = window_term(size, "mean", lag, full=True)
    return out


def _undo(d: int):
    """Step that adds a difference to the value ``d`` places back and appends the result."""

    def step(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(x + F.coalesce(back(acc, d), F.lit(0.0))))

    return step


def _dates(names: Sequence[str]) -> dict[str, Column]:
    parts = calendar_columns(F.col("ds"), [ALIASES.get(n, n) for n in names])
    return {f"date_{n}": parts[ALIASES.get(n, n)] for n in names if ALIASES.get(n, n) in parts}


def boosted_forecast(
    history: DataFrame, future: DataFrame, settings: BoostedSettings
) -> DataFrame:
    """Fit on all series, forecast the rows of ``future``: ``unique_id, ds, forecast``.

    ``future`` carries the exogenous columns for the days after the history. Training is
    one window pass and one fit; the forecast is one map over a row per series.
    """
    s = settings
    if s.objective not in ("squared", "tweedie"):
        raise ValueError(f"unknown objective {s.objective!r}")
    by = ["unique_id"]
    terms = _row_terms(s)
    names = [*terms, *_dates(s.date_features), *s.static, *s.exogenous]
    rows = (
        _difference(history, by, s.differences)
        .withColumns({**_window_terms(s, by), **_dates(s.date_features)})
        .filter(F.col("_z").isNotNull())
    )
    for n in terms:
        rows = rows.filter(F.col(n).isNotNull())
    encoder = Ordinal.fit(rows, names)
    coded = tree_columns(rows, encoder)
    inputs = [f"_x_{n}" for n in encoder.names]
    if s.objective == "tweedie":
        trees = fit_log_trees(coded, inputs, "_z", s.trees, s.power)
    else:
        trees = flat_trees(history.sparkSession, fit_trees(coded, inputs, "_z", s.trees))

    codes = encoder.columns()
    known = [n for n in codes if n not in terms]
    cells = F.array(*[codes[n].cast("double") for n in known]) if known else F.array().cast("array<double>")
    days = (
        future.withColumns(_dates(s.date_features))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("ds").alias("d"), cells.alias("x")))).alias("_days"))
    )
    levels = _difference(history.select(*by, "ds", "y"), by, s.differences)
    state = days.join(series_tails(levels, by, "ds", "_z", s.reach()), by, "left")
    for i, d in enumerate(s.differences):
        ends = series_tails(levels, by, "ds", f"_level{i}", d)
        state = state.join(ends.withColumnRenamed("_tail", f"_end{i}"), by, "left")
    ends = [f"_end{i}" for i in range(len(s.differences))]
    # a series without history starts from nothing, its horizon rows stay
    nothing = F.array().cast("array<double>")
    state = state.withColumns({c: F.coalesce(c, nothing) for c in ["_tail", *ends]})
    paths = materialize(state.withColumn("_series", nothing), "paths")
    rolled = roll_forward(paths, by, trees, list(codes), [], known, terms, s.reach())
    if not s.differences:
        return rolled.select(*by, F.col("d").alias("ds"), clamp(F.col("p")).alias("forecast"))
    rolled = rolled.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("d", "p"))).alias("_at"))
    state = rolled.join(paths.select(*by, *ends), by)
    path = F.col("_at.p")
    for i, d in reversed(list(enumerate(s.differences))):
        grown = F.aggregate(path, F.col(f"_end{i}"), _undo(d))
        path = F.slice(grown, F.size(f"_end{i}") + 1, F.greatest(F.size("_at"), F.lit(1)))
    state = state.withColumn("_cell", F.explode(F.arrays_zip(F.col("_at.d").alias("d"), path.alias("p"))))
    return state.select(*by, F.col("_cell.d").alias("ds"), clamp(F.col("_cell.p")).alias("forecast"))
