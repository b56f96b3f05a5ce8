"""Multi-step forecasts that feed each prediction back as history.

Both variants bring a series to one row: the last ``lookback`` target values as an array
and the horizon's known columns as an array of structs. Their size is fixed by the
feature settings and the horizon, whatever the number of rows. From there on nothing is
shuffled: the linear recursion is one fold, the tree recursion one map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.arrays import STATS, back, known_tail, let
from demandgrid.functions.errors import decode_target
from demandgrid.operators.ensembles import Term, flat_trees, lag_term, roll_forward, window_term
from demandgrid.operators.models import FittedPanelModel, Linear
from demandgrid.settings import FeatureSettings


def history_terms(settings: FeatureSettings, col: str) -> dict[str, object]:
    """Feature name -> function of the value array, for lags and rolling columns of ``col``."""
    out = {}
    for k in settings.lags.get(col, ()):
        out[f"{col}_lag_{k}"] = lambda a, k=k: back(a, k)
    for roll in settings.rolls:
        if roll.col != col:
            continue
        for w in roll.windows:
            for agg in roll.aggs:
                stat = STATS[agg]
                out[f"{col}_roll_{w}_{agg}"] = lambda a, w=w, stat=stat: let(
                    known_tail(a, w), stat
                )
    return out


def series_tails(
    history: DataFrame, keys: Sequence[str], date: str, target: str, length: int
) -> DataFrame:
    """Last ``length`` target values per series, oldest first, as ``_tail``.

    Counted per series, whenever it ends. The rank filter is a group limit that Spark also
    applies before the shuffle, so the arrays are bounded before they are collected.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    recent = (
        history.select(*keys, date, target)
        .withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= length)
    )
    pairs = F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(target).alias("y"))))
    values = F.transform(pairs, lambda p: p["y"].cast("double"))
    return recent.groupBy(*keys).agg(values.alias("_v")).select(
        *keys,
        F.slice("_v", F.greatest(F.size("_v") - (length - 1), F.lit(1)), F.lit(length)).alias(
            "_tail"
        ),
    )


def _paths(
    history: DataFrame,
    horizon: DataFrame,
    settings: FeatureSettings,
    target: str,
    known: dict[str, Column],
) -> DataFrame:
    """One row per series: ``_tail`` and ``_days``, the horizon in date order."""
    keys, date = settings.keys, settings.date_col
    day = F.struct(F.col(date).alias("d"), *[e.alias(n) for n, e in known.items()])
    days = horizon.groupBy(*keys).agg(F.sort_array(F.collect_list(day)).alias("_days"))
    tails = series_tails(history, keys, date, target, settings.lookback())
    return days.join(tails, keys, "left").withColumn(
        "_tail", F.coalesce("_tail", F.array().cast("array<double>"))
    )


def _by_day(values: str) -> Column:
    """Horizon days paired with the values appended after the tail."""
    added = F.slice(values, F.size("_tail") + 1, F.greatest(F.size("_days"), F.lit(1)))
    return F.arrays_zip(F.col("_days").alias("day"), added.alias("p"))


def recursive_linear(
    model: FittedPanelModel,
    history: DataFrame,
    horizon: DataFrame,
    settings: FeatureSettings,
    target: str,
) -> DataFrame:
    """Day by day forecast of a linear model: keys, date and ``predicted`` in sales units.

    ``history`` holds the target in model space. Each day's score is a known part, taken
    from the horizon row, plus a part that depends on the values so far.
    """
    weights = model.linear.weights
    terms = {n: f for n, f in history_terms(settings, target).items() if n in weights}
    link = Linear((), (), 0.0, model.linear.link)

    def step(values: Column, day: Column) -> Column:
        score = day["s"]
        for name, term in terms.items():
            score = score + F.coalesce(term(values), F.lit(0.0)) * F.lit(weights[name])
        return F.concat(values, F.array(link.respond(score)))

    keys, date = settings.keys, settings.date_col
    paths = _paths(
        history, horizon, settings, target, {"s": model.static_score(horizon.columns, tuple(terms))}
    )
    rolled = F.aggregate("_days", F.col("_tail"), step)
    return (
        paths.withColumn("_all", rolled)
        .withColumn("_at", F.explode(_by_day("_all")))
        .select(
            *keys,
            F.col("_at.day.d").alias(date),
            decode_target(F.col("_at.p"), model.transform).alias("predicted"),
        )
    )


def row_terms(settings: FeatureSettings, col: str) -> dict[str, Term]:
    """``history_terms`` for matrices of values, a row per series."""
    out: dict[str, Term] = {f"{col}_lag_{k}": lag_term(k) for k in settings.lags.get(col, ())}
    for roll in settings.rolls:
        if roll.col == col:
            out |= {f"{col}_roll_{w}_{agg}": window_term(w, agg) for w in roll.windows for agg in roll.aggs}
    return out


def recursive_trees(
    model: FittedPanelModel,
    history: DataFrame,
    horizon: DataFrame,
    settings: FeatureSettings,
    target: str,
) -> DataFrame:
    """The same recursion for a tree model: the ensemble travels with one map over the series."""
    keys, date = settings.keys, settings.date_col
    codes = model.encoder.columns()
    terms = {n: t for n, t in row_terms(settings, target).items() if n in codes}
    own = [n for n in codes if n not in terms and n not in keys]
    of_series = [n for n in codes if n in keys]
    known = {"x": F.array(*[codes[n].cast("double") for n in own]) if own else F.array().cast("array<double>")}
    fixed = F.array(*[codes[n].cast("double") for n in of_series]) if of_series else F.array().cast("array<double>")
    paths = _paths(history, horizon, settings, target, known).withColumn("_series", fixed)
    trees = flat_trees(history.sparkSession, model.trees)
    out = roll_forward(paths, keys, trees, list(codes), of_series, own, terms, settings.lookback())
    return out.select(
        *keys, F.col("d").alias(date), decode_target(F.col("p"), model.transform).alias("predicted")
    )


def recursive_forecast(
    model: FittedPanelModel,
    history: DataFrame,
    horizon: DataFrame,
    settings: FeatureSettings,
    target: str,
) -> DataFrame:
    if model.linear is not None:
        return recursive_linear(model, history, horizon, settings, target)
    return recursive_trees(model, history, horizon, settings, target)
