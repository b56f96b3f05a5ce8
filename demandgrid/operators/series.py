"""Per-series statistical forecasts in long form (``unique_id, ds, y``).

All forecasters take the grouping columns, so the same code serves one forecast and all
cutoffs of a rolling-origin evaluation in a single job. A series is one row per day, so
the arrays built here have at most one value per calendar day.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.errors import clamp, rmsle
from demandgrid.operators.metrics import score_models
from demandgrid.operators.smoothing import best_ets, best_ses
from demandgrid.operators.splits import last_dates, timeseries_split

ID = ("unique_id",)


def future_keys(history: DataFrame, h: int, by: Sequence[str] = ID) -> DataFrame:
    """One row per series and step after its last date: ``ds`` and ``step``."""
    last = history.groupBy(*by).agg(F.max("ds").alias("_last"))
    return _steps(last, h).select(*by, "ds", "step")


def _steps(per_series: DataFrame, h: int) -> DataFrame:
    return per_series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumn(
        "ds", F.date_add("_last", F.col("step"))
    )


def naive(history: DataFrame, h: int, by: Sequence[str] = ID) -> DataFrame:
    """Last value repeated; one aggregate with map-side combine."""
    last = history.groupBy(*by).agg(
        F.max("ds").alias("_last"), F.max_by("y", "ds").alias("forecast")
    )
    return _steps(last, h).select(*by, "ds", "forecast")


def last_values(history: DataFrame, m: int, by: Sequence[str]) -> DataFrame:
    """The ``m`` newest values per series, oldest first, and the last date.

    The rank filter is a group limit that Spark also applies before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(F.col("ds").desc())
    newest = history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m)
    pairs = F.sort_array(F.collect_list(F.struct("ds", "y")))
    return newest.groupBy(*by).agg(
        F.max("ds").alias("_last"), F.transform(pairs, lambda p: p["y"]).alias("_season")
    )


def seasonal_naive(history: DataFrame, h: int, by: Sequence[str] = ID, m: int = 7) -> DataFrame:
    """Value of the same position in the last season; NULL for a shorter series."""
    place = F.pmod(F.col("step") - 1, F.lit(m)).cast("int")
    full = F.when(F.size("_season") == m, F.get("_season", place))
    return _steps(last_values(history, m, by), h).select(*by, "ds", full.alias("forecast"))


def _seasonal_profile(history: DataFrame, m: int, by: Sequence[str]) -> DataFrame:
    """Per series: values with positions, seasonal indices and the seasonality test.

    Everything is a window on the series, so one exchange serves all of it.
    """
    half = (m - 1) // 2
    w = Window.partitionBy(*by).orderBy("ds")
    whole = Window.partitionBy(*by)
    base = history.select(*by, "ds", "y").withColumns(
        {
            "_t": F.row_number().over(w),
            "_n": F.count(F.lit(1)).over(whole),
            "_mean": F.avg("y").over(whole),
            "_low": F.min("y").over(whole),
            "_cma": F.avg("y").over(w.rowsBetween(-half, half)),
        }
    )
    full = (F.col("_t") > half) & (F.col("_t") <= F.col("_n") - half)
    multiplicative = F.col("_low") > 0
    raw = F.when(multiplicative, F.col("y") / F.col("_cma")).otherwise(F.col("y") - F.col("_cma"))
    dev = F.col("y") - F.col("_mean")
    base = base.withColumns(
        {
            "_pos": F.pmod(F.col("_t") - 1, F.lit(m)),
            "_raw": F.when(full, raw),
            "_dev": dev,
            **{f"_p{k}": dev * (F.lag("y", k).over(w) - F.col("_mean")) for k in range(1, m + 1)},
        }
    )
    by_pos = Window.partitionBy(*by, "_pos")
    base = base.withColumn("_avg", F.avg("_raw").over(by_pos))
    ss = F.sum(F.col("_dev") * F.col("_dev"))
    acf = [F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / F.when(ss > 0, ss) for k in range(1, m + 1)]
    values = F.transform(
        F.sort_array(F.collect_list(F.struct("ds", "y", "_pos"))),
        lambda v: F.struct(v["y"].alias("y"), v["_pos"].alias("pos")),
    )
    got = base.groupBy(*by).agg(
        F.max("ds").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.min("y").alias("_low"),
        values.alias("_values"),
        F.transform(
            F.sort_array(F.collect_set(F.struct("_pos", "_avg"))), lambda v: v["_avg"]
        ).alias("_avgs"),
        F.array(*acf).alias("_acf"),
    )
    r = lambda k: F.get("_acf", F.lit(k - 1))
    inner = reduce(lambda a, k: a + r(k) * r(k), range(1, m), F.lit(0.0))
    limit = 1.645 * F.sqrt((1.0 + 2.0 * inner) / F.col("_n"))
    seasonal = F.coalesce((F.abs(r(m)) > limit) & (F.col("_n") >= 2 * m), F.lit(False))
    middle = F.aggregate("_avgs", F.lit(0.0), lambda a, x: a + x) / m
    mult = F.col("_low") > 0
    index = F.transform("_avgs", lambda x: F.when(mult, x / middle).otherwise(x - middle))
    neutral = F.transform("_avgs", lambda x: F.when(mult, F.lit(1.0)).otherwise(F.lit(0.0)))
    return got.withColumn("_mult", mult).withColumn(
        "_index", F.when(seasonal, index).otherwise(neutral)
    )


def alpha_grid(step: float = 0.05) -> list[float]:
    return [round(step * i, 6) for i in range(1, int(round(1 / step)))]


def theta(
    history: DataFrame,
    h: int,
    by: Sequence[str] = ID,
    m: int = 7,
    alphas: Sequence[float] | None = None,
) -> DataFrame:
    """Theta method with theta = 2: exponential smoothing plus half the trend slope.

    The series is seasonally adjusted first if its autocorrelation at the season is
    significant: by ratio where all values are positive, else by difference. The
    smoothing weight is the grid value with the least squared one-step error; finding it
    is the one step done in NumPy, over arrays that Spark deals out.
    """
    smooth = best_ses(alphas or alpha_grid())
    prof = _seasonal_profile(history, m, by)
    idx = lambda pos: F.get("_index", pos.cast("int"))
    z = F.transform(
        "_values",
        lambda v: F.when(F.col("_mult"), v["y"] / idx(v["pos"])).otherwise(v["y"] - idx(v["pos"])),
    )

    n = F.col("_n").cast("double")
    mid = (n + 1.0) / 2.0
    moment = F.aggregate(
        F.transform("_z", lambda x, i: x * (i + 1 - mid)), F.lit(0.0), lambda s, x: s + x
    )
    slope = F.when(n > 1, moment / F.when(n > 1, n * (n * n - 1.0) / 12.0)).otherwise(F.lit(0.0))
    fitted = (
        prof.withColumn("_z", z)
        .withColumn("_best", smooth("_z"))
        .withColumn("_slope", slope)
        .select(*by, "_last", "_n", "_mult", "_index", "_best", "_slope")
    )
    a = F.col("_best.a")
    drift = (F.col("_slope") / 2.0) * (
        (F.col("step") - 1.0) + 1.0 / a - F.pow(1.0 - a, F.col("_n").cast("double")) / a
    )
    level = F.col("_best.l") + drift
    pos = idx(F.pmod(F.col("_n") + F.col("step") - 1, F.lit(m)))
    value = F.when(F.col("_mult"), level * pos).otherwise(level + pos)
    return _steps(fitted, h).select(*by, "ds", value.alias("forecast"))


# fixed values: smoothing weights tried by the exponential smoothing selection
ETS_ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
ETS_BETAS = (0.01, 0.05, 0.1)
ETS_GAMMAS = (0.05, 0.1)


def ets(
    history: DataFrame,
    h: int,
    by: Sequence[str] = ID,
    m: int = 7,
    alphas: Sequence[float] = ETS_ALPHAS,
    betas: Sequence[float] = ETS_BETAS,
    gammas: Sequence[float] = ETS_GAMMAS,
) -> DataFrame:
    """Best additive-error smoothing per series: level, trend, or trend and season.

    A grid stands in for a numeric optimiser; the family is chosen by AICc. Seasonal and
    trend members need two full seasons.
    """
    pairs = F.sort_array(F.collect_list(F.struct("ds", "y")))
    rows = history.groupBy(*by).agg(
        F.max("ds").alias("_last"), F.transform(pairs, lambda p: p["y"]).alias("_y")
    )
    fitted = rows.select(*by, "_last", best_ets(m, alphas, betas, gammas)("_y").alias("_fit"))
    season = F.get("_fit.s", F.pmod(F.col("step") - 1, F.lit(m)).cast("int"))
    value = F.col("_fit.l") + F.col("_fit.b") * F.col("step") + season
    return _steps(fitted, h).select(
        *by, "ds", value.alias("forecast"), F.col("_fit.kind").alias("kind")
    )


# fixed values: statistical model name -> forecaster
FORECASTERS: dict[str, Callable] = {
    "Naive": naive,
    "SeasonalNaive": seasonal_naive,
    "Theta": theta,
    "AutoTheta": partial(theta, alphas=alpha_grid(0.02)),
    "AutoETS": ets,
}


def forecast(
    history: DataFrame,
    h: int,
    models: Sequence[str] | Mapping[str, Mapping],
    by: Sequence[str] = ID,
) -> DataFrame:
    """Wide forecast ``by, ds, <model columns>``; unknown names are an error.

    ``models`` may map a name to the forecaster's options.
    """
    named = dict(models) if isinstance(models, Mapping) else {m: {} for m in models}
    unknown = [m for m in named if m not in FORECASTERS]
    if unknown:
        raise ValueError(f"unknown model {unknown}; have {sorted(FORECASTERS)}")
    parts = [
        FORECASTERS[m](history, h, by, **opts).select(
            *by, "ds", F.lit(m).alias("_model"), F.col("forecast").cast("double")
        )
        for m, opts in named.items()
    ]
    # one row per series and step each: stacked and turned by a single small shuffle
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy(*by, "ds").agg(
        *[F.max(F.when(F.col("_model") == m, F.col("forecast"))).alias(m) for m in named]
    )


def rolling_origins(
    history: DataFrame, h: int, n_windows: int = 1, step: int | None = None
) -> DataFrame:
    """Training rows once per cutoff they belong to, with the ``cutoff`` date.

    Cutoffs count back on the distinct dates: the last leaves ``h`` dates to score. History is
    exchanged by series first and multiplied inside the tasks, so every row crosses the network
    once however many cutoffs there are; what groups by series and cutoff afterwards needs no
    further exchange, and forecasters of one evaluation read the same one.
    """
    step = step or h
    places = [h + step * i for i in range(n_windows)]
    latest = last_dates(history, max(places) + 1, "ds")
    cuts = F.filter(
        F.array(*[F.get(F.col("_latest"), F.lit(p)) for p in places]), lambda c: c.isNotNull()
    )
    return (
        history.select("unique_id", "ds", "y")
        .repartition("unique_id")
        .withColumn("_latest", latest)
        .withColumn("cutoff", F.explode(cuts))
        .filter(F.col("ds") <= F.col("cutoff"))
        .select("unique_id", "ds", "y", "cutoff")
    )


def cross_validate(
    history: DataFrame,
    h: int,
    models: Sequence[str] | Mapping[str, Mapping],
    n_windows: int = 1,
    step: int | None = None,
) -> DataFrame:
    """Rolling-origin evaluation: ``unique_id, ds, cutoff, y, <models>``, all cutoffs at once."""
    train = rolling_origins(history, h, n_windows, step)
    wide = forecast(train, h, models, by=("unique_id", "cutoff"))
    actual = history.select("unique_id", "ds", "y")
    names = list(models)
    return wide.join(actual, ["unique_id", "ds"]).select("unique_id", "ds", "cutoff", "y", *names)


def refit_winner(
    history: DataFrame, h: int, models: Sequence[str], n_windows: int = 1, step: int | None = None
) -> tuple[str, DataFrame]:
    """Score all models by CV, then forecast with the best one only."""
    scores = score_models(cross_validate(history, h, models, n_windows, step), list(models))
    winner = scores.head()["model"]
    return winner, forecast(history, h, [winner]).withColumnRenamed(winner, "forecast")


def forecast_on_rows(rows: DataFrame, forecasts: DataFrame, value: str = "forecast") -> DataFrame:
    """Forecast of each (unique_id, ds) row, clamped; a miss is 0.

    ``is_cold_start`` marks rows whose series has no forecast at all.
    """
    f = forecasts.select("unique_id", "ds", clamp(F.col(value)).alias("_p"))
    known = forecasts.select("unique_id").distinct().withColumn("_known", F.lit(True))
    return (
        rows.join(f, ["unique_id", "ds"], "left")
        .join(known, "unique_id", "left")
        .withColumn("predicted", F.coalesce("_p", F.lit(0.0)))
        .withColumn("is_cold_start", F.col("_known").isNull())
        .drop("_p", "_known")
    )


def to_submission(future: DataFrame, forecasts: DataFrame, value: str = "forecast") -> DataFrame:
    return (
        forecast_on_rows(future, forecasts, value)
        .select("id", F.col("predicted").alias("sales"))
        .orderBy("id")
    )


def holdout_score(long: DataFrame, model: str, days: int = 16) -> DataFrame:
    """Hide the last ``days`` dates, forecast them, score on the row id."""
    train, val = timeseries_split(long, days, "ds")
    preds = forecast_on_rows(
        val.select("id", "unique_id", "ds"), forecast(train, days, [model]), model
    )
    return (
        val.select("id", F.col("y").alias("actual"))
        .join(preds.select("id", "predicted"), "id")
        .agg(rmsle(F.col("actual"), F.col("predicted")).alias("rmsle"))
    )
