"""Score, summary and distribution tables over prediction frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.errors import (
    DENOM_FLOOR,
    metric_aggregates,
    rmsle,
    squared_log_error,
)
from demandgrid.operators.quantiles import exact_quantiles
from demandgrid.session import materialize

# fixed values: the axes of the slice report
SLICE_AXES = (
    "family",
    "store_nbr",
    "type",
    "cluster",
    "velocity_tier",
    "dayofweek",
    "onpromotion",
)


def _named(exprs: dict[str, Column]) -> list[Column]:
    return [e.alias(n) for n, e in exprs.items()]


def row_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """rmsle, mae, wmape, bias_pct and rmse, over everything or per group."""
    return df.groupBy(*by).agg(*_named(metric_aggregates(F.col(actual), F.col(predicted))))


def global_rmsle(df: DataFrame, actual: str = "actual", predicted: str = "predicted"):
    return df.agg(rmsle(F.col(actual), F.col(predicted)).alias("rmsle"))


def family_scores(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("family")
        .agg(
            F.count(F.lit(1)).alias("n"),
            rmsle(F.col("actual"), F.col("predicted")).alias("rmsle"),
        )
        .orderBy("rmsle")
    )


def worst_families(df: DataFrame, k: int = 10) -> DataFrame:
    return family_scores(df).orderBy(F.col("rmsle").desc(), "family").limit(k)


def series_scores(df: DataFrame, keys: Sequence[str] = ("store_nbr", "family")) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rmsle(F.col("actual"), F.col("predicted")).alias("rmsle"),
        F.avg("actual").alias("mean_actual"),
        F.avg("predicted").alias("mean_predicted"),
    )


def series_score_summary(scores: DataFrame) -> DataFrame:
    """Best, median and worst series score."""
    return exact_quantiles(
        scores, "rmsle", [0.0, 0.5, 1.0], ["min_rmsle", "median_rmsle", "max_rmsle"]
    )


def extreme_series(scores: DataFrame, k: int) -> DataFrame:
    """The k worst and the k best series by score."""
    keys = ["store_nbr", "family"]
    worst = scores.orderBy(F.col("rmsle").desc(), *keys).limit(k)
    best = scores.orderBy(F.col("rmsle").asc(), *keys).limit(k)
    return worst.withColumn("side", F.lit("worst")).unionByName(
        best.withColumn("side", F.lit("best"))
    )


def top_series(df: DataFrame, k: int = 1, target: str = "sales") -> DataFrame:
    """Series with the largest total target."""
    return (
        df.groupBy("store_nbr", "family")
        .agg(F.sum(target).alias("total"))
        .orderBy(F.col("total").desc(), "store_nbr", "family")
        .limit(k)
    )


def slice_scores(df: DataFrame, axes: Sequence[str] = SLICE_AXES) -> DataFrame:
    """Score and error concentration per value of each axis that the frame has.

    One pass with GROUPING SETS: each row is expanded once per axis and combined map-side
    before the only shuffle. Missing axis values form no slice but count in the total.
    """
    have = [a for a in axes if a in df.columns]
    schema = (
        "axis string, slice string, n bigint, rmsle double, mae double, bias_pct double,"
        " wmape double, sle_share double"
    )
    if not have:
        return df.sparkSession.createDataFrame([], schema)
    y, p = F.col("actual"), F.col("predicted")
    axis_no = F.grouping_id()
    cols = {a: f"_ax{i}" for i, a in enumerate(have)}
    rows = df.select(
        "actual",
        "predicted",
        squared_log_error(y, p).alias("_sle"),
        *[F.col(a).cast("string").alias(c) for a, c in cols.items()],
    )
    m = metric_aggregates(y, p)
    names = list(cols.values())
    grouped = rows.groupingSets([[F.col(c)] for c in names], *[F.col(c) for c in names]).agg(
        axis_no.alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        *_named({k: m[k] for k in ("rmsle", "mae", "bias_pct", "wmape")}),
        F.sum("_sle").alias("_sum"),
    )
    full = 2 ** len(have) - 1
    axis = reduce(
        lambda acc, i: acc.when(F.col("_gid") == full - 2 ** (len(have) - 1 - i), have[i]),
        range(1, len(have)),
        F.when(F.col("_gid") == full - 2 ** (len(have) - 1), have[0]),
    )
    per_axis = Window.partitionBy("_gid")
    total = F.sum("_sum").over(per_axis)
    return (
        grouped.withColumn(
            "sle_share", F.col("_sum") / F.when(total > 0, total).otherwise(DENOM_FLOOR)
        )
        .withColumn("axis", axis)
        .withColumn("slice", F.coalesce(*names))
        .filter(F.col("slice").isNotNull())
        .select("axis", "slice", "n", "rmsle", "mae", "bias_pct", "wmape", "sle_share")
        .orderBy("axis", F.col("rmsle").desc())
    )


def velocity_tiers(history: DataFrame, target: str = "sales") -> DataFrame:
    """Mean target per series and its tertile: slow, mid or fast.

    The tertile edges are exact quantiles; if any two of the four edges coincide every
    series is ``mid``. The means are written once, so the history is read a single time.
    """
    means = materialize(
        history.groupBy("store_nbr", "family").agg(F.avg(target).alias("velocity_mean")), "means"
    )
    names = ["e0", "e1", "e2", "e3"]
    edges = exact_quantiles(means, "velocity_mean", [0.0, 1 / 3, 2 / 3, 1.0], names)
    cuts = edges.agg(F.first(F.struct(*names)).alias("e")).scalar()
    v = F.col("velocity_mean")
    e = [F.col(f"_e.{n}") for n in names]
    distinct = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3])
    tier = (
        F.when(~distinct, "mid")
        .when(v <= e[1], "slow")
        .when(v <= e[2], "mid")
        .otherwise("fast")
    )
    return means.withColumn("_e", cuts).withColumn("velocity_tier", tier).drop("_e")


def daily_aggregate(preds: DataFrame) -> DataFrame:
    return preds.groupBy("date").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )


def daily_join(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Daily totals of two frames on their common dates."""
    a = actual.groupBy("date").agg(F.sum("actual").alias("actual"))
    p = predicted.groupBy("date").agg(F.sum("predicted").alias("predicted"))
    return a.join(p, "date")


def submission_summary(subs: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Median, mean, share of zeros and share below one of the forecasts per run."""
    s = F.col("sales")
    pct = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100.0, 1)
    shares = subs.groupBy(*by).agg(
        F.round(F.avg(s), 1).alias("test_mean"),
        pct(s == 0).alias("pct_zero"),
        pct(s < 1).alias("pct_lt1"),
    )
    medians = exact_quantiles(subs, "sales", [0.5], ["test_median"], by=by)
    return shares.join(medians, list(by), "left").withColumn(
        "test_median", F.round("test_median", 3)
    )


def compare_submissions(subs: DataFrame, runs: DataFrame) -> DataFrame:
    """Forecast summaries of all runs next to their score, best first."""
    info = runs.select("run", "model_type", "val_rmsle")
    return submission_summary(subs).join(info, "run", "left").orderBy(
        F.col("val_rmsle").asc_nulls_last(), "run"
    )


def zero_share(df: DataFrame, target: str = "sales") -> DataFrame:
    """Percentage of zero rows and the median."""
    median = exact_quantiles(df, target, [0.5], ["m"]).agg(F.max("m").alias("m")).scalar()
    return df.agg(
        (F.avg(F.when(F.col(target) == 0, 1.0).otherwise(0.0)) * 100.0).alias("pct_zero")
    ).withColumn("median", median)


def value_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; the last bin is closed.

    Only bins that hold a value are returned.
    """
    v = F.col(value)
    rows = df.select(v.alias("v")).filter(F.col("v").isNotNull())
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e")).scalar()
    width = (F.col("e.hi") - F.col("e.lo")) / F.lit(float(bins))
    place = F.floor((F.col("v") - F.col("e.lo")) / F.when(width > 0, width).otherwise(1.0))
    return (
        rows.withColumn("e", ends)
        .select(F.least(place, F.lit(bins - 1)).alias("bin"), "e.lo", width.alias("w"))
        .groupBy("bin", "lo", "w")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"), "n")
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Rows, series, dates, stores and families; give a written panel, it is scanned five times.

    Each distinct set is reduced map-side on its own and reads its own columns only.
    """
    def n(*cols: str) -> Column:
        return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()

    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        n("store_nbr", "family").alias("n_series"),
        n("date").alias("n_dates"),
        n("store_nbr").alias("n_stores"),
        n("family").alias("n_families"),
    )


def score_models(wide: DataFrame, models: Sequence[str], y: str = "y") -> DataFrame:
    """RMSLE of every model column of a wide CV frame, best first."""
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models]
        )
    )
    return (
        wide.select(F.col(y).alias("_y"), cells.alias("c"))
        .groupBy(F.col("c.model").alias("model"))
        .agg(rmsle(F.col("_y"), F.col("c.p")).alias("rmsle"))
        .orderBy("rmsle", "model")
    )


def cv_summary(scores: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, best and worst window score; missing ones skipped."""
    return scores.agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def model_comparison(preds: DataFrame) -> DataFrame:
    """All row metrics per ``model`` of a stacked prediction frame, best first."""
    m = metric_aggregates(F.col("actual"), F.col("predicted"))
    return (
        preds.groupBy("model")
        .agg(F.count(F.lit(1)).alias("n"), *_named(m))
        .orderBy("rmsle", "model")
    )


def delta_vs_best(scores: DataFrame, value: str = "rmsle") -> DataFrame:
    """Distance of every model's score to the best one."""
    best = scores.agg(F.min(value).alias("b")).scalar()
    return scores.withColumn("delta", F.col(value) - best)


def model_board(preds: DataFrame) -> DataFrame:
    """Per model: overall, daily-total and average series RMSLE, and delta to the best.

    The predictions are written once for the three ways to group them.
    """
    preds = materialize(preds, "board")
    y, p = F.col("actual"), F.col("predicted")
    overall = preds.groupBy("model").agg(rmsle(y, p).alias("rmsle"))
    daily = (
        preds.groupBy("model", "date")
        .agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
        .groupBy("model")
        .agg(rmsle(y, p).alias("daily_rmsle"))
    )
    series = (
        preds.groupBy("model", "store_nbr", "family")
        .agg(rmsle(y, p).alias("s"))
        .groupBy("model")
        .agg(F.avg("s").alias("series_rmsle"))
    )
    return delta_vs_best(overall.join(daily, "model").join(series, "model"))


def relative_improvement(ref: DataFrame, new: DataFrame) -> DataFrame:
    """Per series percentage gain of ``new`` over ``ref``; NULL where ref is near zero."""
    keys = ["store_nbr", "family"]
    a = ref.select(*keys, F.col("rmsle").alias("ref_rmsle"))
    b = new.select(*keys, F.col("rmsle").alias("new_rmsle"))
    gain = (F.col("ref_rmsle") - F.col("new_rmsle")) / F.col("ref_rmsle") * 100.0
    return a.join(b, keys).withColumn(
        "improvement_pct", F.when(F.col("ref_rmsle") > 1e-9, gain)
    )


def improvement_summary(gains: DataFrame) -> DataFrame:
    """How many series got better, their share and the median gain."""
    won = F.col("improvement_pct") > 0
    median = (
        exact_quantiles(gains, "improvement_pct", [0.5], ["m"]).agg(F.max("m").alias("m")).scalar()
    )
    return gains.agg(
        F.coalesce(F.sum(won.cast("bigint")), F.lit(0)).alias("wins"),
        F.avg(won.cast("double")).alias("win_share"),
    ).withColumn("median_improvement", median)


def _family_sums(df: DataFrame, period: str) -> DataFrame:
    """Sums of ``sales`` and ``mix`` per period and family: a small table, written once."""
    have = "mix" if "mix" in df.columns else "sales"
    return materialize(
        df.groupBy(F.col(period).alias("period"), "family").agg(
            F.coalesce(F.sum("sales"), F.lit(0.0)).alias("sales"),
            F.coalesce(F.sum(have), F.lit(0.0)).alias("mix"),
        ),
        "mix",
    )


def _entropy(sums: DataFrame) -> DataFrame:
    """Shannon entropy of the family shares per period, natural log."""
    total = F.sum("sales").over(Window.partitionBy("period"))  # a row per family
    p = F.col("_p")
    return (
        sums.withColumn("_t", total)
        .withColumn("_p", F.col("sales") / F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t")))
        .groupBy("period")
        .agg(
            F.coalesce(-F.sum(F.when(p > 0, p * F.log(p))), F.lit(0.0)).alias("family_mix_entropy")
        )
    )


def _period_base(df: DataFrame, period: str) -> DataFrame:
    return df.groupBy(F.col(period).alias("period")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.coalesce(F.col("onpromotion"), F.lit(0)).cast("double")).alias("promotion_rate"),
        F.avg(F.coalesce(F.col("is_holiday"), F.lit(0)).cast("double")).alias("holiday_rate"),
        F.avg("dcoilwtico").alias("oil_mean"),
        F.stddev_samp("dcoilwtico").alias("oil_std"),
    )


def period_summaries(df: DataFrame, period: str = "period") -> DataFrame:
    """Rows, promotion and holiday rate, oil moments and family-mix entropy per period."""
    return _period_base(df, period).join(_entropy(_family_sums(df, period)), "period", "left")


def _js(sums: DataFrame, a: str, b: str) -> DataFrame:
    """Jensen-Shannon divergence of two periods from their family sums."""
    def part(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period") == name, F.col("mix"))), F.lit(0.0))

    whole = Window.partitionBy()  # a row per family
    shares = (
        sums.filter(F.col("period").isin(a, b))
        .groupBy("family")
        .agg(part(a).alias("sa"), part(b).alias("sb"))
        .select(
            (F.col("sa") / (F.sum("sa").over(whole) + 1e-12)).alias("pa"),
            (F.col("sb") / (F.sum("sb").over(whole) + 1e-12)).alias("pb"),
        )
    )
    m = F.greatest(0.5 * (F.col("pa") + F.col("pb")), F.lit(1e-12))

    def kl(p: str) -> Column:
        x = F.col(p)
        return F.coalesce(F.sum(F.when(x > 0, x * F.log(x / m))), F.lit(0.0))

    return shares.agg((0.5 * kl("pa") + 0.5 * kl("pb")).alias("js"))


def family_mix_js(df: DataFrame, a: str, b: str, period: str = "period") -> DataFrame:
    """Jensen-Shannon divergence of the family sales mix of two periods, natural log.

    Shares have 1e-12 added to the total; a family missing in one period counts as zero.
    """
    return _js(_family_sums(df, period), a, b)


def shift_summary(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """Period summaries plus the mix divergence of each period from train.

    A test frame without target counts as zero sales in its summary and as one unit per
    row in the divergence. The rows are read twice: for the rates and for the family sums.
    """
    cols = ["family", "onpromotion", "is_holiday", "dcoilwtico"]

    def tagged(df: DataFrame, name: str) -> DataFrame:
        sales = F.col("sales") if "sales" in df.columns else F.lit(None).cast("double")
        mix = F.col("sales") if "sales" in df.columns else F.lit(1.0)
        have = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in cols]
        return df.select(
            F.lit(name).alias("period"), *have, sales.alias("sales"), mix.alias("mix")
        )

    rows = tagged(train, "train").unionByName(tagged(val, "val")).unionByName(tagged(test, "test"))
    sums = _family_sums(rows, "period")
    js = [
        _js(sums, "train", p).select(F.lit(p).alias("period"), F.col("js").alias("js_from_train"))
        for p in ("val", "test")
    ]
    return (
        _period_base(rows, "period")
        .join(_entropy(sums), "period", "left")
        .join(js[0].unionByName(js[1]), "period", "left")
        .withColumn("js_from_train", F.coalesce("js_from_train", F.lit(0.0)))
    )
