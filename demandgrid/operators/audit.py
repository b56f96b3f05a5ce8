"""Error audit: enriched holdout, series bootstrap and residual discovery."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.errors import (
    log_residual,
    metric_aggregates,
    rmsle,
    squared_log_error,
)
from demandgrid.operators.encode import Ordinal, standardized
from demandgrid.operators.models import fit_ridge
from demandgrid.operators.prep import fill_missing, first_per_key
from demandgrid.operators.quantiles import exact_quantiles
from demandgrid.operators.ranks import digest_bound, series_hash
from demandgrid.session import materialize

# fixed values: columns offered to residual discovery
DISCOVERY = (
    "store_nbr",
    "family",
    "type",
    "cluster",
    "velocity_mean",
    "dayofweek",
    "onpromotion",
    "is_holiday",
)
# fixed values: metadata joined to the holdout
META = ("type", "cluster", "city", "state", "onpromotion", "is_holiday", "dcoilwtico")
ROW_KEY = ["date", "store_nbr", "family"]
SERIES = ["store_nbr", "family"]


def enrich_holdout(val: DataFrame, merged: DataFrame, velocity: DataFrame) -> DataFrame:
    """Holdout rows with metadata, velocity tier, weekday and log errors.

    The metadata is reduced to the holdout's dates before its dedup and join, so the
    long history is only scanned, not shuffled.
    """
    meta_cols = [c for c in META if c in merged.columns]
    start = val.agg(F.min("date").alias("d")).scalar()
    recent = merged.select(*ROW_KEY, *meta_cols).filter(F.col("date") >= start)
    meta = first_per_key(recent, ROW_KEY, meta_cols)
    y, p = F.col("actual"), F.col("predicted")
    out = (
        val.join(meta, ROW_KEY, "left")
        .join(velocity, SERIES, "left")
        .withColumn("dayofweek", F.weekday("date"))
    )
    return fill_missing(out).withColumns(
        {
            "sle": squared_log_error(y, p),
            "log_resid": log_residual(y, p),
            "abs_log_err": F.abs(log_residual(y, p)),
        }
    )


def _poisson_steps() -> list[int]:
    """Distribution function of Poisson(1) at 0, 1, ... in units of 2 ** -32."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, 13):
        total += term
        out.append(int(total * 2**32))
        term /= k
    return out


POISSON_STEPS = _poisson_steps()


def _uniform(*parts: Column) -> Column:
    """32 digest bits of the parts as a number."""
    digest = F.md5(F.concat_ws("-", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _resampled(per_series: DataFrame, sums: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Sums per replicate in which each series counts a Poisson(1) number of times.

    The count is drawn from a digest of (replicate, series, seed), so nothing is joined or
    ranked: a task adds up its own series and shuffles one row per replicate.
    """
    draws = per_series.withColumn("_key", series_hash(*SERIES)).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))
    )
    x = _uniform(F.col("b"), F.col("_key"), F.lit(seed))
    times = reduce(lambda a, b: a + b, [(F.col("_x") >= t).cast("int") for t in POISSON_STEPS])
    weighted = draws.withColumn("_x", x).withColumn("_w", times)
    return weighted.groupBy("b").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in sums])


def bootstrap_rmsle(val: DataFrame, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """Global RMSLE with a series-level bootstrap mean and 95 % interval.

    RMSLE needs only the row count and the summed squared log error of a series, so rows
    are never replicated. Without series every value is missing and the counts are zero.
    """
    sle = squared_log_error(F.col("actual"), F.col("predicted"))
    per_series = materialize(
        val.groupBy(*SERIES).agg(F.count(sle).alias("n"), F.sum(sle).alias("sle")), "series"
    )
    scores = _resampled(per_series, ["n", "sle"], n_boot, seed).select(
        F.sqrt(F.try_divide("sle", "n")).alias("s")  # missing if no series was drawn
    )
    point = per_series.agg(
        F.struct(
            F.sqrt(F.sum("sle") / F.sum("n")).alias("val_rmsle"),
            F.count(F.lit(1)).alias("n_series"),
        ).alias("p")
    ).scalar()
    # n_boot values, a fixed number
    spread = scores.agg(
        F.avg("s").alias("val_rmsle_boot_mean"),
        F.percentile("s", F.lit(0.025)).alias("val_rmsle_ci_low"),
        F.percentile("s", F.lit(0.975)).alias("val_rmsle_ci_high"),
        F.count(F.lit(1)).alias("n_boot"),
    )
    return spread.withColumn("_p", point).select("_p.*", *spread.columns)


def paired_bootstrap(a: DataFrame, b: DataFrame, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """RMSLE(a) - RMSLE(b) on common rows with the same draws for both (negative: a better)."""
    left = a.select(*SERIES, "date", "actual", "predicted")
    right = b.select(*SERIES, "date", F.col("predicted").alias("predicted_b"))
    sa = squared_log_error(F.col("actual"), F.col("predicted"))
    sb = squared_log_error(F.col("actual"), F.col("predicted_b"))
    per_series = materialize(
        left.join(right, [*SERIES, "date"])
        .groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(sa).alias("sa"), F.sum(sb).alias("sb")),
        "series",
    )
    delta = F.sqrt(F.try_divide("sa", "n")) - F.sqrt(F.try_divide("sb", "n"))
    deltas = _resampled(per_series, ["n", "sa", "sb"], n_boot, seed).select(delta.alias("d"))
    whole = F.sqrt(F.sum("sa") / F.sum("n")) - F.sqrt(F.sum("sb") / F.sum("n"))
    point = per_series.agg(
        F.struct(
            whole.alias("delta_rmsle"), F.count(F.lit(1)).alias("n_series")
        ).alias("p")
    ).scalar()
    spread = deltas.agg(
        F.percentile("d", F.lit(0.025)).alias("delta_ci_low"),
        F.percentile("d", F.lit(0.975)).alias("delta_ci_high"),
        F.avg((F.col("d") >= 0).cast("double")).alias("p_a_worse"),
        F.count(F.lit(1)).alias("n_boot"),
    )
    return spread.withColumn("_p", point).select("_p.*", *spread.columns)


def bias_sign_flip(slices: DataFrame) -> DataFrame:
    """Whether the velocity tiers are biased in different directions."""
    tiers = slices.filter((F.col("axis") == "velocity_tier") & (F.col("bias_pct") != 0))
    return tiers.agg((F.countDistinct(F.signum("bias_pct")) > 1).alias("bias_sign_flip"))


def high_error_rows(val: DataFrame, top_share: float = 0.2) -> DataFrame:
    """Rows whose absolute log error reaches the upper quantile."""
    cut = exact_quantiles(val, "abs_log_err", [1.0 - top_share], ["q"])
    return val.filter(F.col("abs_log_err") >= cut.agg(F.max("q").alias("q")).scalar())


def _encoded(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    enc = Ordinal.fit(df, [c for c in features if c in df.columns])
    cols = enc.columns()
    return df.withColumns({f"_x_{n}": e for n, e in cols.items()}), [f"_x_{n}" for n in cols]


def error_tree_leaves(
    val: DataFrame,
    features: Sequence[str] = DISCOVERY,
    max_depth: int = 4,
    min_leaf: int = 50,
    top_k: int = 8,
) -> DataFrame:
    """Worst leaves of a shallow tree on the absolute log error, with the tree's rules."""
    spark = val.sparkSession
    schema = "leaf_id bigint, n bigint, mean_abs_log_err double, rmsle double, rules string"
    if val.limit(max(2 * min_leaf, 20)).count() < max(2 * min_leaf, 20):
        return spark.createDataFrame([], schema)
    rows, names = _encoded(val, features)
    if not names:
        return spark.createDataFrame([], schema)
    data = VectorAssembler(inputCols=names, outputCol="_features").transform(rows)
    tree = DecisionTreeRegressor(
        featuresCol="_features",
        labelCol="abs_log_err",
        maxDepth=max_depth,
        minInstancesPerNode=min_leaf,
        maxBins=256,
        leafCol="_leaf",
        seed=42,
    ).fit(data)
    rules = tree.toDebugString
    for i, n in sorted(enumerate(names), reverse=True):
        rules = rules.replace(f"feature {i} ", f"{n.removeprefix('_x_')} ")
    return (
        tree.transform(data)
        .groupBy(F.col("_leaf").cast("bigint").alias("leaf_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("abs_log_err").alias("mean_abs_log_err"),
            rmsle(F.col("actual"), F.col("predicted")).alias("rmsle"),
        )
        .orderBy(F.col("mean_abs_log_err").desc(), "leaf_id")
        .limit(top_k)
        .withColumn("rules", F.lit(rules))
    )


def multiaccuracy_audit(
    val: DataFrame,
    features: Sequence[str] = DISCOVERY,
    alpha: float = 1.0,
    val_frac: float = 0.25,
    seed: int = 42,
) -> DataFrame:
    """Ridge on the log residual, scored on a random quarter: is structure left?

    One row per coefficient, the ten largest by size, with R2 and the row counts. The
    holdout is exactly the first quarter in the order of a seeded row digest (rows of one key
    stay together); the quarter's last digest is selected by counts, no row is ranked.
    """
    spark = val.sparkSession
    schema = "r2 double, n_train bigint, n_val bigint, feature string, coef double"
    n = val.count()
    if n < 40:
        return spark.createDataFrame([(None, 0, 0, None, None)], schema)
    rows, names = _encoded(val, features)
    key = F.concat_ws("-", *[F.col(c) for c in ROW_KEY], F.lit(seed))
    placed = materialize(rows.withColumn("_digest", F.md5(key)), "placed")
    bound = digest_bound(placed, "_digest", max(1, int(n * val_frac)))
    train, held = placed.filter(F.col("_digest") >= bound), placed.filter(F.col("_digest") < bound)
    model = fit_ridge(train, names, "log_resid", alpha)
    y, p = F.col("log_resid"), model.predict(names)
    got = held.agg(
        F.sum((y - p) * (y - p)).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.count(F.lit(1)).alias("n_val"),
    ).head()
    r2 = None if not got["sst"] else 1.0 - got["sse"] / got["sst"]
    top = sorted(zip(names, model.coefficients), key=lambda nc: -abs(nc[1]))[:10]
    return spark.createDataFrame(
        [(r2, n - got["n_val"], got["n_val"], c.removeprefix("_x_"), float(w)) for c, w in top], schema
    )


def _mix(df: DataFrame, col: str, name: str) -> DataFrame:
    """Share of each value per cluster as a map, rounded to 3 places."""
    counts = df.groupBy("resid_cluster", F.col(col).cast("string").alias("v")).count()
    whole = F.sum("count").over(Window.partitionBy("resid_cluster"))
    return (
        counts.filter(F.col("v").isNotNull())
        .withColumn("s", F.round(F.col("count") / whole, 3))
        .groupBy("resid_cluster")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "s")))).alias(name))
    )


def residual_clusters(
    val: DataFrame,
    features: Sequence[str] = DISCOVERY,
    top_share: float = 0.2,
    k: int = 5,
    seed: int = 42,
    starts: int = 3,
) -> DataFrame:
    """k-means on the rows with the largest errors; size, scores and make-up per cluster.

    Mixes are sized by families, tiers and store types, not by rows.
    """
    schema = (
        "resid_cluster int, n bigint, mean_abs_log_err double, rmsle double, bias_pct double,"
        " top_families map<string,bigint>, velocity_tier_mix map<string,double>,"
        " type_mix map<string,double>"
    )
    spark = val.sparkSession
    high = high_error_rows(val, top_share)
    if val.limit(5 * k).count() < 5 * k or high.limit(k).count() < k:
        return spark.createDataFrame([], schema)
    rows, names = _encoded(high, features)
    if not names:
        return spark.createDataFrame([], schema)
    scaled = standardized(rows, names)
    data = VectorAssembler(inputCols=names, outputCol="_features").transform(scaled)
    fits = [
        KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol="resid_cluster").fit(data)
        for i in range(starts)
    ]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    marked = best.transform(data)
    m = metric_aggregates(F.col("actual"), F.col("predicted"))
    base = marked.groupBy("resid_cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("abs_log_err").alias("mean_abs_log_err"),
        m["rmsle"].alias("rmsle"),
        m["bias_pct"].alias("bias_pct"),
    )
    w = Window.partitionBy("resid_cluster").orderBy(F.col("count").desc(), "family")
    top = (
        marked.groupBy("resid_cluster", "family")
        .count()
        .withColumn("r", F.row_number().over(w))
        .filter("r <= 3")
        .groupBy("resid_cluster")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "count")))).alias(
                "top_families"
            )
        )
    )
    out = base.join(top, "resid_cluster", "left")
    for col, name in (("velocity_tier", "velocity_tier_mix"), ("type", "type_mix")):
        if col in val.columns:
            out = out.join(_mix(marked, col, name), "resid_cluster", "left")
    return out.orderBy(F.col("mean_abs_log_err").desc())
