"""Training, evaluation and audit jobs on the feature plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.errors import encode_target, rmsle
from demandgrid.operators.audit import (
    bias_sign_flip,
    bootstrap_rmsle,
    enrich_holdout,
    error_tree_leaves,
    multiaccuracy_audit,
    paired_bootstrap,
    residual_clusters,
)
from demandgrid.operators.metrics import (
    row_metrics,
    shift_summary,
    slice_scores,
    velocity_tiers,
    worst_families,
)
from demandgrid.operators.models import FittedPanelModel, fit_panel_model
from demandgrid.operators.recursive import recursive_forecast
from demandgrid.operators.splits import (
    filter_validation,
    nth_last_date,
    timeseries_split,
    walk_forward_split,
)
from demandgrid.plans.features import combined_features, feature_roles
from demandgrid.session import materialize
from demandgrid.settings import FeatureSettings, Roll
from demandgrid.sources.tables import write_audit_outputs

ROW = ["store_nbr", "family", "date"]


def in_target_space(settings: FeatureSettings, transform: str) -> FeatureSettings:
    """Settings whose target-based lags and windows read the transformed target."""
    if transform != "log1p":
        return settings
    name = {settings.target: "log_sales"}
    return replace(
        settings,
        lags={name.get(c, c): ks for c, ks in settings.lags.items()},
        rolls=tuple(Roll(name.get(r.col, r.col), r.windows, r.aggs) for r in settings.rolls),
    )


@dataclass
class TrainedPanel:
    """A fitted model with its feature rows; ``features`` is a written table."""

    model: FittedPanelModel
    settings: FeatureSettings
    features: DataFrame
    label: str
    val_days: int

    @property
    def known(self) -> DataFrame:
        return self.features.filter("is_train")

    @property
    def future(self) -> DataFrame:
        return self.features.filter("not is_train")


def prepare_features(
    train: DataFrame,
    test: DataFrame,
    settings: FeatureSettings,
    transform: str = "raw",
    holidays: DataFrame | None = None,
    strategy: str = "series",
) -> tuple[DataFrame, FeatureSettings, str]:
    """Feature rows of train and test, written once, and the label column's name."""
    used = in_target_space(settings, transform)
    label = settings.target
    if transform == "log1p":
        label = "log_sales"
        train = train.withColumn(label, encode_target(F.col(settings.target), transform))
    rows = combined_features(train, test, used, holidays, strategy)
    return materialize(rows, "features"), used, label


def fit_on(
    rows: DataFrame,
    kind: str,
    settings: FeatureSettings,
    label: str,
    transform: str,
    options: Mapping | None = None,
    features: tuple[Sequence[str], Sequence[str]] | None = None,
) -> FittedPanelModel:
    """``features`` names (categorical, numeric) inputs; by default the allow-list."""
    categorical, numeric = features or feature_roles(rows, settings)
    return fit_panel_model(
        rows, kind, label, categorical, numeric, settings.history_names(), transform, options
    )


def train_panel(
    train: DataFrame,
    test: DataFrame,
    settings: FeatureSettings,
    kind: str = "ridge",
    transform: str = "raw",
    holidays: DataFrame | None = None,
    val_days: int = 16,
    options: Mapping | None = None,
    strategy: str = "series",
) -> TrainedPanel:
    """Feature plan, then a fit on everything before the last ``val_days`` dates."""
    rows, used, label = prepare_features(train, test, settings, transform, holidays, strategy)
    before, _ = timeseries_split(rows.filter("is_train"), val_days, settings.date_col)
    model = fit_on(before, kind, used, label, transform, options)
    return TrainedPanel(model, used, rows, label, val_days)


def _frame(rows: DataFrame, actual: str | None, split: str) -> DataFrame:
    a = F.col(actual) if actual else F.lit(None).cast("double")
    return rows.select(*ROW, a.alias("actual"), "predicted", F.lit(split).alias("split"))


def direct_predictions(run: TrainedPanel) -> DataFrame:
    """One-shot predictions of all rows, labelled train, val and test."""
    cut = nth_last_date(run.known, run.val_days)
    known = _frame(run.model.predict(run.known), run.settings.target, "train").withColumn(
        "split", F.when(F.col("date") >= cut, "val").otherwise("train")
    )
    return known.unionByName(_frame(run.model.predict(run.future), None, "test"))


def recursive_predictions(run: TrainedPanel) -> DataFrame:
    """In-sample rows predicted directly, validation and test rows day by day."""
    before, held = timeseries_split(run.known, run.val_days)
    inside = _frame(run.model.predict(before), run.settings.target, "train")
    val = recursive_forecast(run.model, before, held, run.settings, run.label).join(
        held.select(*ROW, run.settings.target), ROW
    )
    test = recursive_forecast(run.model, run.known, run.future, run.settings, run.label)
    return (
        inside.unionByName(_frame(val, run.settings.target, "val"))
        .unionByName(_frame(test, None, "test"))
    )


def daily_frame(preds: DataFrame) -> DataFrame:
    """Date, actual and prediction of every known row."""
    return preds.filter("split <> 'test'").select("date", "actual", "predicted")


def walk_forward_evaluation(
    train: DataFrame,
    test: DataFrame,
    settings: FeatureSettings,
    windows: Sequence[int] = (30, 60, 90),
    kind: str = "ridge",
    transform: str = "raw",
    holidays: DataFrame | None = None,
    options: Mapping | None = None,
    strategy: str = "series",
    features: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """Per window one-shot and recursive RMSLE with row counts.

    The feature rows are computed once; each window costs one fit, which needs the driver,
    and one scoring plan. The windows are a handful.
    """
    rows, used, label = prepare_features(train, test, settings, transform, holidays, strategy)
    known = rows.filter("is_train")
    target = settings.target
    parts = []
    for before, held, name in walk_forward_split(known, windows):
        model = fit_on(before, kind, used, label, transform, options, features)
        direct = model.predict(held).select(*ROW, F.col("predicted").alias("one_shot"))
        rolled = recursive_forecast(model, before, held, used, label).withColumnRenamed(
            "predicted", "recursive"
        )
        n_train = before.agg(F.count(F.lit(1)).alias("n")).scalar()
        scored = (
            held.select(*ROW, target)
            .join(direct, ROW)
            .join(rolled, ROW)
            .agg(
                F.round(rmsle(F.col(target), F.col("one_shot")), 6).alias("one_shot_rmsle"),
                F.round(rmsle(F.col(target), F.col("recursive")), 6).alias("recursive_rmsle"),
                F.count(F.lit(1)).alias("n_val"),
            )
        )
        parts.append(
            scored.select(
                F.lit(name).alias("window"), "one_shot_rmsle", "recursive_rmsle",
                n_train.alias("n_train"), "n_val",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_run(
    preds: DataFrame,
    merged: DataFrame,
    train: DataFrame,
    test: DataFrame,
    other: DataFrame | None = None,
    n_boot: int = 500,
    seed: int = 42,
    val_days: int = 16,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """The whole error audit of one prediction frame, as named result tables.

    ``other`` adds the paired comparison with a second model; with ``folder`` the summary
    and the slices are written there. The enriched holdout is written once and every part
    reads it.
    """
    holdout = filter_validation(preds, val_days)
    history, late = timeseries_split(train, val_days)
    frame = materialize(
        enrich_holdout(holdout, merged, velocity_tiers(history)), "audit"
    )
    slices = materialize(slice_scores(frame), "slices")
    out = {
        "metrics": row_metrics(frame),
        "bootstrap": bootstrap_rmsle(frame, n_boot, seed),
        "slices": slices,
        "sign_flip": bias_sign_flip(slices),
        "worst_families": worst_families(frame),
        "shift": shift_summary(history, late, test),
        "error_tree": error_tree_leaves(frame),
        "multiaccuracy": multiaccuracy_audit(frame, seed=seed),
        "clusters": residual_clusters(frame, seed=seed),
    }
    if other is not None:
        out["paired"] = paired_bootstrap(
            frame, filter_validation(other, val_days), n_boot, seed
        )
    if folder is not None:
        write_audit_outputs(folder, audit_summary(out), slices)
    return out


def audit_summary(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Headline numbers of an audit as (section, metric, value) rows."""
    flat = []
    for name in ("metrics", "bootstrap", "paired", "sign_flip"):
        if name not in parts:
            continue
        df = parts[name]
        cells = [
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in df.columns
        ]
        flat.append(df.select(F.lit(name).alias("section"), F.inline(F.array(*cells))))
    shift = parts["shift"]
    names = [c for c in shift.columns if c != "period"]
    flat.append(
        shift.select(
            F.concat(F.lit("shift_"), F.col("period")).alias("section"),
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                        for c in names
                    ]
                )
            ),
        )
    )
    out = flat[0]
    for f in flat[1:]:
        out = out.unionByName(f)
    return out
