"""Global regression models fitted with Spark ML on the feature plan."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.errors import decode_target
from demandgrid.operators.encode import OneHot, Ordinal
from demandgrid.session import materialize

CELLS = 1 << 20  # numbers of a task in a boosted fit


@dataclass
class Linear:
    """Fitted weights by feature name; ``link`` is ``identity`` or ``log``."""

    names: Sequence[str]
    coefficients: Sequence[float]
    intercept: float
    link: str = "identity"

    @property
    def weights(self) -> dict[str, float]:
        return dict(zip(self.names, self.coefficients))

    def predict(self, columns: Sequence[str]) -> Column:
        """Prediction from columns that stand in the order of the features."""
        score = F.lit(float(self.intercept))
        for c, w in zip(columns, self.coefficients):
            score = score + F.col(c) * F.lit(float(w))
        return self.respond(score)

    def respond(self, score: Column) -> Column:
        return F.exp(score) if self.link == "log" else score


def _assembled(df: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """``features`` and ``label``; a vector column ``features`` is used as it is."""
    if "features" not in df.columns:
        df = VectorAssembler(inputCols=list(names), outputCol="features").transform(df)
    return df.select("features", F.col(label).cast("double").alias("label"))


def fit_ridge(df: DataFrame, names: Sequence[str], label: str, alpha: float = 1.0) -> Linear:
    """Least squares with an L2 penalty ``alpha`` and a free intercept, in closed form.

    Spark scales its penalty by the label deviation and the row count, which is undone
    here. The normal equations take a single pass over the rows.
    """
    rows = df.filter(F.col(label).isNotNull())
    st = rows.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).head()
    if not st["n"]:
        raise ValueError("no labelled rows to fit")
    model = LinearRegression(
        regParam=alpha * (st["s"] or 0.0) / st["n"],
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
    ).fit(_assembled(rows, names, label))
    return Linear(list(names), [float(w) for w in model.coefficients], float(model.intercept))


def fit_tweedie(
    df: DataFrame,
    names: Sequence[str],
    label: str,
    power: float = 1.5,
    alpha: float = 1.0,
    max_steps: int = 20,
    tol: float = 1e-7,
) -> Linear:
    """Log-link Tweedie (1 <= power < 2) regression with an L2 penalty ``alpha``.

    Scoring steps, each a weighted ridge fit of the working response, halved until the
    penalised deviance falls; Spark's own GLM takes full steps and diverges on series that
    are mostly zero. The assembled rows are written once because every step reads them.
    """
    rows = materialize(_assembled(df.filter(F.col(label).isNotNull()), names, label), "glm")
    mean = rows.agg(F.avg("label").alias("m")).head()["m"]
    beta, start = np.zeros(len(names)), math.log(max(mean, 1e-12))
    state = _tweedie_state(rows, beta, start, power, alpha)
    for _ in range(max_steps):
        # Spark scales its penalty by the label deviation, undone as for plain ridge
        step = LinearRegression(
            weightCol="w",
            regParam=alpha / state["w"] * state["s"],
            elasticNetParam=0.0,
            standardization=False,
            solver="normal",
        ).fit(_working_rows(rows, beta, start, power))
        to_beta, to_start, size = step.coefficients.toArray(), float(step.intercept), 1.0
        while True:
            new_beta = beta + size * (to_beta - beta)
            new_start = start + size * (to_start - start)
            new = _tweedie_state(rows, new_beta, new_start, power, alpha)
            if new["loss"] is not None and new["loss"] <= state["loss"]:
                break
            size /= 2
            if size < 1e-6:
                return Linear(list(names), beta.tolist(), start, "log")
        gain = state["loss"] - new["loss"]
        beta, start, state = new_beta, new_start, new
        if gain <= tol * max(abs(state["loss"]), 1.0):
            break
    return Linear(list(names), beta.tolist(), float(start), "log")


def _with_eta(rows: DataFrame, beta: np.ndarray, start: float) -> DataFrame:
    """Linear predictor of assembled rows as ``eta``, by a model with these weights."""
    weights = F.array(*[F.lit(float(b)) for b in beta])
    products = F.zip_with(vector_to_array("features"), weights, lambda x, b: x * b)
    eta = F.aggregate(products, F.lit(float(start)), lambda acc, v: acc + v)
    return rows.withColumn("eta", F.greatest(F.least(eta, F.lit(300.0)), F.lit(-300.0)))


def _working_rows(rows: DataFrame, beta: np.ndarray, start: float, power: float) -> DataFrame:
    mu = F.exp("eta")
    z = F.col("eta") + (F.col("label") - mu) / mu
    return _with_eta(rows, beta, start).select(
        "features", z.alias("label"), F.pow(mu, 2.0 - power).alias("w")
    )


def _tweedie_state(
    rows: DataFrame, beta: np.ndarray, start: float, power: float, alpha: float
) -> dict:
    """Penalised half mean deviance, mean working weight and deviation of the response."""
    y, mu = F.col("label"), F.exp("eta")
    if power == 1.0:
        half = mu - y * F.col("eta")
    else:
        half = F.pow(mu, 2 - power) / (2 - power) - y * F.pow(mu, 1 - power) / (1 - power)
    w = F.pow(mu, 2.0 - power)
    z = F.col("eta") + (y - mu) / mu
    got = _with_eta(rows, beta, start).agg(
        F.avg(half).alias("loss"),
        F.avg(w).alias("w"),
        (F.sum(w * z) / F.sum(w)).alias("z1"),
        (F.sum(w * z * z) / F.sum(w)).alias("z2"),
    ).head()
    loss = got["loss"]
    if loss is None or not math.isfinite(loss):
        return {"loss": None}
    spread = math.sqrt(max(got["z2"] - got["z1"] ** 2, 0.0))
    return {"loss": loss + alpha / 2 * float(beta @ beta), "w": got["w"], "s": spread}


@dataclass
class TreeSettings:
    n_estimators: int = 500
    learning_rate: float = 0.05
    max_depth: int = 6
    min_child_samples: int = 20
    subsample: float = 0.8
    colsample: float = 0.8
    max_bins: int = 256
    seed: int = 42


def few_tasks(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` in tasks of ``CELLS`` numbers or more. A boosted fit runs a job for each level of each
    tree, in which smaller tasks mostly wait for their start."""
    return rows.coalesce(max(-(-rows.count() * width // CELLS), 1))


def fit_trees(
    df: DataFrame, names: Sequence[str], label: str, settings: TreeSettings | None = None
):
    """Gradient boosted regression trees; returns a pipeline that assembles and predicts."""
    s = settings or TreeSettings()
    vec = VectorAssembler(inputCols=list(names), outputCol="_features")
    gbt = GBTRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol="_prediction",
        maxIter=s.n_estimators,
        stepSize=s.learning_rate,
        maxDepth=s.max_depth,
        minInstancesPerNode=s.min_child_samples,
        subsamplingRate=s.subsample,
        featureSubsetStrategy=str(s.colsample),
        maxBins=s.max_bins,
        seed=s.seed,
    )
    keep = list(dict.fromkeys([*names, label]))
    rows = few_tasks(materialize(df.filter(F.col(label).isNotNull()).select(*keep), "trees"), len(names))
    return PipelineModel([vec, gbt.fit(vec.transform(rows))])


# fixed values: linear model kinds and their default options
LINEAR_KINDS = {"ridge": {}, "tweedie": {"power": 1.5}, "poisson": {"power": 1.0}}


@dataclass
class FittedPanelModel:
    """A fitted model with everything needed to score a feature frame again."""

    kind: str
    target: str
    transform: str
    categorical: Sequence[str]
    numeric: Sequence[str]
    encoder: OneHot | Ordinal
    linear: Linear | None = None
    trees: PipelineModel | None = None
    history: Sequence[str] = field(default_factory=tuple)

    def static_score(self, available: Sequence[str], skip: Sequence[str] | None = None) -> Column:
        """Linear score without the features in ``skip``: intercept, numbers and categories.

        By default it leaves out all history features; a recursion leaves out only those it
        computes itself, lags of columns that are known ahead stay in.

        A category costs one lookup in a literal map instead of a column per level.
        """
        w = self.linear.weights
        score = F.lit(float(self.linear.intercept))
        skip = self.history if skip is None else skip
        for c in dict.fromkeys([*self.encoder.numeric, *self.history]):
            if c in skip or c not in available or c not in w:
                continue
            score = score + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w[c])
        for c, values in self.encoder.categories.items():
            if c not in available or len(values) < 2:
                continue
            pairs = [x for v in values[1:] for x in (F.lit(v), F.lit(w[f"{c}_{v}"]))]
            table = F.create_map(*pairs)
            score = score + F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0))
        return score

    def score(self, available: Sequence[str]) -> Column:
        w = self.linear.weights
        total = self.static_score(available)
        for c in self.history:
            if c in available:
                total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w[c])
        return total

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """Direct scoring in sales units, never negative."""
        if self.linear is not None:
            raw = self.linear.respond(self.score(df.columns))
            return df.withColumn(name, decode_target(raw, self.transform))
        coded = tree_columns(df, self.encoder)
        out = self.trees.transform(coded)
        return out.select(
            *df.columns, decode_target(F.col("_prediction"), self.transform).alias(name)
        )


def tree_columns(df: DataFrame, encoder: Ordinal) -> DataFrame:
    return df.withColumns({f"_x_{n}": e for n, e in encoder.columns().items()})


def fit_panel_model(
    train: DataFrame,
    kind: str,
    label: str,
    categorical: Sequence[str],
    numeric: Sequence[str],
    history: Sequence[str] = (),
    transform: str = "raw",
    options: Mapping | None = None,
) -> FittedPanelModel:
    """Encode, fit and keep the encoding. ``kind``: ridge, tweedie, poisson or trees.

    ``label`` must already be in target space (see ``encode_target``). Only the listed
    columns are used, and the label may not be one of them.
    """
    used = {*categorical, *numeric}
    if label in used:
        raise ValueError("the label must not be a feature")
    options = dict(options or {})
    if kind == "trees":
        enc = Ordinal.fit(train, [*categorical, *numeric])
        coded = tree_columns(train, enc)
        names = [f"_x_{n}" for n in enc.names]
        trees = fit_trees(coded, names, label, options.get("trees"))
        return FittedPanelModel(
            kind, label, transform, list(categorical), list(numeric), enc,
            trees=trees, history=list(history),
        )
    if kind not in LINEAR_KINDS:
        raise ValueError(f"unknown model kind {kind!r}; have {[*LINEAR_KINDS, 'trees']}")
    enc = OneHot.fit(train, categorical, numeric)
    coded = enc.vectors(train, "features", keep=[label])
    merged = {**LINEAR_KINDS[kind], **options}
    fit = fit_ridge if kind == "ridge" else fit_tweedie
    linear = fit(coded, enc.names, label, **merged)
    return FittedPanelModel(
        kind, label, transform, list(categorical), list(numeric), enc,
        linear=linear, history=list(history),
    )
