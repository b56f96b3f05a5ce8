"""Tree ensembles as flat arrays, boosting with a log link, and recursion in one map.

A fitted ensemble is a few arrays whose size depends on its settings only, so it travels with the
tasks. A recursion over the horizon then is one map over series: a task advances all series of
a batch day by day, with no plan, job or shuffle per day.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.session import materialize, scratch_path

STRIP = 2048  # rows scored together
CUT_ROUNDS = 4  # boosting rounds between two written states


@dataclass
class FlatTrees:
    """Trees side by side: a row reaches leaf ``value``; leaves point to themselves."""

    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    depth: int
    start: float = 0.0
    link: str = "identity"

    @classmethod
    def from_rows(cls, rows: Sequence, weights: Sequence[float], start: float = 0.0, link: str = "identity") -> FlatTrees:
        """From rows (tree, id, prediction, left, right, feature, threshold) as Spark ML stores them."""
        trees: dict[int, list] = {}
        for r in rows:
            trees.setdefault(r["tree"], []).append(r)
        size = max(len(t) for t in trees.values())
        shape = (len(trees), size)
        out = cls(np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape, np.int32),
                  np.zeros(shape), np.asarray(weights, dtype=float), 0, start, link)
        for t, nodes in sorted(trees.items()):
            for r in nodes:
                i, leaf = r["id"], r["left"] < 0
                out.value[t, i] = r["prediction"]
                out.left[t, i], out.right[t, i] = (i, i) if leaf else (r["left"], r["right"])
                if not leaf:
                    out.feature[t, i], out.threshold[t, i] = r["feature"], r["threshold"]
        reached, depth = np.zeros(len(trees), bool), 0
        front = [{0} for _ in trees]
        while not reached.all():
            nxt = [{c for i in f for c in (int(out.left[t, i]), int(out.right[t, i])) if c != i} for t, f in enumerate(front)]
            reached = np.array([not f for f in nxt])
            depth, front = depth + (not reached.all()), nxt
        out.depth = depth
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum over the trees, before the link."""
        out = np.empty(len(x))
        tree = np.arange(len(self.feature))
        for s in range(0, len(x), STRIP):
            part = x[s : s + STRIP]
            at = np.zeros((len(part), len(tree)), np.int32)
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                down = part[row, self.feature[tree, at]] <= self.threshold[tree, at]
                at = np.where(down, self.left[tree, at], self.right[tree, at])
            out[s : s + STRIP] = self.start + self.value[tree, at] @ self.weights
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = self.scores(x)
        return np.exp(np.clip(score, -300, 300)) if self.link == "log" else score


def _node_rows(stored: DataFrame, tree: str = "treeID", node: str = "nodeData") -> list:
    """Node rows of a stored model; their number is bounded by rounds and depth."""
    n = F.col(node)
    return stored.select(
        F.col(tree).alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    ).collect()


def flat_trees(spark: SparkSession, model: PipelineModel) -> FlatTrees:
    """The ensemble of a fitted tree pipeline (see ``fit_trees``), by way of its stored form."""
    gbt = model.stages[-1]
    path = scratch_path(spark, "ensemble")
    gbt.save(path)
    return FlatTrees.from_rows(_node_rows(spark.read.parquet(f"{path}/data")), gbt.treeWeights)


def fit_log_trees(df: DataFrame, names: Sequence[str], label: str, settings, power: float = 1.1, start: float | None = None) -> FlatTrees:
    """Boosted trees for the Tweedie deviance (1 <= power < 2) with a log link.

    Each round fits a tree to the working response -g/h with weight h, the gradient and curvature
    of the deviance in the log score. The weighted mean of a leaf then is its Newton step, and its
    variance reduction is the gain of the deviance's expansion. A round is one fit by Spark on
    the current scores; scores are written every ``CUT_ROUNDS`` rounds, so plans stay short and a
    lost executor costs little. Negative labels count as zero.
    """
    s = settings
    rows = VectorAssembler(inputCols=list(names), outputCol="features").transform(
        df.filter(F.col(label).isNotNull()).select(*names, F.greatest(F.col(label).cast("double"), F.lit(0.0)).alias("y"))
    ).select("features", "y")
    if start is None:
        mean = rows.agg(F.avg("y").alias("m")).head()["m"]
        start = math.log(max(mean or 0.0, 1e-12))
    state = materialize(rows.withColumn("score", F.lit(float(start))), "boost")
    falling, rising = F.exp((1 - power) * F.col("score")) * F.col("y"), F.exp((2 - power) * F.col("score"))
    g, h = rising - falling, (2 - power) * rising + (power - 1) * falling
    forest = RandomForestRegressor(
        featuresCol="features", labelCol="z", weightCol="h", predictionCol="_step", numTrees=1, bootstrap=False,
        maxDepth=s.max_depth, minInstancesPerNode=s.min_child_samples, subsamplingRate=s.subsample,
        featureSubsetStrategy="all" if s.colsample >= 1 else str(s.colsample), maxBins=s.max_bins,
    )
    found = []
    for i in range(s.n_estimators):
        working = state.select("features", (-g / h).alias("z"), h.alias("h"))
        tree = forest.copy({forest.seed: s.seed + i}).fit(working)
        found.append(tree)
        if i + 1 == s.n_estimators:
            break
        stepped = F.greatest(F.least(F.col("score") + s.learning_rate * F.col("_step"), F.lit(300.0)), F.lit(-300.0))
        state = tree.transform(state).select("features", "y", stepped.alias("score"))
        if (i + 1) % CUT_ROUNDS == 0:
            state = materialize(state, "boost")
    rows_of = []
    for t, model in enumerate(found):
        rows_of += _tree_nodes(t, model)
    return FlatTrees.from_rows(rows_of, [s.learning_rate] * len(found), start, "log")


def _tree_nodes(number: int, model) -> list[dict]:
    """Nodes of the only tree of a forest, walked on the driver, in the order of their ids."""
    out: list[dict] = []

    def walk(node) -> int:
        at = len(out)
        row = {"tree": number, "id": at, "prediction": node.prediction(), "left": -1, "right": -1, "feature": 0, "threshold": 0.0}
        out.append(row)
        if node.getClass().getSimpleName() == "InternalNode":
            row["feature"], row["threshold"] = node.split().featureIndex(), node.split().threshold()
            row["left"] = walk(node.leftChild())
            row["right"] = walk(node.rightChild())
        return at

    walk(model.trees[0]._call_java("rootNode"))
    return out


def predict_flat(df: DataFrame, trees: FlatTrees, names: Sequence[str], out: str) -> DataFrame:
    """``df`` with the ensemble's prediction of the numeric columns ``names``; a map over Arrow batches."""
    inputs = F.array(*[F.col(n).cast("double") for n in names]).alias("_inputs")
    rows = df.select(*[c for c in df.columns if c != out], inputs)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _filled(batch.column(batch.num_columns - 1), len(names))
            cols = [*batch.columns[:-1], pa.array(trees.predict(x))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


Term = Callable[[np.ndarray], np.ndarray]

# fixed values: statistic name -> function over the last values of each row, missing ones left out
ROW_STATS: dict[str, Callable] = {
    "mean": lambda a: np.nanmean(a, axis=1), "std": lambda a: _sample_std(a), "min": lambda a: np.nanmin(a, axis=1),
    "max": lambda a: np.nanmax(a, axis=1), "median": lambda a: np.nanmedian(a, axis=1),
}


def _sample_std(a: np.ndarray) -> np.ndarray:
    return np.where((~np.isnan(a)).sum(axis=1) > 1, np.nanstd(a, axis=1, ddof=1), np.nan)


def lag_term(k: int) -> Term:
    return lambda a: a[:, -k] if a.shape[1] >= k else np.full(len(a), np.nan)


def window_term(size: int, stat: str, lag: int = 1, full: bool = False) -> Term:
    """A statistic of ``size`` values that end ``lag`` places back; ``full``: only if all are known."""

    def term(a: np.ndarray) -> np.ndarray:
        end = a.shape[1] - (lag - 1)
        part = a[:, max(end - size, 0) : max(end, 0)]
        if not part.shape[1]:
            return np.full(len(a), np.nan)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # rows without any value
            got = ROW_STATS[stat](part)
        return np.where((~np.isnan(part)).sum(axis=1) == size, got, np.nan) if full else got

    return term


def roll_forward(
    paths: DataFrame, keys: Sequence[str], trees: FlatTrees, order: Sequence[str], series: Sequence[str],
    known: Sequence[str], terms: Mapping[str, Term], reach: int,
) -> DataFrame:
    """Predictions of every day of each series, each fed back as the newest value.

    ``paths`` has the keys, ``_tail`` (last values, oldest first), ``_series`` (values of the features
    ``series``) and ``_days`` (structs of day ``d`` and ``x``, the values of the features ``known``, in
    date order). ``order`` lists all features as the trees know them. Missing inputs are 0.
    Returns the keys, ``d`` and ``p``.
    """
    kept = [f for f in paths.schema if f.name in keys]
    day = paths.schema["_days"].dataType.elementType["d"].dataType
    schema = T.StructType([*kept, T.StructField("d", T.ArrayType(day)), T.StructField("p", T.ArrayType(T.DoubleType()))])
    place = {n: i for i, n in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, STRIP):
                yield advance(batch.slice(s, STRIP))

    def advance(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, at = batch.num_rows, len(kept)
        tails, own, days = batch.column(at), batch.column(at + 1), batch.column(at + 2)
        sizes = days.value_lengths().to_numpy()
        flat = days.flatten()
        given = _filled(flat.field("x"), len(known))
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        steps = int(sizes.max(initial=0))
        values = np.full((n, reach + steps), np.nan)
        tail_sizes = np.minimum(tails.value_lengths().to_numpy(), reach)
        for i, v in enumerate(tails.to_pylist()):
            if tail_sizes[i]:
                values[i, reach - tail_sizes[i] : reach] = np.array(v[-tail_sizes[i] :], dtype=float)
        fixed = _filled(own, len(series))
        out = np.zeros(len(flat))
        for step in range(steps):
            live = np.flatnonzero(sizes > step)
            x = np.zeros((len(live), len(order)))
            for j, name in enumerate(series):
                x[:, place[name]] = fixed[live, j]
            here = starts[live] + step
            for j, name in enumerate(known):
                x[:, place[name]] = given[here, j]
            past = values[live, : reach + step]
            for name, term in terms.items():
                x[:, place[name]] = np.nan_to_num(term(past), nan=0.0)
            got = trees.predict(x)
            out[here] = got
            values[live, reach + step] = got
        ends = pa.array(starts.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:at], pa.ListArray.from_arrays(ends, flat.field("d")), pa.ListArray.from_arrays(ends, pa.array(out))],
            names=schema.names,
        )

    rolled = paths.select(*[f.name for f in kept], "_tail", "_series", "_days").mapInArrow(run, schema)
    cells = F.explode(F.arrays_zip(F.col("d"), F.col("p"))).alias("_at")
    return rolled.select(*[f.name for f in kept], cells).select(*[f.name for f in kept], "_at.d", "_at.p")


def _filled(column: pa.Array, width: int) -> np.ndarray:
    """Equal lists as a matrix, missing values as 0."""
    if not width:
        return np.zeros((len(column), 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.nan_to_num(flat.reshape(-1, width), nan=0.0)
