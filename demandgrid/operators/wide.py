"""Linear models with any number of category levels, fitted without a matrix.

Levels are numbered by a distributed distinct and joined to the rows; each row then is its numbers
and one number a category. Newton steps are solved by conjugate gradients: a product with the
Hessian is one map over the written rows, whose partial sums are added up by coefficient. Rows never
become dense vectors. Numbers and categories of up to ``NARROW`` levels have their coefficients in
arrays of the driver; those of wider categories stay in a written table with everything that the
gradients need for them, joined to the rows for a product, and only totals reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.session import materialize

SHARES = 64  # that levels are dealt to while they are numbered
NARROW = 1 << 15  # levels of a category whose coefficients the driver holds


def numbered_levels(df: DataFrame, col: str) -> DataFrame:
    """(level, id): distinct non-null values with ids from 0 without gaps; the least value has id 0.

    Values are dealt by digest and numbered inside their share, after the shares before it: no
    task or driver holds them all.
    """
    levels = df.select(F.col(col).alias("level")).where(F.col("level").isNotNull()).distinct()
    least = levels.agg(F.min("level").alias("m")).scalar()
    share = F.when(F.col("level") == least, F.lit(-1)).otherwise(F.pmod(F.xxhash64("level"), F.lit(SHARES)).cast("int"))
    dealt = materialize(levels.withColumn("share", share), "levels")
    sizes = {r["share"]: r["n"] for r in dealt.groupBy("share").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for s in sorted(sizes):
        starts += [F.lit(s), F.lit(total)]
        total += sizes[s]
    first = F.element_at(F.create_map(*starts), F.col("share")) if starts else F.lit(0)
    inside = Window.partitionBy("share").orderBy("level")
    return dealt.select("level", (first + F.row_number().over(inside) - 1).cast("long").alias("id"))


@dataclass
class WideLinear:
    """Weights of numbers by name and of levels as tables (level, weight); the least level of a
    category is the base, with weight 0."""

    intercept: float
    numbers: Mapping[str, float]
    levels: Mapping[str, DataFrame]
    link: str = "identity"

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Adds the prediction. Unknown and missing levels count as base, missing numbers as 0;
        a table of levels is joined, broadcast only where Spark measures it to be small."""
        score: Column = F.lit(float(self.intercept))
        for n, w in self.numbers.items():
            score = score + F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * F.lit(float(w))
        rows = df
        for i, (c, table) in enumerate(self.levels.items()):
            named = table.select(F.col("level").alias(f"_level{i}"), F.col("weight").alias(f"_weight{i}"))
            rows = rows.join(named, F.col(c) == F.col(f"_level{i}"), "left").drop(f"_level{i}")
            score = score + F.coalesce(F.col(f"_weight{i}"), F.lit(0.0))
        value = F.exp(score) if self.link == "log" else score
        kept = [c for c in df.columns if c != out]
        return rows.select(*kept, value.alias(out))


@dataclass
class _Problem:
    """Rows as (y, x, ids, far): label, numbers and the coefficient of each category's level (-1: base).

    ``ids`` are places in the driver's arrays; ``far`` has a level id for each category in ``wide``,
    whose coefficients are rows (cat, id, beta) of a table.
    """

    rows: DataFrame
    size: int  # coefficients in arrays, the intercept first
    numbers: int
    power: float | None  # None: least squares
    penalty: float
    wide: Sequence[int] = ()

    def _summed(
        self, beta: np.ndarray, table: DataFrame | None, direction: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
        """Sums by coefficient, those of ``table`` as rows (cat, id, a, b). With ``direction`` (and the
        column ``way``): the Hessian times it. Without: gradient, the loss behind it, and the Hessian's diagonal."""
        size, k, power, wide = self.size, self.numbers, self.power, list(self.wide)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second, loss = np.zeros(size), np.zeros(size), 0.0
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                y = b.column(0).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
                ids = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                far = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                eta = _linear(beta, x, ids) + b.column(4).to_numpy(zero_copy_only=False)
                value, slope, curve = _terms(y, eta, power)
                if direction is None:
                    loss += float(value.sum())
                    _scatter(first, slope, x, ids)
                    _scatter(second, curve, x, ids, square=True)
                else:
                    slope = curve * (_linear(direction, x, ids) + b.column(5).to_numpy(zero_copy_only=False))
                    _scatter(first, slope, x, ids)
                for j, cat in enumerate(wide):
                    live = far[:, j] >= 0
                    at, place = np.unique(far[live, j], return_inverse=True)
                    yield _sums(cat, at, np.bincount(place, slope[live], len(at)), np.bincount(place, curve[live], len(at)))
            at = np.flatnonzero((first != 0) | (second != 0))
            yield _sums(-1, np.append(at, -1), np.append(first[at], loss), np.append(second[at], 0.0))

        rows, known, bend = self.rows, F.lit(0.0), F.lit(0.0)
        for j, cat in enumerate(wide):
            named = table.where(F.col("cat") == cat).select(
                F.col("id").alias(f"_id{j}"), F.col("beta").alias(f"_beta{j}"),
                (F.lit(0.0) if direction is None else F.col("way")).alias(f"_way{j}"),
            )
            rows = rows.join(named, F.col("far")[j] == F.col(f"_id{j}"), "left")
            known = known + F.coalesce(F.col(f"_beta{j}"), F.lit(0.0))
            bend = bend + F.coalesce(F.col(f"_way{j}"), F.lit(0.0))
        dressed = rows.select("y", "x", "ids", "far", known.alias("known"), bend.alias("bend"))
        sums = (
            dressed.mapInArrow(run, "cat int, id long, a double, b double")
            .groupBy("cat", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        )
        if wide:
            sums = materialize(sums, "sums")
        got = sums.where("cat < 0").toArrow()
        at = got.column("id").to_numpy()
        a, b = np.zeros(size + 1), np.zeros(size + 1)
        a[at], b[at] = got.column("a").to_numpy(), got.column("b").to_numpy()  # -1 is the last place
        return a, b[:-1], sums.where("cat >= 0") if wide else None

    def _ridge(self) -> np.ndarray:
        ridge = np.full(self.size, self.penalty)
        ridge[0] = 0.0
        return ridge

    def state(self, beta: np.ndarray, table: DataFrame | None) -> _State:
        """Loss, gradient and the Hessian's diagonal at the given coefficients."""
        a, b, sums = self._summed(beta, table)
        ridge = self._ridge()
        loss = float(a[-1] + 0.5 * (ridge * beta) @ beta)
        if sums is not None:
            penalty = F.lit(float(self.penalty))
            diagonal = F.coalesce("b", F.lit(0.0)) + penalty
            table = materialize(
                table.join(sums, ["cat", "id"], "left").select(
                    "cat", "id", "beta", (F.coalesce("a", F.lit(0.0)) + penalty * F.col("beta")).alias("gradient"),
                    F.when(diagonal > 0, 1.0 / diagonal).otherwise(1.0).alias("scale"),
                ),
                "state",
            )
            loss += 0.5 * self.penalty * _total(table, F.col("beta") * F.col("beta"))
        diagonal = b + ridge
        return _State(beta, loss, a[:-1] + ridge * beta, 1.0 / np.where(diagonal > 0, diagonal, 1.0), table)

    def bent(self, beta: np.ndarray, way: np.ndarray, table: DataFrame | None) -> tuple[np.ndarray, DataFrame | None]:
        """The Hessian times a direction; in the table it is the column ``bent``."""
        a, _, sums = self._summed(beta, table, way)
        if sums is not None:
            bent = F.coalesce("a", F.lit(0.0)) + F.lit(float(self.penalty)) * F.col("way")
            table = materialize(
                table.join(sums, ["cat", "id"], "left").select(*table.columns, bent.alias("bent")), "bent"
            )
        return a[:-1] + self._ridge() * way, table


@dataclass
class _State:
    """Coefficients, with what the next Newton step needs; ``table`` has (cat, id, beta, gradient, scale)."""

    beta: np.ndarray
    loss: float
    gradient: np.ndarray
    scale: np.ndarray
    table: DataFrame | None

    def norm(self) -> float:
        return math.sqrt(
            float((self.gradient * self.scale) @ self.gradient) + _total(self.table, _square("gradient"))
        )


def _sums(cat: int, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array(np.full(len(at), cat, np.int32)), pa.array(at.astype(np.int64)), pa.array(a), pa.array(b)]
    return pa.RecordBatch.from_arrays(cells, names=["cat", "id", "a", "b"])


def _square(name: str) -> Column:
    return F.col(name) * F.col(name) * F.col("scale")


def _total(table: DataFrame | None, value: Column) -> float:
    return 0.0 if table is None else float(table.agg(F.sum(value).alias("s")).head()["s"] or 0.0)


def _linear(beta: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = beta[0] + x @ beta[1 : 1 + x.shape[1]]
    for c in range(ids.shape[1]):
        out += np.where(ids[:, c] >= 0, beta[ids[:, c]], 0.0)
    return out


def _scatter(total: np.ndarray, value: np.ndarray, x: np.ndarray, ids: np.ndarray, square: bool = False) -> None:
    total[0] += value.sum()
    total[1 : 1 + x.shape[1]] += value @ (x * x if square else x)
    for c in range(ids.shape[1]):
        live = ids[:, c] >= 0
        total += np.bincount(ids[live, c], weights=value[live], minlength=len(total))


def _terms(y: np.ndarray, eta: np.ndarray, power: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half deviance, its slope and expected curvature in the linear predictor."""
    if power is None:
        return 0.5 * (y - eta) ** 2, eta - y, np.ones(len(y))
    mu = np.exp(np.clip(eta, -300, 300))
    if power == 1.0:
        return mu - y * eta, mu - y, mu
    rise, fall = mu ** (2 - power), mu ** (1 - power)
    return rise / (2 - power) - y * fall / (1 - power), rise - y * fall, rise


def _solve(problem: _Problem, at: _State, tol: float, most: int) -> tuple[np.ndarray, DataFrame | None]:
    """Newton direction by conjugate gradients, scaled by the diagonal; in the table it is the column ``step``."""
    step, rest, table = np.zeros_like(at.beta), -at.gradient, at.table
    z = at.scale * rest
    way = z.copy()
    if table is not None:
        down = -F.col("gradient")
        table = table.select(
            "cat", "id", "beta", "scale", F.lit(0.0).alias("step"), down.alias("rest"), (down * F.col("scale")).alias("way")
        )
    size = float(rest @ z) + _total(table, _square("rest"))
    target = tol * tol * size
    for _ in range(most):
        if size <= target or size == 0:
            break
        bent, table = problem.bent(at.beta, way, table)
        length = size / (float(way @ bent) + _total(table, F.col("way") * F.col("bent")))
        step += length * way
        rest = rest - length * bent
        z = at.scale * rest
        if table is not None:
            table = table.withColumns({
                "step": F.col("step") + F.lit(length) * F.col("way"), "rest": F.col("rest") - F.lit(length) * F.col("bent"),
            }).drop("bent")
        fresh = float(rest @ z) + _total(table, _square("rest"))
        way = z + fresh / size * way
        if table is not None:
            table = table.withColumn("way", F.col("rest") * F.col("scale") + F.lit(fresh / size) * F.col("way"))
        size = fresh
    return step, table


def fit_wide(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, alpha: float = 1.0,
    power: float | None = None, steps: int = 25, tol: float = 1e-10, most: int = 200,
) -> WideLinear:
    """Least squares (``power`` None) or log-link Tweedie (1 <= power < 2) with an L2 penalty.

    The objective is that of ``fit_ridge`` and ``fit_tweedie``: half squared errors plus half ``alpha``
    per squared weight, or the mean half deviance plus the same. The intercept is free. Missing
    labels are left out, missing numbers are 0, missing levels are the base. Numbers are scaled inside
    the solver only by its diagonal. Raises for a table without labels.
    """
    labelled = df.filter(F.col(label).isNotNull())
    tables, ids, far, wide, places, offset = {}, [], [], [], {}, 1 + len(numeric)
    rows = labelled.select(
        F.col(label).cast("double").alias("_y"),
        F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numeric]).cast("array<double>").alias("_x"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(categorical)],
    )
    for i, c in enumerate(categorical):
        tables[c] = materialize(numbered_levels(labelled, c), "levels")
        named = tables[c].select(F.col("level").alias(f"_l{i}"), F.col("id").alias(f"_id{i}"))
        rows = rows.join(named, F.col(f"_c{i}") == F.col(f"_l{i}"), "left")
        # the base level, id 0, has no coefficient
        count, known = max(tables[c].count() - 1, 0), F.col(f"_id{i}") > 0
        if count > NARROW:
            wide.append(i)
            far.append(F.when(known, F.col(f"_id{i}")).otherwise(F.lit(-1)).cast("long"))
        else:
            places[c] = offset
            ids.append(F.when(known, F.col(f"_id{i}") + F.lit(offset - 1)).otherwise(F.lit(-1)).cast("long"))
            offset += count
    cells, others = (F.array(*x) if x else F.array().cast("array<long>") for x in (ids, far))
    rows = materialize(
        rows.select(F.col("_y").alias("y"), F.col("_x").alias("x"), cells.alias("ids"), others.alias("far")), "wide"
    )
    st = rows.agg(F.count("y").alias("n"), F.avg("y").alias("m")).head()
    if not st["n"]:
        raise ValueError("no labelled rows to fit")
    problem = _Problem(rows, offset, len(numeric), power, alpha if power is None else alpha * st["n"], wide)
    beta = np.zeros(offset)
    beta[0] = st["m"] if power is None else np.log(max(st["m"], 1e-12))
    parts = [
        tables[categorical[i]].where("id > 0").select(F.lit(i).alias("cat"), "id", F.lit(0.0).alias("beta")) for i in wide
    ]
    now = problem.state(beta, reduce(DataFrame.union, parts) if parts else None)
    first = now.norm()
    for _ in range(steps):
        way, table = _solve(problem, now, 1e-8, most)
        size = 1.0
        while size > 1e-6:  # full steps diverge on series that are mostly zero
            moved = None if table is None else table.select(
                "cat", "id", (F.col("beta") + F.lit(size) * F.col("step")).alias("beta")
            )
            tried = problem.state(now.beta + size * way, moved)
            if tried.loss <= now.loss + 1e-12 * abs(now.loss):
                break
            size /= 2
        else:
            break
        now = tried
        if now.norm() <= tol * first:
            break
    levels = {}
    for i, c in enumerate(categorical):
        if c in places:
            levels[c] = _weight_table(tables[c], now.beta, places[c])
            continue
        found = now.table.where(F.col("cat") == i).select("id", "beta")
        weight = F.coalesce("beta", F.lit(0.0)).alias("weight")
        levels[c] = materialize(tables[c].join(found, "id", "left").select("level", weight), "weights")
    names = dict(zip(numeric, now.beta[1 : 1 + len(numeric)].tolist()))
    return WideLinear(float(now.beta[0]), names, levels, "identity" if power is None else "log")


def _weight_table(table: DataFrame, beta: np.ndarray, at: int) -> DataFrame:
    """(level, weight) of a category; the coefficients travel with the tasks."""
    own = table.sparkSession.sparkContext.broadcast(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(1).to_numpy(zero_copy_only=False)
            w = np.where(i > 0, own.value[np.minimum(np.maximum(at + i - 1, 0), len(own.value) - 1)], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w)], names=["level", "weight"])

    kind = table.schema["level"].dataType.simpleString()
    return materialize(table.select("level", "id").mapInArrow(run, f"level {kind}, weight double"), "weights")
