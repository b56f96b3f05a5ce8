"""Whitening of embeddings through distributed block matrices.

Vectors become whole numbers, x = floor(64 c) + 1000000, so sums are exact. The fit list holds
each distinct x once. Its rows, centred on the mean, are the blocks of a Spark ``BlockMatrix``;
its transpose times itself is the scatter, whose eigenvectors are found on the driver (dimension
by dimension, never row by row). A second ``BlockMatrix`` of all rows is multiplied by the
whitening matrix.

Two things keep the products spread out. The inner dimension of the scatter is split, so its one
result block is summed from many tasks. For the projection the row blocks are laid out on a
square grid and the whitening matrix stands on the diagonal: a matrix of one block column would be
dealt to the square root of the partitions only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.session import materialize

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2.0**52  # larger products are held here
BLOCK_ROWS = 4096
BLOCKS_A_TASK = 16  # blocks that meet in one task of a product


def finite_vectors(df: DataFrame, vector: str = "embedding", factor: float = 1.0, limit: float = LIMIT) -> DataFrame:
    """The rows with a usable vector, and ``x``: floor(factor * entry) of each entry as whole numbers.

    A vector is usable if it is not null, has entries, none of them null or not finite, and has
    the commonest length among those (of ties the greatest). Products beyond +-``limit``
    are held there. A column x of ``df`` is replaced.
    """
    entry = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    good = F.coalesce(F.forall(F.col(vector), entry), F.lit(False)) & (F.size(vector) > 0)
    kept = df.where(good)
    sizes = kept.groupBy(F.size(vector).alias("d")).count()
    dims = sizes.agg(F.max_by("d", F.struct("count", "d")).alias("d")).head()["d"]
    wide = F.transform(
        F.col(vector),
        lambda e: F.floor(F.greatest(F.least(e.cast("double") * factor, F.lit(limit)), F.lit(-limit))),
    )
    return kept.where(F.size(vector) == F.lit(dims or 0)).withColumn("x", wide)


def matrix_column(blocks: list[np.ndarray]) -> pa.StructArray:
    """Matrices as values of Spark's matrix type, column by column."""
    whole = lambda values: pa.array(values, pa.int32())
    none = pa.nulls(len(blocks), pa.list_(pa.int32()))
    flat = pa.array([b.ravel(order="F") for b in blocks], pa.list_(pa.float64()))
    return pa.StructArray.from_arrays(
        [
            pa.array([1] * len(blocks), pa.int8()), whole([b.shape[0] for b in blocks]),
            whole([b.shape[1] for b in blocks]), none, none, flat, pa.array([False] * len(blocks)),
        ],
        names=[f.name for f in MatrixUDT.sqlType().fields],
    )


def matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """The reverse of ``matrix_column``; a product may come back row by row."""
    for m in column.to_pylist() if not len(column) else column:
        rows, cols = m["numRows"].as_py(), m["numCols"].as_py()
        values = m["values"].values.to_numpy(zero_copy_only=False)
        turned = m["isTransposed"].as_py()
        yield values.reshape(rows, cols) if turned else values.reshape(cols, rows).T


@dataclass
class Whitening:
    """What the fit list gives: ``weights`` projects a centred row on its whitened components."""

    n: int
    sums: list[int]
    weights: np.ndarray  # dimensions x components
    explained: list[float]
    identity_error: float

    @property
    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder over n of each mean, so that centring rounds once."""
        parts = [divmod(s, self.n) for s in self.sums] if self.n else []
        return np.array([q for q, _ in parts], np.int64), np.array([r / self.n for _, r in parts])


def _x_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Row count and the exact sum of each dimension; a partial sum per task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:  # 2^52 times a batch of rows fits 128 bits only: two halves
                x = _x_matrix(batch.column(0))
                high, low = (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)
                d = x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low),
                     pa.array(np.full(d, len(x)))],
                    names=["at", "high", "low", "n"],
                )

    sums = fit.select("x").mapInArrow(run, "at int, high long, low long, n long").groupBy("at").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    )
    got = sorted(sums.collect())  # a row per dimension
    return (int(got[0]["n"]) if got else 0), [(int(r["high"]) << 26) + int(r["low"]) for r in got]


def _blocks(rows: DataFrame, q: np.ndarray, r: np.ndarray, kept: str | None = None, n: int = 0, label: str = "blocks") -> DataFrame:
    """Rows cut into centred blocks inside their tasks and written: ``block``, ``m``, and, if asked
    for, the values of the column ``kept`` and each row's ``deviation``.

    A block has up to ``BLOCK_ROWS`` rows; the last of a task has fewer. Numbers are unique and
    nearly without gaps.
    """
    fields = [T.StructField("pid", T.LongType()), T.StructField("k", T.LongType()), T.StructField("m", MatrixUDT())]
    if kept:
        fields += [
            T.StructField("kept", T.ArrayType(rows.schema[kept].dataType)),
            T.StructField("deviation", T.ArrayType(T.LongType())),
        ]
    schema = T.StructType(fields)

    def cut(x: np.ndarray, values: pa.Array | None, pid: int, k: int) -> pa.RecordBatch:
        cols = [pa.array([pid]), pa.array([k]), matrix_column([(x - q) - r])]
        if values is not None:
            ends = pa.array([0, len(values)], pa.int32())
            cols += [pa.ListArray.from_arrays(ends, values), pa.array([_deviations(x, q, r, n)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(BLOCK_ROWS - size, batch.num_rows - at))
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == BLOCK_ROWS:
                    yield joined(held, pid, k)
                    held, size, k = [], 0, k + 1
        if held:
            yield joined(held, pid, k)

    def joined(held: list[pa.RecordBatch], pid: int, k: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        values = t.column(1).combine_chunks() if kept else None
        if isinstance(values, pa.ChunkedArray):
            values = pa.concat_arrays(values.chunks)
        return cut(np.concatenate([_x_matrix(b.column(0)) for b in held]), values, pid, k)

    made = materialize(rows.select("x", *[kept] * bool(kept)).mapInArrow(run, schema), label)
    tasks = made.agg(F.max("pid").alias("p")).head()["p"]
    return made.withColumn("block", F.col("k") * F.lit((tasks or 0) + 1) + F.col("pid")).drop("pid", "k")


def _deviations(x: np.ndarray, q: np.ndarray, r: np.ndarray, n: int) -> list[int | None]:
    """Sums of (n x - S)^2, exact; null where they exceed 64 bits."""
    rest = np.rint(r * n).astype(np.int64)
    away = x - q
    bound = (float(np.abs(away).max(initial=0)) + 1) * n
    if bound < 2**31 and bound * bound * x.shape[1] < 2**62:
        return ((n * away - rest) ** 2).sum(axis=1).tolist()
    whole = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest)) for row in away]
    return [v if v < 2**63 else None for v in whole]


def _block_matrix(cells: DataFrame, rows: int, cols: int, n_rows: int, n_cols: int) -> BlockMatrix:
    """A block matrix of cells (row, column, m), made without leaving the JVM."""
    at = F.struct(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"))
    java = callMLlibFunc("createBlockMatrix", cells.select(at, "m"), rows, cols, n_rows, n_cols)
    return BlockMatrix(java, rows, cols)


def _scatter(blocks: DataFrame, dims: int) -> np.ndarray:
    """Transpose times itself; the inner dimension is split so that few blocks meet in a task."""
    count = blocks.agg(F.max("block").alias("b")).head()["b"] + 1
    a = _block_matrix(blocks.select(F.col("block").alias("row"), F.lit(0).alias("col"), "m"),
                      BLOCK_ROWS, dims, count * BLOCK_ROWS, dims)
    splits = max(1, math.ceil(count / BLOCKS_A_TASK))
    # the Python method has no argument for the splits
    java = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, dims, dims).toLocalMatrix().toArray()


def fit(rows: DataFrame, components: int = 16) -> Whitening:
    """Whitening of the distinct vectors ``x`` of ``rows`` (see ``finite_vectors``).

    Fewer components are returned where the covariance has fewer eigenvalues above rounding, none
    for less than two distinct vectors. Repeated vectors are combined before they are shuffled.
    """
    distinct = materialize(rows.select("x").distinct(), "fit")
    n, sums = _totals(distinct)
    dims = len(sums)
    made = Whitening(n, sums, np.zeros((dims, 0)), [], 0.0)
    if n < 2:
        return made
    q, r = made.means
    blocks = _blocks(distinct, q, r, label="fit-blocks")
    covariance = _scatter(blocks, dims) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    sound = int((values > dims * np.finfo(float).eps * max(values[0], 0.0)).sum())
    most = min(components, sound)
    made.weights = vectors[:, :most] / np.sqrt(values[:most])
    made.explained = (values[:most] / np.trace(covariance)).tolist()
    if most:
        made.identity_error = float(np.abs(_covariance(blocks, made.weights, n) - np.eye(most)).max())
    return made


def _covariance(blocks: DataFrame, weights: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the whitened fit list, from its rows: one small matrix per task is shuffled."""
    size = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for a in matrices(batch.column(0)):
                y = a @ weights
                total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["at", "v"]
        )

    sums = blocks.select("m").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sorted(sums.collect())]).reshape(size, size) / n


def project(rows: DataFrame, made: Whitening, vec_id: str = "vec_id") -> DataFrame:
    """Each row's ``whitened`` array and ``deviation``: (vec_id, deviation, whitened)."""
    ids = rows.schema[vec_id].dataType
    schema = T.StructType([T.StructField("vec_id", ids), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    size, dims = made.weights.shape[1], len(made.sums)
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    q, r = made.means
    blocks = _blocks(rows, q, r, vec_id, made.n, "row-blocks")
    count = blocks.agg(F.max("block").alias("b")).head()["b"] + 1
    side = math.isqrt(count - 1) + 1  # of the square grid
    a = _block_matrix(
        blocks.select(F.floor(F.col("block") / side).alias("row"), (F.col("block") % side).alias("col"), "m"),
        BLOCK_ROWS, dims, side * BLOCK_ROWS, side * dims,
    )
    weights = made.weights

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(0), matrix_column([weights] * batch.num_rows)], names=["row", "col", "m"]
            )

    cell = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()),
                         T.StructField("m", MatrixUDT())])
    tasks = max(1, math.ceil(count / BLOCKS_A_TASK))  # the grid's partitions
    spots = rows.sparkSession.range(0, side, 1, tasks).mapInArrow(diagonal, cell)
    w = _block_matrix(spots, dims, size, side * dims, side * size)
    product = a.multiply(w)
    found = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    placed = found.select((F.col("_1._1").cast("long") * side + F.col("_1._2")).alias("block"), F.col("_2").alias("y"))
    joined = placed.join(blocks.select("block", "kept", "deviation"), "block").select("kept", "deviation", "y")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, y in enumerate(matrices(batch.column(2))):
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values,
                     pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(y).ravel()))],
                    names=schema.names,
                )

    return joined.mapInArrow(rows_of, schema)


def whiten(df: DataFrame, components: int = 16, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened,
    explained and identity_error.

    Rows without a usable vector have no rows (see ``finite_vectors``), nor has a table with
    fewer than two distinct vectors, or components without variance. Null and repeated ids stay
    as they are. ``deviation`` is null where it exceeds 64 bits. Other columns are not returned.
    """
    bare = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    rows = finite_vectors(bare, "v", SCALE).withColumn("x", F.transform("x", lambda e: e + F.lit(SHIFT))).drop("v")
    made = fit(rows, components)
    places = F.posexplode("whitened").alias("at", "whitened")

    def of_component(values: list[float]) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("at"))

    out = project(rows, made).select("vec_id", "deviation", places)
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation",
        "whitened", (of_component(made.explained) if made.explained else F.lit(None).cast("double")).alias("explained"),
        F.lit(made.identity_error).alias("identity_error"),
    )
