"""Vector codes: product quantisation whose rounds skip entries by norm-of-sum bounds.

Each vector is cut into parts and each part is coded by its nearest codebook entry. Between
rounds a vector keeps, for every part and every group of entries, a lower bound on its distance to
the group's entries other than its own, with the round at which the bound was measured. All
codebooks so far are kept, so a bound from round t is lowered by the true net displacement
|C_r[j] - C_t[j]| of the group's entries, not by the sum of their steps; where it still exceeds the
distance to the own entry the group is passed over, else its entries are scanned exactly.

Rows never meet: a round is a map over the written state and one sum per codebook entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.llm.common import free_name
from demandgrid.llm.whitening import finite_vectors
from demandgrid.session import materialize

SCALE, LIMIT = 1024, 2.0**22  # within the limit distances over 256 dimensions are exact in double precision
GROUP = 32  # entries that share a bound
STRIP = 2048  # rows scanned together

Books = list[list[np.ndarray]]  # by round, by part: entries x dimensions


def first_book(rows: DataFrame, entries: int, parts: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids; nulls come last, ties by the vector."""
    got = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.array([r["x"] for r in got], dtype=np.int64)
    return np.split(x, parts, axis=1)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries: all terms are whole numbers below 2^53."""
    a, b = x.astype(float), entries.astype(float)
    return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)


def _spans(entries: int) -> list[tuple[int, int]]:
    return [(s, min(s + GROUP, entries)) for s in range(0, entries, GROUP)]


def _drifts(history: Books) -> list[np.ndarray]:
    """For each part, the greatest net displacement of a group's entries: round since x group."""
    now = history[-1]
    out = []
    for p, book in enumerate(now):
        moved = [np.sqrt(((book - old[p]) ** 2).sum(axis=1).astype(float)) for old in history]
        out.append(np.array([[m[s:e].max() for s, e in _spans(len(book))] for m in moved]))
    return out


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries, their squared distances and the groups' bounds, all exact."""
    far = _squares(x, book)
    code = far.argmin(axis=1)
    at = np.arange(len(x))
    best = far[at, code].copy()
    far[at, code] = np.inf
    return code, best, _floors(np.stack([far[:, s:e].min(axis=1) for s, e in _spans(len(book))], axis=1))


def _floors(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not above the distances; a group without other entries has no limit."""
    return np.minimum(np.sqrt(squares), 2.0**30).astype(np.int32)


def _reassign(
    x: np.ndarray, code: np.ndarray, low: np.ndarray, stamp: np.ndarray, history: Books, p: int, drift: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, squared distances, bounds and stamps at the last book, and the number of scanned groups."""
    book, now = history[-1][p], len(history) - 1
    best = ((x - book[code]) ** 2).sum(axis=1).astype(float)
    old, own = code.copy(), best.copy()
    lower = low - drift[stamp, np.arange(low.shape[1])]
    low, stamp, code = low.copy(), stamp.copy(), code.copy()
    # one more than rounding could take; an entry at the same distance must be seen, too
    open_ = lower <= np.sqrt(own)[:, None] + 1e-6
    seen = 0
    for g, (s, e) in enumerate(_spans(len(book))):
        rows = np.flatnonzero(open_[:, g])
        if not len(rows):
            continue
        seen += len(rows)
        far = _squares(x[rows], book[s:e])
        near = far.argmin(axis=1)
        value = far[np.arange(len(rows)), near]
        better = (value < best[rows]) | ((value == best[rows]) & (near + s < code[rows]))
        code[rows[better]], best[rows[better]] = near[better] + s, value[better]
        # the bound leaves out the old entry; who ends as the new one is taken out below
        mine = (old[rows] >= s) & (old[rows] < e)
        far[np.flatnonzero(mine), old[rows[mine]] - s] = np.inf
        low[rows, g], stamp[rows, g] = _floors(far.min(axis=1)), now
    moved = np.flatnonzero(code != old)
    left = old[moved] // GROUP  # the old entry counts in its group from now on
    known = np.where(stamp[moved, left] == now, low[moved, left], np.floor(lower[moved, left]))
    low[moved, left] = np.minimum(known, np.floor(np.sqrt(own[moved]))).astype(np.int32)
    stamp[moved, left] = now
    joined = code[moved] // GROUP  # and the new entry's group is measured without it
    for g in np.unique(joined).tolist():
        rows, (s, e) = moved[joined == g], _spans(len(book))[g]
        far = _squares(x[rows], book[s:e])
        far[np.arange(len(rows)), code[rows] - s] = np.inf
        low[rows, g], stamp[rows, g] = _floors(far.min(axis=1)), now
        seen += len(rows)
    return code, best, low, stamp, seen


def _state_type(vec: T.DataType, label: T.DataType) -> T.StructType:
    return T.StructType.fromDDL("x array<int>, code array<int>, low array<int>, stamp binary").add("vec_id", vec).add("label", label)


def _x_parts(column: pa.Array, parts: int) -> list[np.ndarray]:
    return np.split(_x_matrix(column), parts, axis=1)


def _x_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _raw(column: pa.Array, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)


def _binary(grid: np.ndarray) -> pa.Array:
    width, raw = grid.shape[1], np.ascontiguousarray(grid).tobytes()
    step = width * grid.itemsize
    return pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, STRIP):
            yield batch.slice(s, STRIP)


def _lists(grid: np.ndarray) -> pa.Array:
    ends = np.arange(len(grid) + 1, dtype=np.int32) * grid.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(grid).ravel()))


def _assign(state: DataFrame, history: Books) -> DataFrame:
    """The state after one assignment to the last book, with the squared ``error`` of each row.

    The books are broadcast with the task: rounds x parts x entries, whatever the number of rows.
    """
    parts, first = len(history[0]), len(history) == 1
    drifts = None if first else _drifts(history)
    vec, label = state.schema["vec_id"].dataType, state.schema["label"].dataType
    schema = _state_type(vec, label).add("error", T.LongType())
    groups = len(_spans(len(history[0][0])))
    names = ["x", "vec_id", "label"] if first else ["x", "vec_id", "label", "code", "low", "stamp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _strips(batches):
            n = b.num_rows
            xs = _x_parts(b.column(0), parts)
            if first:
                found = [(*_scan(x, history[0][p]), np.zeros((n, groups), np.uint8)) for p, x in enumerate(xs)]
            else:
                code = _x_matrix(b.column(3))
                low = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, parts, groups)
                stamp = _raw(b.column(5), "u1", n).reshape(n, parts, groups)
                found = [
                    _reassign(x, code[:, p], low[:, p], stamp[:, p], history, p, drifts[p])[:4]
                    for p, x in enumerate(xs)
                ]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            error = sum(f[1] for f in found).astype(np.int64)
            lows = np.concatenate([f[2] for f in found], axis=1)
            stamps = np.concatenate([f[3] for f in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _lists(codes), _lists(lows), _binary(stamps), b.column(1), b.column(2), pa.array(error)],
                names=schema.names,
            )

    return state.select(*names).mapInArrow(run, schema)


def _next_book(state: DataFrame, book: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes floor(sum / count) of its parts; entries without any stay.

    A task adds up what its batches hold; one row per task and used entry is shuffled, one row per
    entry reaches the driver.
    """
    parts, entries, width = len(book), len(book[0]), book[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for b in _strips(batches):
            code = _x_matrix(b.column(1))
            for p, x in enumerate(_x_parts(b.column(0), parts)):
                order = np.argsort(code[:, p], kind="stable")
                used, starts = np.unique(code[order, p], return_index=True)
                sums[p, used] += np.add.reduceat(x[order], starts, axis=0)
                count[p, used] += np.diff(np.append(starts, len(order)))
        p, j = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(j), pa.array(count[p, j]), _lists(sums[p, j])], names=["part", "entry", "n", "sums"]
        )

    partial = state.select("x", "code").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")
    )
    new = [b.copy() for b in book]
    for r in total.collect():
        new[r["part"]][r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
    return new


def book_digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in book for v in b.ravel().tolist()).encode()).hexdigest()


def train_codes(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all usable vectors and the final codebooks.

    Rows: vec_id, label, code (an entry number for each part) and error, the squared
    distance to the coded vector. Vectors are floor(1024 * component), held at +-2^22. Rows without
    a usable vector have no row (see ``finite_vectors``); the length must divide by ``parts``. With
    fewer vectors than ``entries`` all of them are entries; an empty table has none. Null and
    repeated ids stay. Other columns are not returned.
    """
    bare = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = finite_vectors(bare, "v", SCALE, LIMIT).drop("v")
    rows = rows.withColumn("x", F.col("x").cast("array<int>"))
    width = rows.select(F.size("x").alias("d")).head()
    if width is None:
        empty = T.StructType.fromDDL("code array<int>, error long").add("vec_id", bare.schema["vec_id"].dataType)
        return df.sparkSession.createDataFrame([], empty.add("label", bare.schema["label"].dataType)), []
    if width["d"] % parts or not entries:
        raise ValueError(f"vectors of {width['d']} components, {parts} parts, {entries} entries")
    history = [first_book(rows, entries, parts)]
    state = rows
    for _ in range(rounds):
        state = materialize(_assign(state, history).drop("error"), "codes")
        history.append(_next_book(state, history[-1]))
    coded = _assign(state, history).select("vec_id", "label", "code", "error")
    return materialize(coded, "codes"), history[-1]


def label_errors(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """The rows with ``label_error``, the errors of equal labels added up, nulls together.

    Sums are formed before the shuffle; a hot label is a skewed join against one row, which Spark
    splits.
    """
    key, total = free_name(coded, "_label"), "label_error"
    sums = coded.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias(total))
    return coded.drop(total).join(sums, F.col(label).eqNullSafe(F.col(key))).drop(key)
