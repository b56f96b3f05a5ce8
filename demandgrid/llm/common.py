"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part hold ``most_bytes`` or are one single text."""
    if not batch.num_rows:
        return
    sizes = np.asarray(
        pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64
    )
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, base + most_bytes, side="right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker gives free memory back: Spark keeps workers for later tasks,
    and several that hold their largest batches add up in an executor."""

    def freeing(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim is not None:
                trim(0)

    return freeing


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys in sorted arrays, and the end of the last."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, from batches sorted by non-null integer keys.

    Yields a table and the bounds of its groups. Memory: one batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = all(batch.column(k)[0].as_py() == batch.column(k)[-1].as_py() for k in keys)
        same = bool(held) and all(
            held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys
        )
        if held and not same:
            yield _bounded(pa.Table.from_batches(held), keys)
            held = []
        if first:
            held.append(batch)
            continue
        cut = int(runs(*(batch.column(k).to_numpy() for k in keys))[-2])
        yield _bounded(pa.Table.from_batches([*held, batch.slice(0, cut)]), keys)
        held = [batch.slice(cut)]
    if held:
        yield _bounded(pa.Table.from_batches(held), keys)


def _bounded(t: pa.Table, keys: tuple[int, ...]) -> tuple[pa.Table, np.ndarray]:
    return t, runs(*(t.column(k).to_numpy() for k in keys))


def widened(df: DataFrame, columns: str) -> T.StructType:
    """The schema of ``df`` and more columns, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields])
