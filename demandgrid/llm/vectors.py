"""Near-duplicate vectors by sorted projection passes.

A pass concatenates random sign hashes to a key and sorts the vectors by it, so close vectors
tend to stand together; each is compared with a bounded window of neighbours. How many leading
hashes shrink the table to a window is read off the sorted keys for each vector, and with it the
chance that a partner at the threshold stood in the window. Vectors leave once their chance to
have missed it is small; the others, those of crowded places, go on in rounds of wider windows
and more passes, with hashes about the mean of what is left. Verified pairs are united over all
passes. Inside the components so found every link is then counted exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, erf, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import whole_groups
from demandgrid.llm.components import connected_components
from demandgrid.session import materialize

WINDOW = 256  # of the first round; each further round doubles it
FEWEST = 4  # passes of the second round; each further round has half as many again
MISSED = 0.01
BLOCK = 256
KEY_BITS = 62
CELL = 8  # windows in a cell, the part of a sorted pass that one group holds
SAMPLE = 4096  # rows that place the cells' bounds and the centre
ROWS = 64  # of a cell that are compared with their windows at once


def passes_needed(n: int, threshold: float, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold has stood in one window but for ``missed``.

    A pair shares as many leading hashes as shrink the table to a window with this chance.
    """
    same = 1 - acos(min(1.0, max(-1.0, threshold))) / pi
    chance = same ** max(log2(max(n, 2) / window), 1.0)
    return max(4, ceil(log(missed) / log(1 - chance)))


def _units(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _planes(turn: int, dim: int) -> np.ndarray:
    return np.random.default_rng((turn, dim)).standard_normal((dim, KEY_BITS))


def _keys(sides: np.ndarray) -> np.ndarray:
    return (sides > 0).astype(np.int64) @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))


_HALF = np.array([0.5 * (1 + erf(x / 100 / 2**0.5)) for x in range(801)])  # normal distribution from 0 to 8


def _normal(x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.abs(x) * 100, 800).astype(np.int64)
    return np.where(x < 0, 1 - _HALF[at], _HALF[at])


def _shared(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Leading hashes that two keys have in common."""
    low, high = np.minimum(keys, others), np.maximum(keys, others)
    differ = low ^ high
    halves = (differ >> 31).astype(float), (differ & ((1 << 31) - 1)).astype(float)
    length = np.where(halves[0] > 0, np.frexp(halves[0])[1] + 31, np.frexp(halves[1])[1])
    return KEY_BITS - length


def log_missed(
    rest: np.ndarray, sides: np.ndarray, keys: np.ndarray, threshold: float, window: int, ends: tuple[bool, bool],
) -> np.ndarray:
    """Log of each row's chance that a partner at the threshold stood outside its window.

    The rows are sorted by key; ``rest`` are the vectors about the centre, ``sides`` their
    products with the planes. The partner is met if it shares one hash more than the rows a
    window away. ``ends``: no row of the pass comes before the first or after the last; otherwise
    a window that is cut off there counts as that much shorter. The partner is taken to be as far
    from the centre as the row, which is the case for two rows of one crowd.
    """
    n = len(keys)
    at = np.arange(n)
    low, high = np.maximum(at - window, 0), np.minimum(at + window, n - 1)
    depth = np.maximum(
        np.where((at - window < 0) & ends[0], -1, _shared(keys, keys[low])),
        np.where((at + window > n - 1) & ends[1], -1, _shared(keys, keys[high])),
    ) + 1
    square = np.maximum((rest * rest).sum(axis=1, keepdims=True), 1e-12)
    cosine = np.clip(1 - (1 - threshold) / square, -0.999999, 0.999999)
    same = _normal(np.abs(sides) / np.sqrt(square) * cosine / np.sqrt(1 - cosine * cosine))
    ahead = np.concatenate([np.zeros((n, 1)), np.cumsum(np.log(np.maximum(same, 1e-12)), axis=1)], axis=1)
    chance = np.where(depth > KEY_BITS, 0.0, np.exp(ahead[at, np.minimum(depth, KEY_BITS)]))
    return np.log(np.maximum(1 - chance, 1e-9))


def _forest(units: np.ndarray, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that unite what the windows of one sorted cell verify."""
    label = np.arange(len(units))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(units) - 1, ROWS):
        i, j = np.nonzero(units[at : at + ROWS] @ units[at + 1 : at + ROWS + window].T >= threshold)
        i, j = i + at, j + at + 1
        open_ = (i < j) & (j - i <= window) & (label[i] != label[j])
        i, j = i[open_], j[open_]
        while len(i):  # one row's links at a time
            mine = i == i[0]
            roots, at_root = np.unique(label[j[mine]], return_index=True)
            a.append(np.full(len(roots), i[0]))
            b.append(j[mine][at_root])
            label[np.isin(label, roots)] = label[i[0]]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    return np.concatenate(a), np.concatenate(b)


def _cells(
    sample: dict[int, np.ndarray], centres: dict[int, np.ndarray], sizes: dict[int, int], turns: range, window: int
) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pass and dimension: bounds of the cells, and where their halos begin and end.

    Cells are ranges of keys with about ``CELL`` windows of rows; a halo has about a window more
    on both sides. All are read off a sample: where it errs, ``log_missed`` counts what is seen.
    """
    out = {}
    for dim, units in sample.items():
        n, m = sizes[dim], len(units)
        cells = max(min(ceil(n / (CELL * window)), m // 8), 1)
        halo = ceil(1.2 * window / n * m)
        for turn in turns:
            keys = np.sort(_keys((units - centres[dim]) @ _planes(turn, dim)))
            at = np.arange(1, cells) * m // cells
            out[turn, dim] = (
                keys[at], np.append(np.iinfo(np.int64).min, keys[np.maximum(at - halo, 0)]),
                np.append(keys[np.minimum(at + halo, m - 1)], np.iinfo(np.int64).max),
            )
    return out


def _round(
    vectors: DataFrame, threshold: float, sizes: dict[int, int], window: int, turns: range
) -> DataFrame:
    """Verified links (a, b) of the passes ``turns``, and for each of them and row (a, turn, missed)."""
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    drawn_dims = drawn.column("dim").to_numpy()
    sample = {
        int(d): _units(drawn.column("vector").combine_chunks().take(pa.array(np.flatnonzero(drawn_dims == d))))
        for d in np.unique(drawn_dims)
    }
    centres = {d: units.mean(axis=0) for d, units in sample.items()}
    cells = _cells(sample, centres, sizes, turns, window)
    whole = (np.zeros(0, np.int64), np.array([np.iinfo(np.int64).min]), np.array([np.iinfo(np.int64).max]))

    def sided(units: np.ndarray, turn: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rest = units - centres.get(dim, 0.0)
        return rest, rest @ _planes(turn, dim)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                units = _units(part.column(2))
                for turn in turns:
                    cuts, lows, highs = cells.get((turn, dim), whole)
                    keys = _keys(sided(units, turn, dim)[1])
                    own = np.searchsorted(cuts, keys, side="right")
                    first = np.minimum(np.searchsorted(highs, keys, side="left"), own)
                    last = np.maximum(np.searchsorted(lows, keys, side="right") - 1, own)
                    row = np.repeat(np.arange(len(keys)), last - first + 1)
                    cell = np.arange(len(row)) - np.searchsorted(row, row) + first[row]
                    sent = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), turn, np.int32)), sent.column(1),
                            pa.array(cell.astype(np.int32)), pa.array(keys[row]), pa.array(cell != own[row]),
                            sent.column(0), sent.column(2),
                        ],
                        names=["turn", "dim", "cell", "key", "guest", "id", "vector"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, (0, 1, 2)):
            group = group.combine_chunks()
            turn_of, dim_of, cell_of, key_of, guest, ids = (group.column(i).to_numpy() for i in range(6))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                turn, dim, cell = int(turn_of[s]), int(dim_of[s]), int(cell_of[s])
                units = _units(group.column(6).slice(s, e - s).combine_chunks())
                a, b = _forest(units, threshold, window)
                ends = cell == 0, cell == len(cells.get((turn, dim), whole)[0])
                missed = log_missed(*sided(units, turn, dim), key_of[s:e], threshold, window, ends)
                own = ~guest[s:e]
                links, rows = len(a), int(own.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[s:e][a], ids[s:e][own]])),
                        pa.array(np.concatenate([ids[s:e][b], np.zeros(rows, np.int64)]),
                                 mask=np.arange(links + rows) >= links),
                        pa.array(np.full(links + rows, turn, np.int32)),
                        pa.array(np.concatenate([np.zeros(links), missed[own]]),
                                 mask=np.arange(links + rows) < links),
                    ],
                    names=["a", "b", "turn", "missed"],
                )

    keyed = vectors.mapInArrow(
        spread, "turn int, dim int, cell int, key long, guest boolean, id long, vector array<double>"
    )
    dealt = keyed.repartition("turn", "dim", "cell").sortWithinPartitions("turn", "dim", "cell", "key", "id")
    return dealt.mapInArrow(compare, "a long, b long, turn int, missed double")


def window_links(vectors: DataFrame, threshold: float, window: int = WINDOW) -> DataFrame:
    """Verified links (a, b) of the sorted passes over rows (id, dim, vector), a written table.

    Rounds go on until each row's chance to have missed a partner at the threshold is at most
    ``MISSED``; rows left over are fewer each time and windows wider, at last as wide as they.
    """
    links, states, turn, passes = [], [], 0, 0
    rows = vectors
    while True:
        sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row a dimension
        most = max(sizes.values(), default=0)
        if most < 2:
            break
        if not passes:
            passes = passes_needed(most, threshold, window)
        turns = range(turn, turn + (passes if most > window else 1))
        done = materialize(_round(rows, threshold, sizes, window, turns), "passes")
        links.append(done.where("b IS NOT NULL").select("a", "b"))
        # rows of one id: the one that fares worst
        states.append(done.where("b IS NULL").groupBy("a", "turn").agg(F.max("missed").alias("missed")))
        missed = reduce(DataFrame.union, states).groupBy("a").agg(F.sum("missed").alias("missed"))
        open_ = missed.where(F.col("missed") > log(MISSED)).select(F.col("a").alias("id"))
        rows = materialize(rows.join(open_, "id", "left_semi").select("id", "dim", "vector"), "crowded")
        turn, window = turns.stop, 2 * window
        passes = ceil(1.5 * passes) if len(links) > 1 else FEWEST
    if not links:
        return vectors.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return reduce(DataFrame.union, links)


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): for each row its links inside its component, weighted by copies.

    ``members``: (id, component, dim, copies, vector). A component is cut into blocks and each
    pair of blocks is one group; only counts leave a task.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    roles = F.concat(  # as a target against every block, and as a source for every other block
        F.transform(every, lambda j: F.struct(mine.alias("t"), j.alias("s"), F.lit(True).alias("target"))),
        F.transform(
            F.filter(every, lambda j: j != mine),
            lambda j: F.struct(j.alias("t"), mine.alias("s"), F.lit(False).alias("target")),
        ),
    )
    dealt = members.join(sizes, "component").select(
        "component", F.inline(roles), "id", "dim", "copies", "vector"
    )
    keys = ("component", "t", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, (0, 1, 2)):
            group = group.combine_chunks()
            own = group.column(1).to_numpy() == group.column(2).to_numpy()
            target = group.column(3).to_numpy()
            ids, copies = group.column(4).to_numpy(), group.column(6).to_numpy()
            found_ids, found = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                units = _units(group.column(7).slice(s, e - s).combine_chunks())
                t = target[s:e]
                sources = ~t if not own[s] else np.ones(e - s, bool)
                near = (units[t] @ units[sources].T >= threshold).astype(np.int64)
                count = near @ copies[s:e][sources]
                if own[s]:  # a row is no link of itself, its copies are; rounding cannot drop them
                    at = np.arange(len(near))
                    count += copies[s:e] * (1 - near[at, at]) - 1
                found_ids.append(ids[s:e][t])
                found.append(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found_ids)), pa.array(np.concatenate(found))], names=["id", "links"]
            )

    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    rows: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest linked id), kept.

    Vectors that are null, empty, zero or hold null or non-finite parts, vectors of a null id,
    and vectors of different lengths link with nothing. Equal vectors are compared once and
    counted as often as they occur; repeated ids count as rows. Other columns are not read.
    """
    every = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    usable = every.where(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    )
    zeroed = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one value
    keyed = materialize(usable.select("vec_id", zeroed.alias("v")).withColumn("h", F.xxhash64("v")), "vectors")
    distinct = materialize(
        keyed.groupBy("h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "distinct"
    )
    links = window_links(
        distinct.select("id", F.size("v").cast("int").alias("dim"), F.col("v").alias("vector")), threshold
    )
    linked = materialize(
        connected_components(links).withColumnsRenamed({"node": "id"}), "linked"
    )
    members = linked.join(distinct, "id").select(
        "id", "component", F.size("v").cast("int").alias("dim"), "copies", F.col("v").alias("vector")
    )
    counted = exact_links(members, threshold)
    known = (
        distinct.join(linked, "id", "left").join(counted, "id", "left")
        .select(
            "h", "v", F.coalesce("component", "id").alias("component_id"),
            F.coalesce("links", F.col("copies") - 1).alias("n_links"),
        )
    )
    good = keyed.join(known, ["h", "v"]).select("vec_id", "n_links", "component_id")
    bad = every.where(
        F.col("vec_id").isNull() | ~F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    ).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
