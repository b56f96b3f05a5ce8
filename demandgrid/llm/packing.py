"""Packing token pieces into sequences of one length by a configuration linear program.

A configuration says how many pieces of each length share a sequence. The program asks for the
fewest configurations that cover the length histogram. Its size depends on the sequence length
alone, never on the number of documents. Multiplicative weights solve it: each length has a price
that falls by a constant factor with every share of it that is covered; each step uses the
configuration that is dearest at these prices, and the uses are averaged. A knapsack dynamic
program finds dear configurations and proves the bound; between two of its runs the dearest of those
found so far is taken. The averaged uses are rounded to whole sequences, and what rounding leaves
over is put best-fit.

Spark does the rest: counting lengths, numbering the pieces of each length across the cluster
and looking up where the plan puts the piece of that number. Token ids take no part in that; they
are joined to the places at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.bpe import SLICE_BYTES, Encoder, shared_vocabulary
from demandgrid.llm.common import released, slices, widened
from demandgrid.session import scratch_path

GAP = 0.0005  # of the sequences over the best dual bound
#: rounds of steps and their rate: how much a price falls, as an exponent, when its length is covered once
ROUNDS = ((2000, 0.5), (8000, 0.5), (10000, 0.2), (10000, 0.1))
EVERY = 50  # steps between two runs of the knapsack program
LAGGING = 32  # least covered lengths for which it gives a configuration


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids, little-endian 32-bit numbers.

    A document is its ids and ``end_id``; null or empty texts are the end id alone. Documents
    over ``capacity`` are cut so that every piece but the first is full.
    """
    shared = shared_vocabulary(docs, tokenizer)
    named = docs.select(F.col(doc_id).alias("doc_id"))
    schema = widened(named, "piece int, start long, length long, ids binary")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                rows, number, start, length, ids = [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    raw = encoder.ids(t) + end
                    total, at, k = len(raw) // 4, 0, 0
                    while at < total:
                        stop = at + ((total - at) % capacity or capacity)
                        rows.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(stop - at)
                        ids.append(raw[4 * at : 4 * stop])
                        at, k = stop, k + 1
                cols = [
                    part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(released(run), schema)


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of each room, and the length taken there (-1: none)."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        value = best[c - lengths[: fits[c]]] + prices[: fits[c]]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], taken[c] = value[k], k
        else:
            best[c] = best[c - 1]
    return best, taken


def _content(lengths: np.ndarray, taken: np.ndarray, room: int, config: dict[int, int]) -> dict[int, int]:
    """``config`` and the dearest filling of ``room``."""
    while room >= lengths[0]:
        k = int(taken[room])
        if k < 0:
            room -= 1
        else:
            config[k] = config.get(k, 0) + 1
            room -= int(lengths[k])
    return config


Uses = list[tuple[float, dict[int, int]]]


class _Program:
    """The covering program of a histogram with the configurations found so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.lengths = np.array(sorted(counts), dtype=np.int64)
        self.need = np.array([counts[v] for v in self.lengths.tolist()], dtype=float)
        self.bound = 0.0
        self.keys: dict[tuple[tuple[int, int], ...], int] = {}
        self.held = np.zeros((0, 1), np.int64)  # lengths of each configuration, by place
        self.copies = np.zeros((0, 1))  # and how many of them; 0 fills up
        self.whole = np.zeros(0)  # uses that cover the scarcest length of a configuration once
        self.logs = np.zeros(len(self.lengths))

    def prices(self) -> np.ndarray:
        return self.lengths / self.capacity * np.exp(self.logs)

    def price_out(self) -> None:
        """Adds the dearest configuration and the dearest with each lagging length; raises the bound."""
        self.logs -= self.logs.max()
        prices = self.prices()
        best, taken = _knapsack(self.lengths, prices, self.capacity)
        self.bound = max(self.bound, float(prices @ self.need) / best[self.capacity])
        behind = np.argsort(-self.logs, kind="stable")[: LAGGING if self.keys else None]
        found = [_content(self.lengths, taken, self.capacity, {})]
        found += [_content(self.lengths, taken, self.capacity - int(self.lengths[i]), {i: 1}) for i in behind.tolist()]
        fresh = []
        for config in found:
            key = tuple(sorted(config.items()))
            if key not in self.keys:
                self.keys[key] = len(self.keys)
                fresh.append(key)
        if not fresh:
            return
        width = max(self.held.shape[1], *map(len, fresh))
        more = ((0, len(fresh)), (0, width - self.held.shape[1]))
        at = len(self.whole)
        self.held, self.copies = np.pad(self.held, more), np.pad(self.copies, more)
        for r, key in enumerate(fresh, at):
            self.held[r, : len(key)] = [k for k, _ in key]
            self.copies[r, : len(key)] = [n for _, n in key]
        scarce = [min(self.need[k] / n for k, n in key) for key in fresh]
        self.whole = np.append(self.whole, scarce)

    def run(self, steps: int, rate: float) -> tuple[float, Uses]:
        """Average uses of ``steps`` steps that cover every length, and their sum."""
        self.logs = np.maximum(self.logs - self.logs.max(), -1.0)  # early errors are forgotten
        uses, covered = np.zeros(len(self.whole)), np.zeros(len(self.need))
        best: tuple[float, np.ndarray] = (np.inf, uses)
        for step in range(steps + 1):
            if step % EVERY == 0:
                self.price_out()
                uses = np.append(uses, np.zeros(len(self.whole) - len(uses)))
                least = covered.min()
                if least > 0 and uses.sum() / least < best[0]:
                    best = (uses.sum() / least, uses / least)
                    if best[0] <= (1 + GAP) * self.bound:
                        break
            prices = self.prices()
            j = int((prices[self.held] * self.copies).sum(axis=1).argmax())
            at = self.held[j][self.copies[j] > 0]
            share = self.copies[j][self.copies[j] > 0] * self.whole[j] / self.need[at]
            uses[j] += self.whole[j]
            covered[at] += share
            self.logs[at] -= rate * share
        names = list(self.keys)
        used = [(float(best[1][j]), names[j]) for j in np.flatnonzero(best[1]).tolist()]
        return best[0], [(a, {int(self.lengths[k]): n for k, n in key}) for a, key in used]


def whole_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """Whole uses of configurations that hold every piece of the histogram exactly once, and the
    dual bound: no plan has fewer sequences."""
    program = _Program(counts, capacity)
    plan: list[tuple[int, dict[int, int]]] = []
    for steps, rate in ROUNDS:
        _, uses = program.run(steps, rate)
        for carried in (False, True):
            made = _rounded(counts, uses, capacity, carried)
            if not plan or sequences(made) < sequences(plan):
                plan = made
        if sequences(plan) <= (1 + GAP) * program.bound + 1:
            break
    return plan, program.bound


def sequences(plan: list[tuple[int, dict[int, int]]]) -> int:
    return sum(uses for uses, _ in plan)


def _rounded(counts: dict[int, int], uses: Uses, capacity: int, carried: bool) -> list[tuple[int, dict[int, int]]]:
    """Whole sequences, the fullest configurations first; ``carried``: parts of a use are added up."""
    left, carry = dict(counts), 0.0
    plan: list[tuple[int, dict[int, int]]] = []
    for amount, config in sorted(uses, key=lambda u: (-sum(v * n for v, n in u[1].items()), -u[0])):
        carry = amount + (min(carry, 1.0) if carried else 0.0)
        n = min(int(carry + 1e-6), *(left[v] // k for v, k in config.items()))
        if n:
            plan.append((n, config))
            carry -= n
            for v, k in config.items():
                left[v] -= k * n
    plan.extend(_best_fit({v: n for v, n in left.items() if n}, capacity))
    return plan


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over counts: equal sequences are filled together."""
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}  # free room: equal sequences
    for v in sorted(left, reverse=True):
        n = left[v]
        while n:
            room = min((r for r in groups if r >= v), default=None)
            if room is None:
                each = min(capacity // v, n)
                uses, config = n // each, {v: each}
                n -= uses * each
                groups.setdefault(capacity - each * v, []).append((uses, config))
                continue
            uses, config = groups[room].pop()
            if not groups[room]:
                del groups[room]
            take = min(uses, n)
            if uses > take:
                groups.setdefault(room, []).append((uses - take, config))
            n -= take
            fuller = config | {v: config.get(v, 0) + 1}
            groups.setdefault(room - v, []).append((take, fuller))
    return [g for same in groups.values() for g in same]


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, copies, offset) of the plan's uses.

    The piece with number r of a length is in the last row that starts at or before r.
    """
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for uses, config in plan:
        offset = 0
        for v in sorted(config, reverse=True):
            rows.setdefault(v, []).append((given.get(v, 0), sequence, config[v], offset))
            given[v] = given.get(v, 0) + uses * config[v]
            offset += v * config[v]
        sequence += uses
    return {v: np.array(r, dtype=np.int64) for v, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length", order: tuple[str, ...] = ()) -> DataFrame:
    """All rows of ``pieces`` with sequence_id and offset, gapless from 0 in each sequence.

    Lengths are 1 to ``capacity``; others raise. ``order`` breaks ties of the numbering; rows
    equal in it may change places, which never changes a sequence's lengths. An empty table
    stays empty. Columns named sequence_id, offset are replaced.

    ``pieces`` is read twice (histogram, placement) and must not change in between: pass a
    written table. Pieces of one length are numbered in parallel: they are dealt by a digest,
    each share is numbered on its own and starts after the shares before it.
    """
    pieces = pieces.drop("sequence_id", "offset", "_share", "_number", "_first")
    shares = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 16)
    keys = order or tuple(pieces.columns)
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("int"))
    tally = dealt.groupBy(F.col(length).alias("_length"), "_share").agg(F.count("*").alias("_n"))
    found = tally.groupBy("_length").agg(F.sum("_n").alias("n")).collect()  # at most one row a length
    counts = {int(r["_length"]): int(r["n"]) for r in found}
    if any(not 1 <= v <= capacity for v in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    table = slots(whole_plan(counts, capacity)[0]) if counts else {}

    before = Window.partitionBy("_length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tally.select(
        "_length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy(length, "_share").orderBy(*keys)
    numbered = (
        dealt.withColumn("_number", F.row_number().over(inside) - 1)
        .join(
            firsts.withColumnsRenamed({"_length": "_l", "_share": "_s"}),
            (F.col(length) == F.col("_l")) & (F.col("_share") == F.col("_s")),
        )
        .withColumn("_number", F.col("_number") + F.col("_first"))
        .drop("_share", "_first", "_l", "_s")
    )
    schema = widened(pieces, "sequence_id long, offset long")
    at = numbered.columns.index(length)
    number_at = numbered.columns.index("_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = batch.column(number_at).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for v in np.unique(lengths):
                mine = np.flatnonzero(lengths == v)
                rows = table[int(v)]
                row = rows[np.searchsorted(rows[:, 0], numbers[mine], side="right") - 1]
                inner = numbers[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + inner // row[:, 2]
                offset[mine] = row[:, 3] + inner % row[:, 2] * v
            kept = [c for i, c in enumerate(batch.columns) if i != number_at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=schema.names
            )

    return numbered.mapInArrow(released(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their ids and places; see ``token_pieces`` and ``pack``.

    The ids of a sequence are those of its pieces by offset. Rows are numbered and placed without
    their ids, which join by the number of the written piece.
    """
    made = token_pieces(docs, tokenizer, capacity, end_id).withColumn("_piece", F.monotonically_increasing_id())
    path = scratch_path(docs.sparkSession, "pieces")
    made.write.option("compression", "zstd").parquet(path)  # the ids are most of what the job writes
    pieces = docs.sparkSession.read.schema(made.schema).parquet(path)
    placed = pack(pieces.drop("ids"), capacity, order=("_piece",))
    return placed.join(pieces.select("_piece", "ids"), "_piece").drop("_piece")
