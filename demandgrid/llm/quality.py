"""Quality scores of whole texts by a factorisation machine.

Inputs are hashed words, statistics of the text's structure and its metadata. Every pair of
inputs interacts through low-rank factors; the sum over all pairs is half the difference of the
squared sum and the sum of squares, so a score costs one pass over the inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import free_name, slices, widened

WORD_SLOTS = 1 << 14
FACTORS = 6
SAMPLE = 5000  # labelled rows the model is fitted on, at most
EPOCHS = 6
SLICE_BYTES = 4 << 20

STATISTICS = (
    "bias", "log words", "log bytes", "bytes a word", "distinct words", "capitals", "digits", "marks",
    "above ASCII", "white space", "lines", "marks at word ends", "words all capital", "most frequent word",
    "metadata length", "metadata missing",
)
_KIND = np.zeros(256, np.int64)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_KIND[128:] = 4
_KIND[[0x20, *range(0x09, 0x0E)]] = 5


def inputs(data: bytes | None, length: int | None) -> tuple[list[int], np.ndarray]:
    """Slots and values of a text: hashed words with norm 1, then the statistics."""
    data = data or b""
    words = data.split()
    counts = Counter(words)
    n = max(len(words), 1)
    slots = [crc32(w) % WORD_SLOTS for w in counts]
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    weights /= max(float(np.sqrt((weights**2).sum())), 1.0)
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6) / max(len(raw), 1)
    ends = sum(c for w, c in counts.items() if w[-1] in b"!#$%&*+|~^<>=@") / n
    capital = sum(c for w, c in counts.items() if w.isupper()) / n
    stats = np.array([
        1.0, np.log1p(len(words)) / 8, np.log1p(len(data)) / 10, min(len(data) / n / 10, 3.0), len(counts) / n,
        4 * kinds[1], 4 * kinds[2], 4 * kinds[3], kinds[4], kinds[5], 10 * data.count(b"\n") / n, 2 * ends,
        2 * capital, max(counts.values(), default=0) / n,
        0.0 if length is None else np.log1p(max(length, 0)) / 10, float(length is None),
    ])
    return [*slots, *range(WORD_SLOTS, WORD_SLOTS + len(stats))], np.concatenate([weights, stats])


class Machine:
    """Weights and factors of all slots."""

    def __init__(self, seed: int = 7):
        size = WORD_SLOTS + len(STATISTICS)
        self.linear = np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS))
        self.fitted = False

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray):
        """Log odds per row, and the factor sums that the gradient needs too."""
        linear = np.add.reduceat(self.linear[slots] * values, starts)
        held = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(held, starts, axis=0)
        squares = np.add.reduceat(held * held, starts, axis=0)
        return linear + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def fit(self, rows: list[tuple[list[int], np.ndarray]], labels: list[int], batch: int = 64) -> Machine:
        """Logistic loss by AdaGrad; rows in a fixed random order."""
        if not rows:
            return self
        y = np.array(labels, float)
        rng = np.random.default_rng(11)
        grown, grown_f = np.full(self.linear.shape, 1e-3), np.full(self.factors.shape, 1e-3)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.linear[WORD_SLOTS] = np.log(share / (1 - share))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                mine = order[at : at + batch]
                sizes = np.array([len(rows[i][0]) for i in mine])
                slots = np.concatenate([rows[i][0] for i in mine])
                values = np.concatenate([rows[i][1] for i in mine])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                margin, sums = self.margins(slots, values, starts)
                wrong = np.repeat((1 / (1 + np.exp(-margin)) - y[mine]) / len(mine), sizes)
                held = values[:, None] * self.factors[slots]
                step = wrong[:, None] * values[:, None] * (np.repeat(sums, sizes, axis=0) - held)
                used, where = np.unique(slots, return_inverse=True)
                g = np.bincount(where, wrong * values) + 1e-6 * self.linear[used]
                gf = np.stack([np.bincount(where, step[:, k]) for k in range(FACTORS)], axis=1)
                gf += 1e-6 * self.factors[used]
                grown[used] += g * g
                grown_f[used] += gf * gf
                self.linear[used] -= 0.1 * g / np.sqrt(grown[used])
                self.factors[used] -= 0.03 * gf / np.sqrt(grown_f[used])
        self.fitted = True
        return self


def _rows(part: pa.RecordBatch, data: int, length: int) -> list[tuple[list[int], np.ndarray]]:
    pairs = zip(part.column(data).to_pylist(), part.column(length).to_pylist(), strict=True)
    return [inputs(d, n) for d, n in pairs]


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality",
        doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> Machine:
    """Fit on at most ``SAMPLE`` labelled rows where ``use`` holds: those of the smallest digest.

    The sample bounds what is broadcast and what comes to the driver (slots and values, no
    text). Rows without a label teach nothing; a document with several labels counts with each.
    Without any labelled row the machine stays unfitted and scores 0.5.
    """
    picked = (
        labels.where(use & F.col(label).isNotNull())
        .select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(SAMPLE)
    )
    held = docs.select(
        F.col(doc_id).alias("_doc"), F.col(text).cast("binary").alias("_raw"), F.col(length).cast("long").alias("_n")
    ).join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_id", "_raw", "_n", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                found = _rows(part, 1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(3),
                        pa.array([s for s, _ in found], pa.list_(pa.int32())),
                        pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
                    ],
                    names=["id", "label", "slots", "values"],
                )

    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    sample = held.mapInArrow(run, f"id {kind}, label int, slots array<int>, values array<float>").toArrow()
    rows = sorted(
        zip(sample["id"].to_pylist(), sample["label"].to_pylist(), sample["slots"], sample["values"], strict=True),
        key=lambda r: (r[0], r[1], len(r[2])),
    )
    made = [(s.values.to_numpy(), v.values.to_numpy().astype(float)) for _, _, s, v in rows]
    return Machine().fit(made, [r[1] for r in rows])


def score(docs: DataFrame, machine: Machine, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All columns of ``docs`` and quality_score from 0 to 1 for each whole text.

    Null and empty texts are scored by their statistics. A column of that name is replaced.
    """
    docs = docs.drop("quality_score")
    raw, size, kept = free_name(docs, "_raw"), free_name(docs, "_size"), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is a parameter
    k = len(kept)
    schema = widened(docs, "quality_score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, k, SLICE_BYTES):
                found = _rows(part, k, k + 1)
                starts = np.cumsum([0, *(len(s) for s, _ in found)])[:-1]
                slots = np.concatenate([np.array(s, np.int64) for s, _ in found])
                margin, _ = model.margins(slots, np.concatenate([v for _, v in found]), starts)
                chance = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) if model.fitted else np.full(len(found), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(k)), pa.array(chance)], names=schema.names
                )

    return docs.select(
        *kept, F.col(text).cast("binary").alias(raw), F.col(length).cast("long").alias(size)
    ).mapInArrow(run, schema)
