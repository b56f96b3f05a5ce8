"""Removal of repeated word passages, found over difference-cover anchors.

A window of ``WINDOW`` words is removed where its word sequence also starts anywhere else. Only
words at positions whose remainder modulo ``PERIOD`` is in a difference cover start an anchor:
any two remainders are brought into the cover by one common shift below the period, so two
equal windows hold an equal anchor at the same distance from their starts. Anchors that occur
once rule out their windows; those that repeat are extended to the windows around them, and
these are counted by their own hash over the whole corpus.

Hashes travel in blocks: a task sends what it found for a bucket of hash values as one row of
arrays, and a hash once per task, marked if the task saw it more than once. So a passage that a
third of all documents share reaches its bucket once per task, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import free_name, released, runs, slices, widened

WINDOW = 35
# A perfect difference cover and its period.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
SLICE_BYTES = 2 << 20
BUCKET_BYTES = 48 << 20  # of text whose hashes share a bucket
LEAST_BUCKETS = 48

_M = 2**64
_BYTE, _WORD, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F  # odd bases
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _tables(base: int, log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses."""
    out = []
    for b in (base, pow(base, -1, _M)):
        p = np.full(1 << log_size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _tables(base, max(16, (max(n, 1) - 1).bit_length()))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def _window_hash(values: np.ndarray, base: int, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` values, from prefix sums modulo 2^64."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the concatenated texts, and where each text's words start."""
    inside = ~_SPACE[data]
    brk = np.zeros(len(data) + 1, bool)  # no word goes on over the start of a text
    brk[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | brk[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | brk[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in parts, so that tables of powers stay small
        base = starts[at]
        stop = max(int(np.searchsorted(ends, base + SLICE_BYTES, side="right")), at + 1)
        part = data[base : ends[stop - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(_BYTE, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out, np.searchsorted(starts, offsets)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the bounds of its rows; nulls are empty."""
    column = pa.compute.fill_null(column.cast(pa.binary()), b"")
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


BLOCK_COLUMNS = "bucket long, h array<long>, g array<int>, many array<boolean>, key array<long>, pos array<int>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def _blocks(
    h: np.ndarray, g: np.ndarray, key: np.ndarray, pos: np.ndarray, buckets: int
) -> pa.RecordBatch:
    """Rows of one task part: each hash once, for its bucket; known repeats in buckets above.

    Places of hashes that the part itself holds twice are settled and skip the count.
    """
    order = np.lexsort((g, h))
    h, g, key, pos = h[order], g[order], key[order], pos[order]
    bounds = runs(h, g)
    size = np.diff(bounds)
    many = size > 1
    lead = bounds[:-1]
    bucket = (h[lead] >> np.uint64(20)) % np.uint64(buckets)
    deal = np.lexsort((order[lead], bucket))  # by text in a bucket: its key repeats and compresses
    lead, many, bucket = lead[deal], many[deal], bucket[deal].astype(np.int64)
    cuts = runs(bucket)
    asked = pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts[:-1]]),
            _lists(h[lead].view(np.int64), cuts, pa.int64()), _lists(g[lead].view(np.int32), cuts, pa.int32()),
            _lists(many, cuts, pa.bool_()), _lists(key[lead], cuts, pa.int64()),
            _lists(pos[lead].astype(np.int32), cuts, pa.int32()),
        ],
        names=["bucket", "h", "g", "many", "key", "pos"],
    )
    settled = np.repeat(size > 1, size)
    if not settled.any():
        return asked
    none = np.zeros(2, np.int64)
    known = pa.RecordBatch.from_arrays(
        [
            pa.array([buckets + int(h[0] % np.uint64(buckets))]),
            _lists(h[:0].view(np.int64), none, pa.int64()), _lists(g[:0].view(np.int32), none, pa.int32()),
            _lists(many[:0], none, pa.bool_()),
            _lists(key[settled], np.array([0, settled.sum()]), pa.int64()),
            _lists(pos[settled].astype(np.int32), np.array([0, settled.sum()]), pa.int32()),
        ],
        names=asked.schema.names,
    )
    return pa.Table.from_batches([asked, known]).combine_chunks().to_batches()[0]


def _places(key: np.ndarray, pos: np.ndarray) -> pa.Table:
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    bounds = runs(key)
    return pa.table(
        [pa.array(key[bounds[:-1]] if len(key) else key), _lists(pos, bounds, pa.int32())],
        names=["key", "pos"],
    )


def _repeats(blocks: DataFrame, buckets: int) -> DataFrame:
    """(key, positions) of all hashes that occur more than once anywhere."""

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()

        def flat(name: str) -> np.ndarray:
            return pa.concat_arrays(
                [c.flatten() for c in rows.column(name).chunks] or [pa.array([], pa.int64())]
            ).to_numpy(zero_copy_only=False)

        key, pos = flat("key"), flat("pos")
        if rows.column("bucket")[0].as_py() < buckets:
            h, g, many = flat("h"), flat("g"), flat("many").astype(bool)
            order = np.lexsort((g, h))
            bounds = runs(h[order], g[order])
            seen = np.add.reduceat(np.where(many, 2, 1)[order], bounds[:-1])
            twice = np.zeros(len(h), bool)
            twice[order] = np.repeat(seen > 1, np.diff(bounds))
            twice &= ~many  # the task that holds several has settled its own
            key, pos = key[twice], pos[twice]
        return _places(key, pos)

    found = blocks.groupBy("bucket").applyInArrow(count, "key long, pos array<int>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("pos")).alias("pos"))


def mark_repeats(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, starts): the word positions in each text at which a repeated window starts.

    ``key`` identifies a row's text; rows with equal keys must be equal texts. The rows of
    ``docs`` are joined whole, so a later join by the key reuses their exchange.
    """
    bytes_ = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, -(-bytes_ // BUCKET_BYTES))
    text_at, key_at = docs.columns.index(text), docs.columns.index(key)
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                words, first = word_hashes(*_bytes_of(part.column(1)))
                size = np.diff(first)
                h = _window_hash(words, _WORD, ANCHOR)
                doc = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(words)) - first[doc]
                fits = (pos + ANCHOR <= size[doc]) & (size[doc] >= WINDOW) & in_cover[pos % PERIOD]
                at = np.flatnonzero(fits)
                if len(at):
                    keys = part.column(0).to_numpy()
                    zero = np.zeros(len(at), np.uint32)
                    yield _blocks(h[at], zero, keys[doc[at]], pos[at], buckets)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at, SLICE_BYTES):
                words, first = word_hashes(*_bytes_of(part.column(text_at)))
                size = np.diff(first)
                last = np.maximum(first[1:] - WINDOW, first[:-1] - 1)  # last start of a window
                near = part.column(part.num_columns - 1)
                doc = np.repeat(np.arange(len(size)), np.asarray(pa.compute.list_value_length(near)))
                at = near.flatten().to_numpy() + first[doc]
                low = np.maximum(at - (PERIOD - 1), first[doc])
                high = np.minimum(at, last[doc])
                turns = np.zeros(len(words) + 2, np.int64)
                ok = low <= high
                np.add.at(turns, low[ok], 1)
                np.add.at(turns, high[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(turns)[: len(words)] > 0)
                if not len(at):
                    continue
                h = _window_hash(words, _WORD, WINDOW)[at]
                g = (_window_hash(words, _OTHER, WINDOW)[at] >> np.uint64(32)).astype(np.uint32)
                doc = np.searchsorted(first, at, side="right") - 1
                keys = part.column(key_at).to_numpy()
                yield _blocks(h, g, keys[doc], at - first[doc], buckets)

    data = F.col(text).cast("binary").alias("data")
    near = _repeats(docs.select(key, data).mapInArrow(released(anchors), BLOCK_COLUMNS), buckets)
    near = near.select(F.col("key").alias("_near"), F.col("pos").alias("_places"))
    extended = docs.join(near, F.col(key) == F.col("_near"))
    # all columns, though two are used: only an equal exchange is reused
    found = extended.select(*docs.columns, "_places").mapInArrow(released(windows), BLOCK_COLUMNS)
    return _repeats(found, buckets).withColumnsRenamed({"key": key, "pos": "starts"})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed, kept_text.

    Words are runs of anything but ASCII white space, unchanged. kept_text joins the words that
    no repeated window covers by one space. A null text has no words and an empty kept_text.
    Repeated rows repeat each other's windows, also under one id; null ids are like any other.
    Columns of the new names are replaced. Counts cover all texts given, whole.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    key, starts = free_name(docs, "_key"), free_name(docs, "_starts")
    keyed = docs.withColumn(key, F.xxhash64(F.lit(1), F.col(doc_id), F.lit(2), F.col(text)))
    marked = mark_repeats(keyed, text, key).withColumnsRenamed({key: "_of", "starts": starts})
    joined = keyed.join(marked, F.col(key) == F.col("_of"), "left")
    raw = F.col(text).cast("binary").alias("_raw")
    schema = widened(docs, "n_words long, n_removed long, kept_text string")
    kept = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept), SLICE_BYTES):
                total, gone, left = [], [], []
                rows = zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1), strict=True)
                for data, at in rows:
                    words = (data or b"").split()
                    total.append(len(words))
                    if at.is_valid:
                        turns = np.zeros(len(words) + 1, np.int64)
                        begin = np.unique(at.values.to_numpy())
                        turns[begin] += 1
                        turns[begin + WINDOW] -= 1
                        stay = np.cumsum(turns)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(stay).tolist()]
                    gone.append(total[-1] - len(words))
                    left.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(len(kept))),
                        pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string()),
                    ],
                    names=schema.names,
                )

    return joined.select(*kept, raw, starts).mapInArrow(released(cut), schema)
