"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in few bits differ in very few bits of some part: if part i is given a
threshold t_i and the thresholds sum to ``max_bits - parts + 1``, every pair within ``max_bits``
is within t_i on at least one part. Correlated bits share a part, and dynamic programming deals
the thresholds by the estimated numbers of probes and candidates, from bit statistics of all
fingerprints. A fingerprint probes the keys of its parts with up to t_i bits left out; equal
keys meet in one group, where pairs are verified. A group emits a spanning forest of its links,
never its pairs; groups over ``BLOCK`` members are dealt in pairs of blocks to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm.common import free_name, released, slices, whole_groups, widened
from demandgrid.llm.components import connected_components
from demandgrid.session import materialize

BITS = 64
BLOCK = 8192
ROWS = 64  # of a group that are compared with the rest at once
PROBE_COST = 2000.0  # of a shuffled probe, in verified candidates
SLICE_BYTES = 4 << 20


def shingle_hashes(data: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included; fewer words than a shingle are one.

    A-Z count as lower case, words end at ASCII white space; without words there is none.
    """
    tokens = (data or b"").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in tokens)]
    starts = [0, *(e + 1 for e in ends[: n - shingle])]
    return np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)),
        np.uint64, n - shingle + 1,
    )


def simhash(
    data: bytes | None, shingle: int = 4, seed: int = 42, words: int = 1, distinct: bool = False
) -> list[int]:
    """Fingerprint words of UTF-8 bytes: majority of the shingles' hashes in each bit, 0 if no words.

    The first word is of the hashes themselves, further ones of the hashes mixed anew. Repeats
    of a shingle count, unless ``distinct``.
    """
    hashes = shingle_hashes(data, shingle, seed)
    if not len(hashes):
        return [0] * words
    if distinct:
        hashes = np.unique(hashes)
    ones = np.zeros((words, BITS), np.int64)
    for at in range(0, len(hashes), 255 * 256):
        ones += _set_bits(_mixed(hashes[at : at + 255 * 256], words))
    bits = np.packbits(2 * ones > len(hashes), axis=1, bitorder="little")
    return bits.view(np.uint64).ravel().tolist()


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hashes and, per further word, a permutation of them (the SplitMix64 finaliser)."""
    step = np.arange(1, words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = hashes[None, :] + step[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([hashes[None, :], x ^ (x >> np.uint64(31))])


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes of each row each bit is set; 255 hashes are added bytewise at once."""
    words, n = hashes.shape
    padded = np.zeros((words, -(-n // 255) * 255), np.uint64)
    padded[:, :n] = hashes
    runs_ = padded.reshape(words, -1, 255)
    out = np.empty((words, BITS), np.int64)
    for b in range(8):
        lane = ((runs_ >> np.uint64(b)) & np.uint64(0x0101010101010101)).sum(axis=2, dtype=np.uint64)
        out[:, b::8] = lane.view(np.uint8).reshape(words, -1, 8).sum(axis=1, dtype=np.int64)
    return out


def word_names(name: str, words: int) -> list[str]:
    return [name, *(f"{name}_{k}" for k in range(1, words))]


def fingerprints(
    docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "simhash", words: int = 1,
    distinct: bool = False,
) -> DataFrame:
    """All columns of ``docs`` but the text, and its fingerprint words as signed 64-bit integers."""
    raw = free_name(docs, "_raw")
    names = word_names(name, words)
    kept = [c for c in docs.columns if c not in (text, *names)]
    schema = widened(docs.select(*kept), ", ".join(f"`{c}` long" for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(kept), SLICE_BYTES):
                texts = part.column(len(kept)).to_pylist()
                found = np.array(
                    [simhash(t, shingle, words=words, distinct=distinct) for t in texts], np.uint64
                ).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(kept))), *(pa.array(c) for c in found.T)],
                    names=schema.names,
                )

    return docs.select(*kept, F.col(text).cast("binary").alias(raw)).mapInArrow(released(run), schema)


def bit_statistics(prints: DataFrame, names: list[str]) -> list[tuple[int, np.ndarray]]:
    """Per word: how many rows there are, and for each pair of bits in how many both are set."""
    size, words = BITS * BITS, len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((words, BITS, BITS)), 0
        for batch in batches:
            for k in range(words):
                values = batch.column(k).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
                total[k] += bits.T @ bits
            n += batch.num_rows
        if n:
            cells = [*total.ravel().astype(np.int64).tolist(), n]
            yield pa.RecordBatch.from_pydict({"cell": list(range(len(cells))), "n": cells})

    cells = prints.select(*names).mapInArrow(released(run), "cell long, n long")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 64 x 64 a word + 1 at most
    found = np.zeros(words * size + 1)
    for r in rows:
        found[r["cell"]] = r["n"]
    return [(int(found[-1]), both) for both in found[:-1].reshape(words, BITS, BITS)]


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of equal size, each grown from a bit by its strongest correlations."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free = list(range(BITS))
    out = []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        mine = [max(free, key=lambda b: tie[b, free].sum())]
        free.remove(mine[0])
        while len(mine) < size:
            b = max(free, key=lambda b: tie[b, mine].sum())
            mine.append(b)
            free.remove(b)
        out.append(sorted(mine))
    return out


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], max_bits: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with the sum the principle asks for; -1 leaves a part out."""
    n = max(n, 1)  # an empty table gets the fewest probes
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)
    table = []
    for bits in groups:
        chance = np.array([1.0])  # of a pair's differing bits inside the part
        for b in bits:
            chance = np.convolve(chance, [1 - differ[b], differ[b]])
        row = [0.0]
        for t in range(min(max_bits, len(bits)) + 1):  # beyond its bits a part has no probe
            meet = sum(chance[d] * comb(len(bits) - d, t - d) for d in range(min(t, len(bits)) + 1))
            row.append(n * comb(len(bits), t) * PROBE_COST + n * n / 2 * meet)
        table.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in table:
        grown: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, given) in best.items():
            for t, c in enumerate(row, start=-1):
                if total + t not in grown or cost + c < grown[total + t][0]:
                    grown[total + t] = (cost + c, [*given, t])
        best = grown
    return best[max_bits - len(groups) + 1]


def probe_masks(n: int, both: np.ndarray, max_bits: int) -> list[int]:
    """The bits each probe keeps, over the cheapest number of parts."""
    plans = []
    for parts in range(2, min(max_bits + 1, BITS) + 1):
        groups = grouped_bits(n, both, parts)
        cost, given = thresholds(n, both, groups, max_bits)
        plans.append((cost, groups, given))
    _, groups, given = min(plans, key=lambda x: x[0])
    masks = []
    for bits, t in zip(groups, given, strict=True):
        if t >= 0:
            whole = sum(1 << b for b in bits)
            masks += [whole - sum(1 << b for b in out) for out in combinations(bits, t)]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_forest(
    own: np.ndarray, wide: np.ndarray, bounds: np.ndarray, max_bits: int, total_bits: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links inside groups: index pairs, fewer than the members.

    Linked are members whose ``own`` words differ in at most ``max_bits`` and whose ``wide`` rows
    of words differ in at most ``total_bits``.
    """
    firsts: list[np.ndarray] = []
    seconds: list[np.ndarray] = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        v, w, label = own[lo:hi], wide[lo:hi], np.arange(hi - lo)
        for at in range(0, hi - lo - 1, ROWS):
            near = np.bitwise_count(v[at : at + ROWS, None] ^ v[None, at + 1 :]) <= max_bits
            i, j = np.nonzero(near)
            i, j = i + at, j + at + 1
            open_ = (i < j) & (label[i] != label[j])
            i, j = i[open_], j[open_]
            if total_bits is not None and len(i):
                close = np.bitwise_count(w[i] ^ w[j]).sum(axis=1, dtype=np.int64) <= total_bits
                i, j = i[close], j[close]
            while len(i):  # one member's links at a time
                mine = i == i[0]
                roots, at_root = np.unique(label[j[mine]], return_index=True)
                firsts.append(np.full(len(roots), lo + i[0]))
                seconds.append(lo + j[mine][at_root])
                label[np.isin(label, roots)] = label[i[0]]
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
            if (label == label[0]).all():  # one component needs no more pairs
                break
    none = [np.zeros(0, np.int64)]
    return np.concatenate(firsts or none), np.concatenate(seconds or none)


def near_pairs(
    prints: DataFrame, name: str, max_bits: int, words: int = 1, total_bits: int | None = None
) -> DataFrame:
    """Links (a, b) that join distinct fingerprints as all their pairs would.

    Of one word: all pairs within ``max_bits``; a and b are fingerprints. Of several: all pairs
    that are within ``max_bits`` on some word and within ``total_bits`` over all; a and b are
    the ``node`` of their words.
    """
    names = word_names(name, words)
    masks = [
        (k, mask)
        for k, (n, both) in enumerate(bit_statistics(prints, names))
        for mask in probe_masks(n, both, max_bits)
    ]
    word_of = np.array([k for k, _ in masks])
    keys = F.array(*(
        F.struct(F.lit(i).alias("mask"), F.col(names[k]).bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, (k, m) in enumerate(masks)
    ))
    values = [f"value_{k}" for k in range(words)]
    probes = prints.select(F.inline(keys), *(F.col(c).alias(v) for c, v in zip(names, values, strict=True)))
    hot = (
        probes.groupBy("mask", "key").count().where(F.col("count") > BLOCK)
        .withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    )
    mine = F.pmod(F.xxhash64(*values), F.col("blocks")).cast("int")
    pairs = F.when(
        F.col("blocks").isNull(), F.array(F.lit(0))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.least(j, mine) * F.col("blocks") + F.greatest(j, mine),
        )
    )
    # one key in BLOCK probes at most is hot, so the probes are never shuffled to find theirs
    dealt = (
        probes.join(F.broadcast(hot), ["mask", "key"], "left")
        .select("mask", "key", F.explode(pairs).alias("pair"), *values)
    )
    ends = [f"{end}_{k}" for end in "ab" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, (0, 1, 2)):
            wide = np.stack([group.column(3 + k).to_numpy() for k in range(words)], axis=1).view(np.uint64)
            own = wide[np.arange(len(wide)), word_of[group.column(0).to_numpy()]]
            a, b = group_forest(own, wide, bounds, max_bits, total_bits)
            both = np.concatenate([wide[a], wide[b]], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in both.T], names=ends)

    keyed = dealt.repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair")
    found = keyed.mapInArrow(released(run), ", ".join(f"{c} long" for c in ends))
    return found.select(node(ends[:words]).alias("a"), node(ends[words:]).alias("b"))


def node(names: list[str]) -> Column:
    """One number for a fingerprint: itself, or 64 hashed bits of its words."""
    return F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)


def near_duplicates(
    docs: DataFrame, max_bits: int = 4, shingle: int = 4, doc_id: str = "doc_id", text: str = "text",
    words: int = 1, total_bits: int | None = None,
) -> DataFrame:
    """(doc_id, simhash, component_id): the smallest id reachable over links of fingerprints.

    One word links by ``max_bits`` alone. Several words find edited copies that one word
    misses: they link texts near on any word, if all words differ in at most ``total_bits``.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows get one row
    each. A null id never names a component; a component of null ids only is null.
    """
    names = word_names("simhash", words)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(ids, shingle=shingle, words=words), "prints")
    distinct = materialize(
        prints.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", node(names)), "values"
    )
    edges = near_pairs(distinct, "simhash", max_bits, words, total_bits)
    member = materialize(connected_components(edges).withColumnRenamed("component", "root"), "linked")
    rooted = distinct.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return (
        prints.withColumn("node", node(names)).join(named, "node").select("doc_id", "simhash", "component_id")
    )
