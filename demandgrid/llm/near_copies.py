"""Near copies: SimHash finds the candidates, similarity of the shingle sets decides.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at
least ``PERCENT``; a group is what such links connect. Fingerprints of ``WORDS`` words of 64 bits
over the distinct shingles propose pairs. At a similarity of 0.8 two texts differ in 15 % of the
bits: some word is within ``MAX_BITS`` with a chance of 0.99, all are within ``TOTAL_BITS`` with
0.999. Texts of fewer than a dozen shingles deviate more, their chance is lower.

Inside a component of proposed links, pairs are verified in rounds. The first two verify a
spanning forest of the links between parts not yet joined, each from other centres, so a family of
M copies costs about M verifications. The last compares, inside tasks, every near pair of parts that
are still apart, so nothing hangs on which links a forest happened to hold: the largest part is
dealt once for each block of the others, never with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.llm import simhash
from demandgrid.llm.common import released, slices, whole_groups
from demandgrid.llm.components import connected_components
from demandgrid.session import materialize

SHINGLE = 5  # words
PERCENT = 80  # of two texts' shingles that are shared
WORDS, MAX_BITS, TOTAL_BITS = 7, 9, 92
BLOCK = 8192  # members of a component that meet in one task, twice at most
ROWS = 64  # of a block that are compared with the rest at once
FORESTS = 2  # rounds of verified forests before all near pairs that are left
HASHES = 1 << 20  # shingles of a block in the last round
TRIED = 256  # sets that are compared with a set at once
_NAMES = simhash.word_names("simhash", WORDS)
_LINK = "a long, b long, label_a long, label_b long"


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles) of (node, text): the sorted hashes of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, simhash.SLICE_BYTES):
                sets = [
                    np.unique(simhash.shingle_hashes(t, shingle)).view(np.int64)
                    for t in part.column(1).to_pylist()
                ]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "shingles"]
                )

    raw = texts.select("node", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(released(run), "node long, shingles array<long>")


def close_pairs(
    wide: np.ndarray, label: np.ndarray, block: np.ndarray, across: bool, forest: bool, order: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different labels within ``TOTAL_BITS``: all, or a forest that joins the same.

    ``across`` takes pairs of different blocks only. Members of the most frequent label are never
    compared with each other; the others come in ``order``.
    """
    names, counts = np.unique(label, return_counts=True)
    main = label == names[np.argmax(counts)]
    at = np.lexsort((order, main))
    wide, own, side = wide[at], label[at].copy(), block[at]
    rows = max(int((~main).sum()), 1)
    for lo in range(0, min(rows, len(at) - 1), ROWS):
        hi = min(lo + ROWS, rows)
        bits = np.zeros((hi - lo, len(at) - lo), np.uint16)
        for k in range(wide.shape[1]):
            bits += np.bitwise_count(wide[lo:hi, None, k] ^ wide[None, lo:, k])
        near = (bits <= TOTAL_BITS) & (own[lo:hi, None] != own[None, lo:])
        if across:
            near &= side[lo:hi, None] != side[None, lo:]
        i, j = np.nonzero(near)
        i, j = i + lo, j + lo
        i, j = i[i < j], j[i < j]
        if not forest:
            yield at[i], at[j]
            continue
        while len(i):  # one member's links at a time
            to = j[i == i[0]]
            parts, first = np.unique(own[to], return_index=True)
            yield at[np.full(len(parts), i[0])], at[to[first]]
            own[np.isin(own, parts)] = own[i[0]]
            apart = own[i] != own[j]
            i, j = i[apart], j[apart]


def candidates(members: DataFrame, turn: int) -> DataFrame:
    """(a, b, label_a, label_b): forests of near nodes of one root and different labels.

    Components over ``BLOCK`` members are dealt in pairs of blocks; the first turn leaves it at the
    blocks themselves, whose forests make few parts of many members.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")),
    )
    if turn == 0:
        meets = F.array(F.col("block") * (F.col("blocks") + 1))
    dealt = (
        members.join(sizes, "root").withColumn("block", mine)
        .select("root", F.explode(meets).alias("pair"), "block", "node", "label", *_NAMES)
        .repartition("root", "pair").sortWithinPartitions("root", "pair")
    )
    stir = np.uint64(0x9E3779B97F4A7C15 + 2 * turn * 0x5851F42D4C957F2D & (1 << 64) - 1)

    def links(held: list[tuple[np.ndarray, np.ndarray]], node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = (node[i], node[j], label[i], label[j])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in ends], ["a", "b", "label_a", "label_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, (0, 1)):
            block, node, label, *words = (group.column(k).to_numpy() for k in range(2, 5 + WORDS))
            wide = np.stack(words, axis=1).view(np.uint64)
            order = node.view(np.uint64) * stir
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = slice(lo, hi)
                across = bool((block[own] != block[lo]).any())
                for i, j in close_pairs(wide[own], label[own], block[own], across, True, order[own]):
                    held.append((i + lo, j + lo))
            if held:
                yield links(held, node, label)

    return dealt.mapInArrow(released(run), _LINK)


def verified(links: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The links whose shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        links.join(left, "a").join(right, "b")
        .withColumn("shared", shared)
        .where(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared")))
        .select("label_a", "label_b")
    )


def remaining(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(label_a, label_b): verified links that join the labels of a root as all near pairs would.

    Members outside the root's largest label are dealt in blocks of about ``HASHES`` shingles that
    meet each other and the blocks of the largest label; the sets travel with the members.
    """
    dressed = members.join(sets, "node").withColumn("weight", F.size("shingles").cast("long"))
    sizes = dressed.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    rank = F.struct("n", "label")
    heads = sizes.groupBy("root").agg(
        F.max_by("label", rank).alias("head"), F.max_by("weight", rank).alias("heavy"), F.sum("weight").alias("all")
    )
    main, few, many = F.col("label") == F.col("head"), F.col("few"), F.col("many")
    mine = F.pmod(F.xxhash64("node"), F.when(main, many).otherwise(few))

    def each(n: Column, task: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), task)

    own = F.col("block")
    others = each(few, lambda j: F.least(j, own) * few + F.greatest(j, own))
    meets = F.when(main, each(few, lambda p: few * few + p * many + own)).otherwise(
        F.concat(others, each(many, lambda q: few * few + own * many + q))
    )
    dealt = (
        dressed.join(
            heads.select(
                "root", "head", F.ceil((F.col("all") - F.col("heavy")) / HASHES).alias("few"),
                F.ceil(F.col("heavy") / HASHES).alias("many"),
            ),
            "root",
        )
        .withColumn("block", mine)
        .select(
            "root", F.explode(meets).alias("pair"), F.when(main, F.lit(-1)).otherwise(own).alias("side"),
            "label", "shingles", *_NAMES,
        )
        .repartition("root", "pair").sortWithinPartitions("root", "pair")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, (0, 1)):
            side, label = (group.column(k).to_numpy() for k in (2, 3))
            lists = group.column(4).combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            wide = np.stack([group.column(5 + k).to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
            found = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part, across = slice(lo, hi), bool((side[lo:hi] != side[lo]).any())
                near = close_pairs(wide[part], label[part], side[part], across, False, np.arange(hi - lo))
                pairs = ((i + lo, j + lo) for i, j in near)
                found += verified_forest(pairs, label, flat, ends, percent)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in np.array(found, np.int64).T], ["label_a", "label_b"]
                )

    return dealt.mapInArrow(released(run), "label_a long, label_b long")


def verified_forest(
    pairs: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray, flat: np.ndarray, ends: np.ndarray,
    percent: int,
) -> list[tuple[int, int]]:
    """Label pairs that join as the similar ones of ``pairs`` do; member i's set is ``flat[ends[i]:ends[i + 1]]``."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while x in over:
            x = over[x]
        return x

    found = []
    for firsts, seconds in pairs:
        for i in np.unique(firsts).tolist():
            x, left = flat[ends[i] : ends[i + 1]], seconds[firsts == i]
            while len(left):
                mine = top(int(label[i]))
                apart = {v for v in np.unique(label[left]).tolist() if top(v) != mine}
                left = left[np.isin(label[left], list(apart))] if apart else left[:0]
                tried, left = left[:TRIED], left[TRIED:]
                if not len(tried):
                    break
                size = ends[tried + 1] - ends[tried]
                every = np.concatenate([flat[ends[j] : ends[j + 1]] for j in tried.tolist()])
                at = np.minimum(np.searchsorted(x, every), len(x) - 1)
                shared = np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(size) - size)
                for j in tried[100 * shared >= percent * (len(x) + size - shared)].tolist():
                    a, b = top(int(label[i])), top(int(label[j]))
                    if a != b:
                        over[b] = a
                        found.append((int(label[i]), int(label[j])))
    return found


def _labelled(members: DataFrame, rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(node, label) of all members: equal labels are connected by verified links."""
    wanted = members.select("node", F.col("least.doc_id").alias("_id"), F.col("least.digest").alias("_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    texts = rows.join(wanted, same).select("node", "text").dropDuplicates(["node"])
    sets = materialize(shingle_sets(texts, shingle), "shingles")
    members = members.drop("least")
    for turn in range(FORESTS + 1):
        apart = members.groupBy("root").agg((F.min("label") != F.max("label")).alias("apart")).where("apart")
        open_ = materialize(members.join(apart, "root", "left_semi"), "open")
        if open_.isEmpty():
            break
        if turn:  # most members are settled by now; later joins shuffle the sets of the others only
            sets = materialize(sets.join(open_.select("node"), "node", "left_semi"), "shingles")
        links = verified(candidates(open_, turn), sets, percent) if turn < FORESTS else remaining(open_, sets, percent)
        parts = connected_components(links, "label_a", "label_b")
        renamed = parts.select(F.col("node").alias("label"), F.col("component"))
        members = materialize(
            members.join(renamed, "label", "left").withColumn("label", F.coalesce("component", "label"))
            .drop("component"),
            "members",
        )
    return members.select("node", "label")


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE
) -> DataFrame:
    """One row a group of near copies: (doc_id, digest, members) of the row that stays for it.

    The row that stays has the smallest (doc_id, digest) of its group, null ids after all others;
    ``digest`` is the SHA-1 of its text, ``members`` the number of rows. Rows are told apart by
    id and digest, so different texts under one id are judged on their own. Texts whose words
    equal but for case and white space are one text, as are texts of equal fingerprints, which
    differ in next to no shingle. Null texts and texts without words have no shingle and are left out.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.sha1(F.col(text).cast("binary")).alias("digest"), F.col(text).alias("text")
    ).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    prints = simhash.fingerprints(rows, shingle=shingle, words=WORDS, distinct=True)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    nodes = materialize(
        prints.groupBy(*_NAMES).agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("members"))
        .withColumn("node", simhash.node(_NAMES)),
        "nodes",
    )
    edges = simhash.near_pairs(nodes, "simhash", MAX_BITS, WORDS, TOTAL_BITS)
    roots = connected_components(edges).withColumnRenamed("component", "root")
    members = materialize(nodes.join(roots, "node").withColumn("label", F.col("node")).drop("members"), "members")
    labels = _labelled(members, rows, percent, shingle)
    grouped = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return (
        grouped.groupBy("label").agg(F.min("least").alias("least"), F.sum("members").alias("members"))
        .select("least.doc_id", "least.digest", "members")
    )
