"""Whitening, vector codes and resharding against brute force, on awkward rows and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest

from demandgrid.llm import codes, sharding, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, code string, n long"


def vector_rows(seed=0, n=700, dim=16):
    rng = np.random.default_rng(seed)
    made = (rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim)) * 0.1).astype(np.float32)
    made[n // 2 : n // 2 + n // 3] = made[0]  # a third are copies
    rows = [(int(i), [float(c) for c in v], None if i % 5 == 0 else int(i % 3), "x", "c", 7) for i, v in enumerate(made)]
    bad = made[1].tolist()
    rows += [
        (9001, None, 1, None, None, None), (9002, [], 1, None, None, None), (9003, [None, *bad[1:]], 1, None, None, None),
        (9004, [float("nan"), *bad[1:]], 1, None, None, None), (9005, [float("inf"), *bad[1:]], 1, None, None, None),
        (9006, bad[:3], 1, None, None, None), (None, bad, 2, None, None, None), (5, made[6].tolist(), 2, None, None, None),
    ]
    return rows


def usable(rows, dim=16):
    return [r for r in rows if r[1] and len(r[1]) == dim and all(c is not None and np.isfinite(c) for c in r[1])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(5).persist()


def test_whitening_is_the_dense_one(vectors):
    rows = usable(vector_rows())
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - sums / n) @ axes / np.sqrt(values)
    got = whitening.whiten(vectors, 10).collect()
    assert len(got) == 10 * len(rows) and {r["n"] for r in got} == {n}
    far = ((n * x - sums) ** 2).sum(axis=1)
    key = lambda r: (r[0] is None, r[0] or 0)
    for c in range(1, 11):
        mine = sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c and r["vec_id"] is not None)
        theirs = sorted(((r[0], int(d), float(w)) for r, d, w in zip(rows, far, want[:, c - 1]) if r[0] is not None))
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        share = {r["explained"] for r in got if r["component"] == c}
        assert len(share) == 1 and abs(share.pop() - values[c - 1] / values.sum()) < 1e-12
    assert {r["identity_error"] for r in got}.pop() < 1e-9
    assert sorted({key(r) for r in got if r["vec_id"] is None}) == [(True, 0)]


def test_whitening_of_many_blocks_and_of_little_variance(spark, vectors, monkeypatch):
    want = {(r["vec_id"], r["component"], r["deviation"]): abs(r["whitened"]) for r in whitening.whiten(vectors, 3).collect()}
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    got = {(r["vec_id"], r["component"], r["deviation"]): abs(r["whitened"]) for r in whitening.whiten(vectors, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.5, 2.0]), (3, [1e30, 2.0])], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    assert whitening.whiten(flat.where("vec_id = 1")).count() == 0
    assert whitening.whiten(flat.where("vec_id = 0")).count() == 0
    big = whitening.whiten(flat).select("vec_id", "deviation").collect()
    assert all(r["deviation"] is None for r in big if r["vec_id"] == 3)


def lloyd(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [np.floor(1024 * c) for c in r[1]]))
    x = np.floor(1024 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64)
    split = np.split(x, parts, axis=1)
    book = [p[:entries].copy() for p in split]

    def nearest(p, b):
        far = ((p[:, None, :] - b[None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        for p, b in zip(split, book):
            at = nearest(p, b)[0]
            for j in np.unique(at):
                b[j] = p[at == j].sum(axis=0) // (at == j).sum()
    last = [nearest(p, b) for p, b in zip(split, book)]
    return rows, np.stack([a for a, _ in last], axis=1).tolist(), sum(e for _, e in last).tolist(), book


def test_codes_are_those_of_full_scans(vectors):
    rows, code, error, book = lloyd(usable(vector_rows()), 4, 70, 4)
    coded, found = codes.train_codes(vectors, entries=70)
    assert all((a == b).all() for a, b in zip(found, book))
    assert sorted((str(r["vec_id"]), r["label"] or -1, r["code"], r["error"]) for r in coded.collect()) == sorted(
        (str(r[0]), r[2] or -1, c, e) for r, c, e in zip(rows, code, error))
    sums = {}
    for r, e in zip(rows, error):
        sums[r[2]] = sums.get(r[2], 0) + e
    got = codes.label_errors(coded).collect()
    assert len(got) == len(rows) and all(r["label_error"] == sums[r["label"]] for r in got)
    text = ",".join(str(v) for b in book for v in b.ravel())
    assert codes.book_digest(found) == hashlib.sha256(text.encode()).hexdigest()


def test_bounds_pass_over_groups_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (96, 4))
    x = (centres[rng.integers(0, 96, 3000)] + rng.integers(-20, 20, (3000, 4))).astype(np.int64)
    book = x[:96].copy()
    history = [[book]]
    code, best, low = codes._scan(x, book)
    stamp = np.zeros(low.shape, np.uint8)
    seen = []
    for _ in range(5):
        book = book.copy()
        for j in np.unique(code):
            book[j] = x[code == j].sum(axis=0) // (code == j).sum()
        history.append([book])
        code, best, low, stamp, n = codes._reassign(x, code, low, stamp, history, 0, codes._drifts(history)[0])
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (far.argmin(axis=1) == code).all() and (far.min(axis=1) == best).all()
        far[np.arange(len(x)), code] = 2**40
        for g, (s, e) in enumerate(codes._spans(96)):
            assert (low[:, g] - codes._drifts(history)[0][stamp[:, g], g] <= np.sqrt(far[:, s:e].min(axis=1)) + 1e-9).all()
        seen.append(n / low.size)
    assert seen[-1] < 0.6


def test_codes_of_few_or_no_vectors(spark, vectors):
    few = vectors.where("vec_id < 9")
    rows, code, error, book = lloyd([r for r in usable(vector_rows()) if r[0] is not None and r[0] < 9], 4, 256, 4)
    coded, found = codes.train_codes(few)
    assert [len(b) for b in found] == [len(b) for b in book] and sorted(r["error"] for r in coded.collect()) == sorted(error)
    none, empty = codes.train_codes(vectors.where("vec_id > 99999"))
    assert none.count() == 0 and empty == [] and codes.label_errors(none).count() == 0
    with pytest.raises(ValueError):
        codes.train_codes(few, parts=3)


def test_flow_moves_the_fewest_bytes():
    sizes, room = {0: 50, 1: 10, 2: 40}, {0: 25, 1: 25, 2: 25, 3: 25}
    flow = sharding.min_cost_flow(sizes, room)
    assert sum(f for (i, j), f in flow.items() if i != j) == 25 + 15
    assert all(sum(f for (i, _), f in flow.items() if i == s) == n for s, n in sizes.items())
    assert all(sum(f for (_, j), f in flow.items() if j == s) <= c for s, c in room.items())
    # shard 3 is dear to reach from 0: cheaper by way of a shard that passes as much on
    dear = sharding.min_cost_flow(sizes, room, {(0, 3): 9})
    assert (0, 3) not in dear and sum(f for (i, j), f in dear.items() if i != j) == 50
    with pytest.raises(ValueError):
        sharding.min_cost_flow({0: 5}, {0: 4})


DOCS = "doc_id long, text string, size string, shard string, row string"


def test_resharding_moves_whole_blocks_and_levels_sizes(spark):
    rng = np.random.default_rng(2)
    texts = ["é" * int(v) for v in rng.integers(0, 400, 1500)] + ["copy " * 60] * 900
    rows = [(i, t, "s", "h", "r") for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (3, "other", None, None, None), (3, "other", None, None, None), (4, "", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    old, new = sharding.balanced_shards(docs)
    got = sharding.read_layout(spark, new).select("row.doc_id", "row.text", "size", "crc", "shard", "slot").collect()
    raw = lambda t: (t or "").encode()
    assert sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in got) == sorted(
        (str(r[0]), str(r[1]), len(raw(r[1])) + 1, zlib.crc32(raw(r[1]))) for r in rows)
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(16)) and sizes == new.sizes()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 801
    total = sum(sizes.values())
    moved = sum(old.blocks[b][1] for b in old.blocks if old.blocks[b][0] != new.blocks[b][0])
    least = sum(max(v - total / 16, 0) for v in old.sizes().values())
    assert moved <= 1.05 * least
    assert set(old.parts) & set(new.parts)  # files without a moved block stay
    fewer, _ = sharding.reshard(spark, new, sharding.equal_capacities(total, 5))
    again = sharding.read_layout(spark, fewer).select("row.doc_id", "row.text", "shard", "slot").collect()
    assert sorted((str(r[0]), str(r[1])) for r in again) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert {r["shard"] for r in again} == set(range(5))


def test_resharding_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    old, new = sharding.balanced_shards(docs)
    assert sharding.read_layout(spark, new).count() == 0 and not new.parts
