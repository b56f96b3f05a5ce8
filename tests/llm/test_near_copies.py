"""Near copies against the Jaccard similarity of all pairs."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from demandgrid.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest int, _first int"


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def brute_rows(rows):
    """(doc_id, digest) of the rows that stay for their groups, and the groups' sizes."""
    rows = [r for r in rows if r[1] and r[1].encode().split()]
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, r in enumerate(rows):
        digest = hashlib.sha1(r[1].encode()).hexdigest()
        groups.setdefault(root(i), []).append((r[0] is None, r[0] or 0, r[0], digest))
    return sorted(((*min(g, key=lambda k: (k[:2], k[3]))[2:], len(g)) for g in groups.values()), key=str)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return out


def family_rows():
    rng = random.Random(5)
    rows = []
    for k in range(6):  # an original that is not the first, its copies, copies of copies
        words = [f"w{rng.randrange(400)}" for _ in range(240)]
        copies = [edited(rng, words, n) for n in (4, 3, 5, 0, 2, 4, 1)]
        copies += [edited(rng, copies[0], 4), edited(rng, words, 60), edited(rng, words, 25)]
        rows += [(100 * k + i, " ".join(c)) for i, c in enumerate(copies)]
    rows += [(900 + i, " ".join(f"o{rng.randrange(3000)}" for _ in range(150))) for i in range(80)]
    base = rows[3][1]
    rows += [
        (2000, base), (2000, base), (3, "another text under an id that is taken, of more than five words"),
        (None, base), (None, base.upper()), (None, rows[70][1] + " more"), (None, None), (2001, ""), (2002, " \n"),
        (2003, "two words"), (2004, "Two  words\n"), (2005, "x"), (2006, "same few " * 5000), (2007, "same few " * 4000),
        (None, "only null ids hold this text of more than a few words"),
        (None, "only null ids hold this text of more than a few words"),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return family_rows()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2) for i, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("block, forests", [(8192, 2), (4, 2), (4, 0)])
def test_groups_are_those_of_all_pairs(spark, rows, block, forests, monkeypatch):
    monkeypatch.setattr(near_copies, "FORESTS", forests)  # without any the last round does all
    monkeypatch.setattr(near_copies, "BLOCK", block)  # components of several blocks
    monkeypatch.setattr(near_copies, "HASHES", 128 * block)
    got = sorted(
        ((r["doc_id"], r["digest"], r["members"]) for r in near_copies.near_copies(docs_of(spark, rows)).collect()),
        key=str,
    )
    assert got == brute_rows(rows)


def test_candidates_below_the_similarity_do_not_join(spark, monkeypatch):
    """Bits propose texts at 0.7 as well; a family is joined through its original whatever links a forest held."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    copies = [" ".join(edited(rng, words, 5)) for _ in range(40)]  # 0.85 to the original, 0.72 to each other
    sets = [shingles(c) for c in copies]
    assert sum(similar(a, b) for a in sets for b in sets) < 60
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "HASHES", 1500)
    alone = list(enumerate(copies))
    got = near_copies.near_copies(docs_of(spark, alone)).collect()
    assert sorted(((r["doc_id"], r["digest"], r["members"]) for r in got), key=str) == brute_rows(alone)
    whole = [*alone, (500, " ".join(words))]
    got = near_copies.near_copies(docs_of(spark, whole)).collect()
    assert [(r["doc_id"], r["members"]) for r in got] == [(0, 41)] == [(r[0], r[2]) for r in brute_rows(whole)]


def test_near_pairs_are_proposed(spark):
    """Pairs just above the threshold: at least 0.99 of them are found."""
    rng = random.Random(13)
    rows, pairs = [], 0
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(200, 500))]
        start = rng.randrange(20)
        gone = len(words) // 10  # a stretch is replaced: similarity just above 0.8
        other = words[:start] + [f"n{rng.randrange(10**6)}" for _ in range(gone - 1)] + words[start + gone - 1 :]
        assert similar(shingles(" ".join(words)), shingles(" ".join(other))) == similar(
            shingles(" ".join(other)), shingles(" ".join(words)))
        pairs += similar(shingles(" ".join(words)), shingles(" ".join(other)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = near_copies.near_copies(docs_of(spark, rows)).where("members = 2").count()
    assert pairs >= 300
    assert 0.985 * pairs <= found <= pairs


def test_stage_keeps_one_row_of_a_group_and_all_wordless_rows(spark, rows):
    docs = docs_of(spark, rows)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "unused")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], hashlib.sha1(r["text"].encode()).hexdigest()) for r in out.collect() if (r["text"] or "").strip()), key=str)
    assert got == sorted([r[:2] for r in brute_rows(rows)], key=str)
    assert out.where("text is null or trim(BOTH ' \n' FROM text) = ''").count() == 3
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "unused").count() == 0


def test_close_pairs_join_as_all_pairs_do():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (5, near_copies.WORDS), dtype=np.uint64)
    wide = base[rng.integers(0, 5, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, near_copies.WORDS), dtype=np.uint64))
    label, block = rng.integers(0, 40, 300), rng.integers(0, 2, 300)
    order = rng.permutation(300).astype(np.uint64)
    pairs = {frozenset(p) for i, j in near_copies.close_pairs(wide, label, block, True, False, order) for p in zip(i, j)}
    far = [(a, b) for a in range(300) for b in range(a)
           if int(np.bitwise_count(wide[a] ^ wide[b]).sum()) <= near_copies.TOTAL_BITS and block[a] != block[b]]
    top = np.bincount(label).argmax()
    assert pairs == {frozenset(p) for p in far if label[p[0]] != label[p[1]]}
    assert any(label[a] == top for p in pairs for a in p)
    forest = [p for i, j in near_copies.close_pairs(wide, label, block, True, True, order) for p in zip(i, j)]
    assert len(forest) < 40


def test_probes_are_shuffled_once(spark, capsys):
    """Only to their groups, not to find out which keys are hot."""
    rows = [tuple(1 << (i * k + i) % 63 for k in range(near_copies.WORDS)) for i in range(20)]
    prints = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in near_copies._NAMES))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        simhash.near_pairs(prints, "simhash", near_copies.MAX_BITS, near_copies.WORDS, near_copies.TOTAL_BITS).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
