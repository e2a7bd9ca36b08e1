"""The signature-tree join against brute force, its bounds, and the odd cases of the docstring."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rankweave.llm import near_dup, queries, signature_tree
from tests.conftest import SF
from tests.llm.test_operators import ODD, brute_components, by_id, documents, frame  # noqa: F401


def check(spark, rows, width=3, percent=90, **nodes):
    got = signature_tree.similar_documents(frame(spark, rows).repartition(3), width, percent, **nodes).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute_components(rows, width, percent).items()}
    return got


def variants(rng, count, size, edits, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_query_matches_brute_force(spark, documents):  # noqa: F811
    got = by_id(queries.op12_signature_tree(spark, SF).collect())
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(documents, 3, 90)


@pytest.mark.parametrize("size,edits", [(10, 1), (24, 1), (60, 4), (300, 14), (900, 30)])
def test_variants_near_the_bound(spark, size, edits):
    """Pairs on both sides of the bound, of sizes at borders of ranges."""
    rng = random.Random(size)
    texts = [t for _ in range(12) for t in variants(rng, 14, rng.randint(size - size // 4, size + size // 4), edits)]
    check(spark, [(i, t, None, None) for i, t in enumerate(texts)])


def test_texts_cut_short(spark):
    """Sizes differ as far as they may: a range's smallest sets and the next one's."""
    rng = random.Random(8)
    rows = []
    for size in range(8, 60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows += [" ".join(words[: size - k]) for k in range(0, 1 + size // 8)]
    check(spark, [(i, t, None, None) for i, t in enumerate(rows)])


def test_large_group_is_traversed(spark):
    """Hundreds of variants that share keys, most of them not linked with their neighbours in the tree: small nodes
    make many levels' pairs."""
    rng = random.Random(5)
    texts = variants(rng, 400, 120, 7) + variants(rng, 100, 130, 9)
    rng.shuffle(texts)
    check(spark, [(i, t, None, None) for i, t in enumerate(texts)], leaf=3, fan=2)


@pytest.mark.parametrize("width,percent", [(1, 80), (2, 60), (5, 95), (3, 100)])
def test_other_bounds(spark, width, percent):
    rng = random.Random(percent)
    texts = [t for _ in range(10) for t in variants(rng, 12, rng.randint(6, 80), 5, 60)]
    check(spark, [(i, t, None, None) for i, t in enumerate(texts)], width, percent)


def test_odd_cases(spark):
    got = check(spark, ODD)
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (1, 2, 3))
    assert signature_tree.similar_documents(frame(spark, [])).collect() == []
    nameless = [(None, "a b c d e f g h i j k", None, None), (5, "a b c d e f g h i j k", None, None), (None, None, None, None)]
    out = signature_tree.similar_documents(frame(spark, nameless)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_an_id_with_two_texts_links_both(spark):
    rng = random.Random(1)
    a, b = variants(rng, 2, 200, 2), variants(rng, 2, 200, 2)
    got = signature_tree.similar_documents(frame(spark, [(1, a[0], None, None), (2, a[1], None, None), (2, b[0], None, None), (3, b[1], None, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_keys_are_shared_by_every_linked_pair():
    rng = np.random.default_rng(2)
    for percent in (60, 80, 90, 95):
        for _ in range(150):
            n = int(rng.integers(2, 300))
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, signature_tree.apart(n, n, percent) + 1))
            y = np.unique(np.concatenate([x[drop // 2 :], rng.integers(0, 2**63, drop - drop // 2, dtype=np.uint64)]))
            if signature_tree.linked(x, y, percent) and len(x) + len(y) - 2 * len(np.intersect1d(x, y)):
                assert set(signature_tree.keys(x, percent).tolist()) & set(signature_tree.keys(y, percent).tolist())


def test_bounds_hold_for_nodes_of_different_widths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        nodes = []
        for size in (int(rng.integers(20, 200)), int(rng.integers(20, 200))):
            wide = signature_tree.width_of(size)
            sets = [np.unique(rng.choice(pool, size)) for _ in range(5)]
            bits = np.stack([signature_tree.bitmap(s, wide) for s in sets])
            surplus = np.array([len(s) for s in sets]) - np.bitwise_count(bits).sum(axis=1)
            nodes.append((sets, bits, surplus))
        (xs, bx, sx), (ys, by, sy) = nodes
        exact = np.array([[len(np.intersect1d(x, y)) for y in ys] for x in xs])
        assert (signature_tree.overlap_bound(bx, sx, by, sy) >= exact).all()
        na, nb = (np.array([len(s) for s in sets]) for sets in (xs, ys))
        odd = [np.stack([signature_tree.parities(s, b.shape[1] * 64) for s in sets]) for sets, b in ((xs, bx), (ys, by))]
        for percent in (50, 90):
            reach = 100 * exact >= percent * (na[:, None] + nb[None, :] - exact)
            assert signature_tree.may_link(odd[0], na, odd[1], nb, percent)[reach].all()
        either = lambda b: np.bitwise_or.reduce(b)[None]
        assert signature_tree.overlap_bound(either(bx), sx.max(keepdims=True), either(by), sy.max(keepdims=True))[0, 0] >= exact.max()


def test_names_agree_with_near_duplicates(spark, documents):  # noqa: F811
    """Both similarity joins find the same classes at the same width and bound."""
    rows = [r for r in documents if r[0] < 400]
    docs = frame(spark, rows)
    one = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 4, 80).collect()}
    assert {r["doc_id"]: r["component_id"] for r in signature_tree.similar_documents(docs, 4, 80).collect()} == one
