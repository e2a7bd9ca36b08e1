"""Vector codes against the plain definition, and the odd cases of the docstring."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from rankweave.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id long, error string, code string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", "x") for r in rows], SCHEMA).repartition(parts)


def plain(rows, parts, entries, rounds):
    """vec_id, code, error, label_error of each row, and the digest, by the definition alone."""
    good = [(i, [max(-(2**24), min(2**24, math.floor(256 * float(np.float32(x))))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return [], hashlib.sha256(b"").hexdigest()
    length = len(good[0][1])
    edges = [k * length // parts for k in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    fit = [r for r in good if len(r[1]) == length]
    books = [[cut(v)[p] for _, v, _ in good[:entries] if len(v) == length] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    place = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            owned: dict[int, list] = {}
            for _, v, _ in fit:
                owned.setdefault(place(cut(v)[p], books[p]), []).append(cut(v)[p])
            for e, xs in owned.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], Counter()
    for i, v, lab in good:
        if len(v) != length:
            out.append((i, None, None, lab))
            continue
        chosen = [place(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(far(x, books[p][e]) for (p, x), e in zip(enumerate(cut(v)), chosen, strict=True))
        by_label[lab] += error
        out.append((i, "".join(f"{e:02x}" for e in chosen), error, lab))
    coded = {lab for _, c, _, lab in out if c is not None}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), str(c), str(e), str(by_label[lab] if lab in coded else None)) for i, c, e, lab in out), digest


def check(spark, rows, parts=4, entries=8, rounds=2):
    codes, books = vector_codes.compress(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    got = sorted((str(r["id"]), str(r["code"]), str(r["error"]), str(r["label_error"])) for r in codes.collect())
    want, digest = plain(rows, parts, entries, rounds)
    assert got == want
    assert books.sha256() == digest


@pytest.mark.parametrize("seed", range(3))
def test_codes_match_the_definition(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 0, 1])) for i in range(900)]
    check(spark, rows, entries=rng.choice([5, 16, 64]))


def test_ties_and_coarse_values(spark):
    """Points on few lattice places: many equal distances."""
    rng = random.Random(4)
    check(spark, [(i, [rng.randint(-2, 2) / 256 for _ in range(8)], i % 3) for i in range(400)], entries=10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 0.25, 1.0], 1), (1, [0.5, -0.5, 0.25, 1.0], 1), (None, [1.0, 2.0, 3.0, 4.0], None), (3, None, 1), (4, [1.0, None, 1.0, 1.0], 1), (5, [1.0, nan, 1.0, 1.0], 2)]
    rows += [(6, [1.0, inf, 1.0, -inf], 2), (7, [1.0, 2.0], 7), (8, [], 8), (9, [3e30, -3e30, 0.0, 0.0], None), (10, [0.1, 0.2, 0.3, 0.4], None)]
    check(spark, rows, entries=4)
    check(spark, [(i, v, lab) for i, v, lab in rows if v != []], parts=3, entries=2)
    check(spark, [(8, [], 8), (9, [], None)])
    check(spark, [])
    check(spark, [(3, None, 1)])


def test_many_equal_vectors_and_one_label(spark):
    rng = random.Random(9)
    rows = [(i, [0.25] * 8 if i % 3 else [rng.random() for _ in range(8)], 5) for i in range(3000)]
    check(spark, rows, entries=16)


def test_labels_of_few_rows_are_joined_by_a_shuffle(spark):
    check(spark, [(i, [i / 300, 0.0, 1.0, i % 7 / 4], i // 2 if i > 400 else 0) for i in range(900)])


def test_hilbert_order_keeps_neighbours_near():
    grid = np.array([[x, y] for x in range(16) for y in range(16)])
    walk = grid[vector_codes.hilbert_order(grid)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_settle_most_blocks():
    """Shortlists hold every nearest entry, and most entries are ruled out by boxes alone."""
    rng = np.random.default_rng(1)
    points, book = rng.integers(-200, 200, (16384, 4)), rng.integers(-200, 200, (64, 4))
    _, flat, low, high, sums = vector_codes.flat_blocks(points.astype(np.int32))
    listed = vector_codes.shortlists(low, high, book)
    best = ((flat[:, None].astype(np.int64) - book) ** 2).sum(axis=2).argmin(axis=1)
    assert listed[np.arange(len(flat)) // vector_codes.BLOCK, best].all()
    assert listed.mean() < 0.25
    assert (vector_codes.assign_blocks(flat, low, high, book)[1] == best).all()
    assert (sums.sum(axis=0) == points.sum(axis=0)).all()


def test_decoded_vectors_have_the_stated_error(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-300, 300) / 256 for _ in range(8)], 0) for i in range(200)]
    codes, books = vector_codes.compress(frame(spark, rows), parts=4, entries=16)
    vectors = {i: v for i, v, _ in rows}
    for r in vector_codes.decoded(codes, books).collect():
        assert round(sum(((x - y) * 256) ** 2 for x, y in zip(r["vector"], vectors[r["id"]], strict=True))) == r["error"]
