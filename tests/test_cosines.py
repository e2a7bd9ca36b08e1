"""Cosine pairs against all pairs, in blocks of many sizes."""

from __future__ import annotations

import math
import random

import pytest

from rankweave.operators import cosines


def plain(rows, least):
    texts: dict = {}
    for i, term, n in rows:
        if i is not None and term is not None:
            texts.setdefault(i, {})[term] = n
    norm = {i: math.sqrt(sum(n * n for n in t.values())) for i, t in texts.items()}
    out = {}
    for a in texts:
        for b in texts:
            if a < b:
                dot = sum(n * texts[b].get(t, 0) for t, n in texts[a].items()) / norm[a] / norm[b]
                if dot >= least - 1e-9:
                    out[a, b] = round(dot, 5)
    return out


def check(spark, rows, least, block):
    found = cosines.cosine_pairs(spark.createDataFrame(rows, "id string, term string, n long"), least, block).collect()
    assert len({(r["a"], r["b"]) for r in found}) == len(found)
    assert {(r["a"], r["b"]): round(r["cosine"], 5) for r in found} == pytest.approx(plain(rows, least), abs=2e-5)


@pytest.mark.parametrize("least,block", [(0.9, 7), (0.55, 512), (0.3, 40), (0.999999, 3)])
def test_pairs_match_brute_force(spark, least, block):
    rng = random.Random(block)
    rows = []
    for i in range(160):
        words = rng.choices([f"t{k}" for k in range(90)], [1 / (1 + k) for k in range(90)], k=rng.randint(1, 60))
        rows += [(f"d{i}", w, words.count(w)) for w in sorted(set(words))]
    check(spark, rows, least, block)


def test_equal_texts_and_terms_of_one_text(spark):
    rows = [(f"d{i}", t, n) for i in range(60) for t, n in (("x", 2), ("y", 1), (f"own{i % 20}", 1))]
    check(spark, rows, 0.9, 8)


def test_odd_rows(spark):
    assert cosines.cosine_pairs(spark.createDataFrame([], "id long, term string, n long"), 0.5).collect() == []
    rows = [("a", "x", 1), (None, "x", 1), ("b", None, 1), ("b", "x", 3), ("c", "only", 5)]
    check(spark, rows, 0.5, 2)


def test_nothing_is_shuffled_for_pairs_of_blocks(spark):
    rows = [(f"d{i}", f"t{(i * k) % 17}", k) for i in range(50) for k in range(1, 6)]
    plan = cosines.cosine_pairs(spark.createDataFrame(rows, "id string, term string, n long"), 0.9, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_texts_of_several_rows_and_fractions_as_counts(spark):
    texts = [("a", ["x", "y", "x"]), ("b", ["x"]), ("b", ["y", "x"]), ("c", ["y", "z", "z"]), (None, ["x"]), ("d", None), ("e", ["x"])]
    got = cosines.text_cosines(spark.createDataFrame(texts, "id string, tokens array<string>"), 0.9, 2).collect()
    assert [tuple(r) for r in got] == [("a", "b", 1.0)]
    rows = [("a", "x", 0.5), ("a", "y", 1.25), ("b", "x", 1.0), ("b", "y", 2.5), ("c", "y", 3.0)]
    got = cosines.cosine_pairs(spark.createDataFrame(rows, "id string, term string, n double"), 0.9).collect()
    assert {(r["a"], r["b"]): r["cosine"] for r in got} == {("a", "b"): 1.0, ("a", "c"): 0.928477, ("b", "c"): 0.928477}
