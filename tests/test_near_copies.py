"""Near copies against all pairs, and what they keep."""

from __future__ import annotations

import random
import re

import pytest

from rankweave.operators import overlap


def plain(texts, percent, width):
    sets = {}
    for i, text in texts.items():
        words = re.findall("[a-z0-9]+", (text or "").lower())
        sets[i] = frozenset(" ".join(words[k : k + width]) for k in range(len(words) - width + 1))
    reps: dict = {}
    for i in sorted(sets):
        if sets[i]:
            reps.setdefault(sets[i], i)
    links = {r: {s for s in reps.values() if s != r and 100 * len(sets[r] & sets[s]) >= percent * len(sets[r] | sets[s])} for r in reps.values()}
    low = {r: r for r in links}
    for _ in low:
        low = {r: min([low[r], *(low[s] for s in links[r])]) for r in low}
    return {i: (low[reps[s]], len(links[reps[s]])) if s else (i, 0) for i, s in sets.items()}


def texts_of(seed):
    rng = random.Random(seed)
    texts: dict = {0: None, 1: "", 2: "one two", 3: "é ü 1 a b c d", 4: "x-1.a b;C d"}
    for i in range(5, 160):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([5, 6, 40, 90, 200]))]
        if i % 3 and i > 8:
            words = (texts[rng.randint(5, i - 1)] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 9])):
                words[rng.randrange(len(words))] = rng.choice(["Ä", "new", f"w{i}"])
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize("percent, width, block", [(85, 5, 256), (85, 5, 7), (60, 2, 3), (100, 1, 16)])
def test_near_copies_match_all_pairs(spark, monkeypatch, percent, width, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    texts = texts_of(percent + width)
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    got = {r["id"]: (r["class_id"], r["links"]) for r in overlap.near_copies(docs, "id", "text", percent, width).collect()}
    assert got == plain(texts, percent, width)


def test_common_shingle_meets_over_batches(spark):
    """A shingle of all texts, in rows of many batches; texts that are near by other shingles are still found."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        texts = {i: f"a b c d e f g h p{i // 2} q{i // 2} r{i // 2} s{i // 2} t{i // 2} " + "z" * (i % 2) for i in range(60)}
        docs = spark.createDataFrame(list(texts.items()), "id long, text string")
        got = {r["id"]: (r["class_id"], r["links"]) for r in overlap.near_copies(docs, "id", "text", 80, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(texts, 80, 3)


@pytest.mark.parametrize("text", ["text", "html"])
def test_sets_without_a_near_copy_are_not_kept(spark, monkeypatch, text):
    """JOIN18 and AUD6 write no set of shingles but of texts that may be near copies."""
    from rankweave.operators import graph

    frames, real = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: frames.append(real(df)) or frames[-1])
    rows = [(i, " ".join(f"{'p' if text == 'html' else 'd'}{i}w{k}" for k in range(50))) for i in range(40)] + [(40, "a b c d e f g h"), (41, "a b c d e f g h i")]
    overlap.near_copies(spark.createDataFrame(rows, f"id long, {text} string"), "id", text).collect()
    held = [r for f in frames for r in f.collect() if {"s", "sets"} & set(f.columns)]
    assert sum(len(r["sets"]) // 8 if "sets" in r else len(r["s"] or ()) for r in held) <= 9
