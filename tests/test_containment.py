"""Containment of texts against plain loops, and JOIN25 over names that no equal head settles."""

from __future__ import annotations

import random

import duckdb
import pytest

from rankweave.operators import matching
from rankweave.plans.registry import ORACLES, QUERIES
from tests.conftest import SF

#: JOIN25's SQL before its heads became all names (only some names were heads), and after (every name is equal to one).
_FORMER = """WITH n AS (SELECT DISTINCT lower(p_name) AS h FROM part), h AS (SELECT h FROM n WHERE {} UNION ALL SELECT h || ' set' FROM n), m AS (SELECT p_partkey, h, CASE WHEN h = lower(p_name) THEN 100 WHEN contains(h, lower(p_name)) THEN 80
    WHEN contains(lower(p_name), h) THEN 60 END AS score FROM part, h) SELECT p_partkey, h AS head, score FROM m WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, h DESC) = 1"""


def _odd_names():
    rng = random.Random(25)
    long = "".join(rng.choice("ab ") for _ in range(300))
    some = ["Cold Ring", "old ring", "old", "Ring", "", " ", "a", "A set", "set", "café au lait", "é", "日本語", "本", "x" * 64, "x" * 65, "x" * 130, long, long[100:171], long[250:], "re.d*", "blue  widget", None]
    return some + ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))) for _ in range(150)]


def test_contained_texts_match_plain_loops(spark):
    texts = sorted({x.lower() for x in _odd_names() if x is not None})
    needles, hays = texts, texts[::2]
    frame = lambda t: spark.createDataFrame([(x,) for x in t], "t string")
    got = [tuple(r) for r in matching.contained(frame(needles), frame(hays)).select("needle", "hay").collect()]
    want = {(x, y) for x in needles for y in hays if x in y and x != y}
    assert len(got) == len(want) > 500 and set(got) == want


@pytest.mark.parametrize("given", [True, False])
def test_best_heads_of_all_scores(spark, tmp_path, given):
    """The rows of both former SQL forms are there, and those of lower scores behind them."""
    where = SF
    if not given:
        where = str(tmp_path)
        keyed = [(k if k % 40 else 7, x) for k, x in enumerate(_odd_names() * 2)]
        spark.createDataFrame(keyed, "p_partkey long, p_name string").write.parquet(f"{where}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{where}/part.parquet{'' if given else '/*.parquet'}'")
    found = QUERIES["JOIN25"](spark, where)
    assert {r["score"] for r in found.select("score").distinct().collect()} == {100, 80, 60}
    out = [tuple(r) for r in found.select("p_partkey", "head", "score", "place").collect()]
    assert sorted(out) == sorted(con.sql(f"SELECT p_partkey, head, score, place FROM ({ORACLES['JOIN25']})").fetchall())
    assert {r[:3] for r in out if r[3] == 1} == set(con.sql(_FORMER.format("true")).fetchall())
    # Key 7 of the odd names has several names, which compete.
    assert {r[:3] for r in out} >= {r for r in con.sql(_FORMER.format("h LIKE '%e%'")).fetchall() if given or r[0] != 7}
