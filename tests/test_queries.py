"""Every query with a DuckDB twin against that twin, over whole tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rankweave.plans.registry import ORACLES, QUERIES
from tests.conftest import SF, TABLES


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, float) else str(x) if hasattr(x, "year") else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(v[k]) for k in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_page_rank_sums_to_one(spark):
    total = QUERIES["MTH6"](spark, SF).groupBy().sum("rank").first()[0]
    assert abs(total - 1) < 1e-6


@pytest.mark.parametrize("mode, form", [("append", "emit_once"), ("complete", "daily_counters")])
def test_streams_are_drained_to_shared_files(spark, tmp_path, mode, form):
    """Batch by batch, and no row stays in the driver."""
    from rankweave.streaming import counters

    events = spark.read.parquet(f"{SF}/events.parquet").limit(2000)
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    whole = spark.read.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = counters.drained(getattr(counters, form)(stream, "400 days"), mode)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:").strip("/")
    assert out.inputFiles() and all(folder in f for f in out.inputFiles())
    want = whole.selectExpr("user_id", "event_type", "to_date(ts) AS day").distinct().count() if mode == "append" else whole.count()
    assert (out.count() if mode == "append" else out.groupBy().sum("hits").first()[0]) == want


def test_pairs_count_members_of_many_entities(spark, duck):
    """JOIN16 over all members, without the bound on a member's entities that its twin has."""
    got = QUERIES["JOIN16"](spark, SF)
    want = duck.sql("""WITH r AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS m FROM lineitem), n AS (SELECT e, count(*) AS n FROM r GROUP BY e),
        b AS (SELECT x.e AS a, y.e AS b, count(*) AS shared FROM r x JOIN r y ON x.m = y.m AND x.e < y.e GROUP BY 1, 2), j AS (SELECT a, b, shared, shared::DOUBLE / (p.n + q.n - shared) AS jaccard FROM b JOIN n p ON a = p.e JOIN n q ON b.b = q.e)
        SELECT * FROM j WHERE jaccard >= 0.14""")  # fmt: skip
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == 3752 and a == b


def test_pairs_of_sets_with_one_hot_member(spark):
    from rankweave.operators import matching

    sets = {e: {0} | {(e * 7 + k * k) % 23 + 1 for k in range(e % 5)} | ({None} if e % 9 == 0 else set()) for e in range(90)}
    for percent in (14, 50, 100):
        got = matching.shared_members(spark.createDataFrame([(e, m) for e, x in sets.items() for m in x], "e long, m long"), "e", "m", percent)
        shared = {(a, b): len((x & y) - {None}) for a, x in sets.items() for b, y in sets.items() if a < b}
        assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == {(a, b): n for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}


def test_pairs_of_sets_are_not_shuffled(spark):
    """JOIN16: nothing is written for a pair of sets; members that are texts, and sets of many blocks."""
    from rankweave.operators import matching

    sets = {e: {f"m{(e * 31 + k * k * (e % 7 + 1)) % 400}" for k in range(40 + e % 30)} for e in range(1300)}
    members = spark.createDataFrame([(e, m) for e, x in sets.items() for m in x], "e long, m string")
    found = matching.shared_members(members, "e", "m", 40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    held: dict = {}
    for e, x in sets.items():
        for m in x:
            held.setdefault(m, []).append(e)
    from collections import Counter

    shared = Counter((a, b) for x in held.values() for i, a in enumerate(sorted(x)) for b in sorted(x)[i + 1 :])
    want = {p: n for p, n in shared.items() if 100 * n >= 40 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    assert want and {(r["a"], r["b"]): r["shared"] for r in found.collect()} == want
