"""Score queries. Loaded by the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from rankweave.operators import content, scores
from rankweave.sources.tables import table


def _checks(spark, sf_dir):
    """One row a check over all pages: weight by tier, failed and total pages."""
    records = content.page_record(table(spark, sf_dir, "pages"))
    tiers = {"warning": 2, "notice": 1}
    return records.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(tiers[t]).alias("weight"), F.expr(w).cast("int").alias("failed")) for n, w, t in content.AUDITS.values()))).alias("c")).groupBy("c.check", "c.weight").agg(
        F.sum("c.failed").alias("failed"), F.count("*").alias("total")
    )


def _status():
    """A check's status from an event."""
    return F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "unknown").when(F.col("value") > 100, "warn").otherwise("good")


def register(add: Callable, over: Callable, given: Callable, pages_sql: str) -> None:
    """Adds this module's queries."""
    tiers = {"warning": 2, "notice": 1}
    union = " UNION ALL ".join(f"SELECT '{n}' AS check_name, {tiers[t]} AS weight, count(CASE WHEN {w} THEN 1 END) AS failed, count(*) AS total FROM r" for n, w, t in content.AUDITS.values())
    add("AGG38", lambda s, d: scores.weighted_pass_score(_checks(s, d).withColumn("site", F.lit("all")), ["site"]),
        f"WITH {pages_sql}, k AS ({union}) SELECT 'all' AS site, round(100 * sum(weight * (1 - sqrt(least(1.0, failed::DOUBLE / total)))) / sum(weight), 4) AS score, count(*) AS checks FROM k")
    status_sql = "CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' THEN 'unknown' WHEN value > 100 THEN 'warn' ELSE 'good' END"
    add("AGG39", given("events", lambda e: scores.board_score(e.select("user_id", _status().alias("status")), ["user_id"])),
        f"""WITH s AS (SELECT user_id, {status_sql} AS status FROM events), g AS (SELECT user_id, count(CASE WHEN status <> 'unknown' THEN 1 END) AS measured, count(CASE WHEN status = 'good' THEN 1 END) AS good,
        min(CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'good' THEN 2 ELSE 3 END) AS w FROM s GROUP BY user_id)
        SELECT user_id, measured, good, CASE WHEN measured > 0 THEN good::DOUBLE / measured END AS score, ['fail', 'warn', 'good', 'unknown'][w + 1] AS worst FROM g""")  # fmt: skip
    add("TOP9", given("lineitem", lambda x: x.select("l_orderkey", "l_linenumber", scores.priority(F.col("l_linenumber").cast("double"), F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low"), F.col("l_quantity"), F.lit(64.0)).alias("priority"))),
        "SELECT l_orderkey, l_linenumber, CAST(floor(l_linenumber * 20 * CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.62::DOUBLE ELSE 0.3::DOUBLE END * (0.35::DOUBLE + 0.65::DOUBLE * sqrt(least(1.0::DOUBLE, l_quantity / 64))) + 0.5::DOUBLE) AS BIGINT) AS priority FROM lineitem")
    add("MTH9", given("events", lambda e: e.select("event_id", scores.band(F.col("value"), 20.0, 100.0).alias("band"))), "SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value <= 20 THEN 'good' WHEN value <= 100 THEN 'average' ELSE 'poor' END AS band FROM events")
