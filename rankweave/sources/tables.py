"""The given tables and the canonical views that the analytics operators run on. Each view states its columns;
the DuckDB twin of each is in VIEWS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(value: str = "value"):
    return F.round(F.col(value) * 100).cast("long")


def metric_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, date, entity, clicks, impressions, pos (position summed with impressions as weights)."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("brand"), F.to_date("ts").alias("date"), F.col("user_id").alias("entity")).agg(
        F.count("*").alias("clicks"), F.sum(_cents()).alias("impressions"), F.sum(_cents() * (F.col("event_id") % 120 + 1)).alias("pos")
    )


def long_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, date, entity, clicks, impressions over several years."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("brand"), F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("entity")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("clicks"), F.sum(F.round(F.col("l_extendedprice")).cast("long")).alias("impressions")
    )


def query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, page, clicks, impressions, position of each search result row."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("page"), F.col("l_linenumber").cast("long").alias("clicks"), F.col("l_quantity").cast("long").alias("impressions"),
        F.round(F.col("l_discount") * 100 + 1).cast("long").alias("position"),
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lead_id, status, channel, value (cents), day of each lead."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("lead_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("channel"), _cents("o_totalprice").alias("value"), F.to_date("o_orderdate").alias("day"),
        F.col("o_custkey").alias("person"),
    )


def rank_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, captured_on, position (null beyond 100), one row a keyword and day."""
    spot = F.col("event_id") % 120 + 1
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("keyword"), F.to_date("ts").alias("captured_on")).agg(F.min(F.when(spot <= 100, spot)).alias("position"))


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seen, id, status, value (cents) of each measurement."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("seen"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), _cents().alias("value"))


def visits_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, date, entity, sessions, engaged, conversions, seconds of each landing page and day."""
    value = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("brand"), F.to_date("ts").alias("date"), F.col("user_id").alias("entity")).agg(
        F.count("*").alias("sessions"), F.count_if(value > 10).alias("engaged"), F.count_if(value > 50).alias("conversions"), F.sum(F.round(value).cast("long")).alias("seconds")
    )


#: The same views as DuckDB SQL, for the independent twins.
VIEWS = {
    "metric": """SELECT event_type AS brand, CAST(ts AS DATE) AS date, user_id AS entity, count(*) AS clicks,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS impressions,
        CAST(sum(CAST(round(value * 100) AS BIGINT) * (event_id % 120 + 1)) AS BIGINT) AS pos FROM events GROUP BY 1, 2, 3""",
    "long_daily": """SELECT l_returnflag AS brand, CAST(l_shipdate AS DATE) AS date, l_suppkey AS entity,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS impressions
        FROM lineitem GROUP BY 1, 2, 3""",
    "query_page": """SELECT l_partkey AS query, l_suppkey AS page, CAST(l_linenumber AS BIGINT) AS clicks, CAST(l_quantity AS BIGINT) AS impressions,
        CAST(round(l_discount * 100 + 1) AS BIGINT) AS position FROM lineitem""",
    "leads": """SELECT o_orderkey AS lead_id, o_orderstatus AS status, o_orderpriority AS channel, CAST(round(o_totalprice * 100) AS BIGINT) AS value,
        CAST(o_orderdate AS DATE) AS day, o_custkey AS person FROM orders""",
    "ranks": """SELECT user_id AS keyword, CAST(ts AS DATE) AS captured_on, min(CASE WHEN event_id % 120 + 1 <= 100 THEN event_id % 120 + 1 END) AS position
        FROM events GROUP BY 1, 2""",
    "visits": """SELECT event_type AS brand, CAST(ts AS DATE) AS date, user_id AS entity, count(*) AS sessions, count(CASE WHEN value > 10 THEN 1 END) AS engaged,
        count(CASE WHEN value > 50 THEN 1 END) AS conversions, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS seconds FROM events GROUP BY 1, 2, 3""",
    "series": "SELECT user_id AS key, ts AS seen, event_id AS id, event_type AS status, CAST(round(value * 100) AS BIGINT) AS value FROM events",
}


def twin(body: str, *views: str) -> str:
    """DuckDB SQL of a query over canonical views."""
    body = body.strip()
    if not views:
        return body
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {head}, {body[5:].strip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
