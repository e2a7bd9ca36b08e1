"""Search phrases and mentions, written from the given parts and conversations, and their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.sources.tables import table

_BEFORE = ["buy", "best", "how to use", "", "cheap", "compare", "login", "price of", "reviews of", "what is", ""]
_AFTER = ["", "in austin", "", "london", "", "new york", "near me", "in bulk", "reading"]
#: What people say, with the sentiment's score and the risk expected of each.
SAID = [
    ("Very friendly staff", 0.75, None), ("It was not perfect at all", -0.5, None), ("Absolutely terrible and broken", -0.88, None), ("This is a scam", -0.5, "fraud_claim"),
    ("They have shut down", 0.0, "closure"), ("Solid and valuable", 0.71, None), ("Never a problem", 0.0, None), ("We were there", 0.0, None),
]
_TRAILS = [" see www.shop.example/item", " on the widget forum", " about widgets", "", " in town"]


def _pick(values: list[str], at: str) -> str:
    return "element_at(array(" + ", ".join(f"'{v}'" for v in values) + f"), cast({at} % {len(values)} + 1 as int))"


def _duck_pick(values: list, at: str) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + f"][{at} % {len(values)} + 1]"


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, impressions, clicks and page of each distinct search phrase."""
    phrase = f"trim(concat({_pick(_BEFORE, 'p_partkey')}, ' ', lower(p_name), ' ', {_pick(_AFTER, 'p_partkey')}))"
    rows = table(spark, sf_dir, "part").selectExpr(f"{phrase} AS keyword", "10 + p_partkey * 37 % 500 AS impressions", "p_partkey % 13 AS clicks", "p_size AS page")
    return rows.groupBy("keyword").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.min("page").alias("page"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, day and said: what people say of a shop."""
    k = "(conv_id * 7 + turn)"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "date_add(DATE '2024-01-01', cast(conv_id % 30 as int)) AS day", f"concat({_pick([s for s, *_ in SAID], k)}, {_pick(_TRAILS, k)}) AS said")


KEYWORDS = f"""keywords AS (SELECT trim({_duck_pick(_BEFORE, 'p_partkey')} || ' ' || lower(p_name) || ' ' || {_duck_pick(_AFTER, 'p_partkey')}) AS keyword, CAST(sum(10 + p_partkey * 37 % 500) AS BIGINT) AS impressions,
    CAST(sum(p_partkey % 13) AS BIGINT) AS clicks, min(p_size) AS page FROM part GROUP BY 1)"""
MENTIONS = f"""mentions AS (SELECT conv_id, turn, DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS day, conv_id * 7 + turn AS k, {_duck_pick([s for _, s, _ in SAID], '(conv_id * 7 + turn)')} AS score,
    {_duck_pick([r for *_, r in SAID], '(conv_id * 7 + turn)')} AS risk FROM conversations)"""
