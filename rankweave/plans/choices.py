"""Queries whose rows come from greedy choices: phrase clusters and recommended links. SQL can't state them; tests
hold them against a plain pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import cosines, language, selection
from rankweave.operators.graph import checkpointed
from rankweave.plans.texts import _STOP
from rankweave.sources import phrases


def phrase_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, weight, clicks, page, tokens and place of each search phrase with a token."""
    k = phrases.keywords(spark, sf_dir)
    return k.select(F.col("keyword").alias("id"), F.col("impressions").alias("weight"), "clicks", "page", language.phrase_tokens(F.col("keyword"), _STOP).alias("tokens"), language.place_key(F.col("keyword")).alias("place")).where("size(tokens) > 0")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and seed of each phrase."""
    items = checkpointed(phrase_items(spark, sf_dir))
    return selection.greedy_clusters(items, selection.similar(items))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and topic of each phrase: clusters, merged where one page answers them."""
    return selection.merged_by_page(phrase_items(spark, sf_dir), checkpointed(clusters(spark, sf_dir)))


def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target and score of links between phrases' pages: likeness, the target's need of links and the
    source's authority, less where the source's words have no anchor for the target."""
    k = phrases.keywords(spark, sf_dir).groupBy("page").agg(F.max_by("keyword", F.struct("impressions", "keyword")).alias("name"), F.sum("clicks").alias("clicks"), F.count("*").alias("phrases"))
    pages = checkpointed(k.select("page", "clicks", "phrases", language.phrase_tokens(F.col("name"), _STOP).alias("t")))
    near = cosines.cosine_pairs(pages.select(F.col("page").alias("id"), F.explode("t").alias("term"), F.lit(1).alias("n")), 0.2)
    both = near.select(F.col("a").alias("source"), F.col("b").alias("target"), "cosine").union(near.select("b", "a", "cosine"))
    top = pages.agg(F.max("clicks").alias("top")).first()[0] or 1
    met = both.join(pages.select(F.col("page").alias("source"), (F.col("clicks") / top).alias("authority"), F.col("t").alias("x")), "source").join(pages.select(F.col("page").alias("target"), (1 / F.col("phrases")).alias("need"), F.col("t").alias("y")), "target")
    score = 0.5 * F.least(F.col("cosine") / 0.35, F.lit(1.0)) + 0.3 * F.col("need") + 0.2 * F.col("authority")
    anchored = F.size(F.array_intersect("x", "y")) * 2 > F.size("y")
    return met.select("source", "target", F.round(F.when(anchored, score).otherwise(score * 0.55), 6).alias("score"))


def register(add: Callable) -> None:
    """Adds this module's queries."""
    add("GRF4", clusters)
    add("GRF5", topics)
    add("GRF6", lambda s, d: selection.subtopics(phrase_items(s, d), topics(s, d)))
    add("GRF7", lambda s, d: selection.capped(link_scores(s, d), 5, 3))
    add("WIN15", lambda s, d: selection.capped(phrases.keywords(s, d).selectExpr("page AS source", "impressions % 40 AS target", "clicks AS score").groupBy("source", "target").agg(F.max("score").alias("score")), 4, 6))
