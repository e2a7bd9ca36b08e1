"""Responses, sitemaps and robots.txt read into records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankweave.operators import html
from rankweave.operators.content import all_matches

@F.pandas_udf(StringType())
def absolute(href: pd.Series, url: pd.Series) -> pd.Series:
    """A reference's target as an absolute URL without its fragment; null for anchors, scripts and mail."""
    return pd.Series([html.resolve(h, u or "") for h, u in zip(href, url, strict=True)], dtype=object)


def read(crawl: DataFrame) -> DataFrame:
    """One nested record per response (see operators.html) with the response's own fields and html_length.
    Responses without HTML have empty lists."""
    return html.records(crawl.withColumn("html_length", F.length(F.coalesce("html", F.lit("")))))


def links(records: DataFrame) -> DataFrame:
    """One row a link that has a target."""
    return records.select("page_id", "url", F.explode("links").alias("l")).select("page_id", "url", "l.*").where("target IS NOT NULL")


def entries(sitemaps: DataFrame) -> DataFrame:
    """file, loc and lastmod of each entry."""
    part = lambda name: F.regexp_extract("entry", rf"(?is)<{name}>\s*(.*?)\s*</{name}>", 1)
    split = sitemaps.select("file", F.explode(all_matches(F.col("xml"), r"(?is)<url>.*?</url>")).alias("entry"))
    return split.select("file", part("loc").alias("loc"), part("lastmod").try_cast("date").alias("lastmod"))


def rules(robots: DataFrame) -> DataFrame:
    """site, agents (lower case), allow, pattern, at: rules of each group of a robots.txt, in order. Consecutive
    User-agent lines share one group. Lines of one file are walked in order by a window over the file."""
    line = F.trim(F.regexp_replace("line", r"#.*$", ""))
    lines = robots.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).select("site", "at", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"), F.trim(F.regexp_replace(line, r"^[^:]*:?", "")).alias("value"))
    told = lines.where("key IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'sitemap')")
    order = Window.partitionBy("site").orderBy("at")
    opens = (F.col("key") == "user-agent") & ~F.lag("key").over(order).eqNullSafe("user-agent")
    grouped = told.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order))
    agents = F.collect_list(F.when(F.col("key") == "user-agent", F.lower("value"))).over(Window.partitionBy("site", "group"))
    return grouped.withColumn("agents", F.array_sort(agents)).where("key <> 'user-agent'").select("site", "group", "agents", "key", "value", "at")


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern, with * and a closing $, as a regular expression from the path's start on."""
    quoted = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    anchored = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(.)", r"\\$$1")
    return F.concat(F.lit("^"), anchored)


def allowed(rules_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (site, agent, path) with `allowed`: of the group for the agent (its own name, else the longest
    name that it contains, else *), the longest matching pattern decides, and Allow wins a tie."""
    names = rules_.select("site", "group", F.explode("agents").alias("name")).distinct()
    agent = F.lower("agent")
    fits = (agent == F.col("name")) | agent.contains(F.col("name")) | (F.col("name") == "*")
    rank = F.when(agent == F.col("name"), F.lit(1000)).when(F.col("name") == "*", F.lit(-1)).otherwise(F.length("name"))
    chosen = asked.join(names, "site").where(fits).groupBy("site", "agent", "path").agg(F.max_by("group", rank).alias("group"))
    pats = rules_.where("key IN ('allow', 'disallow') AND value <> ''").select("site", "group", (F.col("key") == "allow").alias("allow"), "value")
    met = chosen.join(pats, ["site", "group"]).where(F.regexp_like("path", pattern_regex(F.col("value"))))
    verdict = met.groupBy("site", "agent", "path").agg(F.max(F.struct(F.length("value").alias("n"), F.col("allow").cast("int").alias("allow"))).alias("v"))
    return asked.join(verdict, ["site", "agent", "path"], "left").select("site", "agent", "path", F.coalesce(F.col("v.allow") == 1, F.lit(True)).alias("allowed"))
