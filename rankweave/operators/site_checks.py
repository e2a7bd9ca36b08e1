"""Checks over records of a crawled site: findings of an audit, measures of a tracking board, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators import documents

#: Anchor texts that say nothing about their target.
GENERIC_ANCHORS = ["click here", "here", "read more", "more", "learn more", "this", "link"]
FILES = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|csv)([?#]|$)"
RETRIEVAL_AGENTS = ["oai-searchbot", "chatgpt-user", "perplexitybot"]
#: Properties that a markup type must or should have.
#: Properties that a node of a type must have, must have one of, and should have.
MARKUP_RULES = {
    "Product": (["name"], [["offers", "review", "aggregateRating"]], []),
    "Article": (["headline"], [], ["datePublished"]),
    "BreadcrumbList": (["itemListElement"], [], []),
}
#: Properties whose nested nodes are looked at in their own right, and how deep documents are followed.
NESTED = ["author", "publisher", "provider", "mainEntityOfPage", "itemReviewed"]
DEPTH = 6


def answered(records: DataFrame) -> DataFrame:
    """Pages that came with status 200, the scope of most checks."""
    return records.where("status = 200")


def shared_values(records: DataFrame, field: str) -> DataFrame:
    """Pages whose field, where it is not empty, another page has too."""
    often = records.where(f"{field} <> ''").groupBy(field).agg(F.count("*").alias("pages")).where("pages > 1")
    return records.join(often, field).select("page_id", field, "pages")


def link_targets(records: DataFrame, crawl: DataFrame, when: str) -> DataFrame:
    """target, links and sources (pages) of links whose target was crawled with a status that meets `when`."""
    to = crawl.where(when).select(F.col("url").alias("target"))
    return documents.links(records).join(to, "target", "left_semi").groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("sources"))


def unverified_links(records: DataFrame, crawl: DataFrame) -> DataFrame:
    """Links whose target was not crawled."""
    return documents.links(records).join(crawl.select(F.col("url").alias("target")), "target", "left_anti").groupBy("target").agg(F.count("*").alias("links"))


def inbound(records: DataFrame) -> DataFrame:
    """target and the number of other pages that link to it."""
    return documents.links(records).where("target <> url").groupBy("target").agg(F.countDistinct("page_id").alias("sources"))


def weakly_linked(records: DataFrame) -> DataFrame:
    """Pages with exactly one page that links to them."""
    return answered(records).join(inbound(records).where("sources = 1"), F.col("url") == F.col("target")).select("page_id", "url")


def orphans(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Listed pages that answered and that no other page links to."""
    listed = answered(records).join(entries.select(F.col("loc").alias("url")).distinct(), "url", "left_semi")
    return listed.join(inbound(records).select(F.col("target").alias("url")), "url", "left_anti").select("page_id", "url")


def first_canonical() -> Column:
    return documents.absolute(F.get("canonicals", F.lit(0)), F.col("url"))


def sitemap_issues(entries: DataFrame, records: DataFrame) -> DataFrame:
    """loc and issue of sitemap entries that redirect, are broken, not canonical or were not crawled."""
    met = entries.join(records.select("url", "status", first_canonical().alias("canonical")), F.col("loc") == F.col("url"), "left")
    issue = F.when(F.col("url").isNull(), "missing").when(F.col("status").between(300, 399), "redirect").when(F.col("status") >= 400, "broken").when(F.col("canonical") != F.col("loc"), "not canonical")
    return met.select("loc", issue.alias("issue")).where("issue IS NOT NULL")


def counted(records: DataFrame, field: str, when) -> DataFrame:
    """page_id and how many elements of an array field meet a condition, where any does."""
    return answered(records).select("page_id", F.size(F.filter(field, when)).alias("failed")).where("failed > 0")


def mixed_content() -> Column:
    """Resources without transport security on a page with it."""
    sources = F.concat(F.transform("images", lambda i: i["src"]), F.col("styles"), F.col("scripts"))
    return F.when(F.col("url").startswith("https:"), F.size(F.filter(sources, lambda s: s.startswith("http:")))).otherwise(0)


def unminified() -> Column:
    """Style sheets and scripts that are not named as minified."""
    return F.size(F.filter(F.concat(F.col("styles"), F.col("scripts")), lambda s: s.rlike(r"(?i)\.(css|js)(\?|$)") & ~s.rlike(r"(?i)[.-]min\.(css|js)")))


def client_rendered() -> Column:
    """Scripts but hardly any text in the served HTML."""
    return (F.size("scripts") > 0) & (F.size("headings") == 0) & ~F.col("main")


def indexable() -> Column:
    canonical = first_canonical()
    return (F.col("status") == 200) & ~F.coalesce(F.col("robots").contains("noindex"), F.lit(False)) & (canonical.isNull() | (canonical == F.col("url")))


def heading_skips() -> Column:
    """Whether a heading is more than one level below the one before it."""
    before = F.slice(F.transform("headings", lambda h: h["level"]), 1, F.greatest(F.size("headings") - 1, F.lit(0)))
    after = F.slice(F.transform("headings", lambda h: h["level"]), 2, F.greatest(F.size("headings") - 1, F.lit(0)))
    return F.exists(F.arrays_zip(before.alias("a"), after.alias("b")), lambda z: z["b"] > z["a"] + 1)


# Markup.
def nodes(records: DataFrame, nested: tuple[str, ...] = (*NESTED, "offers", "itemListElement"), depth: int = DEPTH) -> DataFrame:
    """page_id, node (variant) and type of each markup node: documents, members of arrays and of @graph, and what
    lies in `nested` properties, down to `depth`. A node of several types comes once for each, one without a type
    with null. Broken documents are left out. A document's levels are unfolded one by one in its own row."""
    many = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))

    def below(v: Column) -> Column:
        inner = F.array_compact(F.array(*(F.try_variant_get(v, f"$.{k}", "variant") for k in nested)))
        return F.concat(many(v, "$"), many(v, "$['@graph']"), inner)

    def level(sums: Column, _: Column) -> Column:
        return F.struct(F.concat(sums["found"], sums["next"]).alias("found"), F.flatten(F.transform(sums["next"], below)).alias("next"))

    docs = answered(records).select("page_id", F.explode("json_ld").alias("raw")).select("page_id", F.try_parse_json("raw").alias("v")).where("v IS NOT NULL")
    start = F.struct(F.array().cast("array<variant>").alias("found"), F.array("v").alias("next"))
    every = docs.select("page_id", F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(depth)), start, level, lambda x: x["found"])).alias("node"))
    objects = every.where(F.schema_of_variant("node").startswith("OBJECT"))
    kinds = F.coalesce(F.try_variant_get("node", "$['@type']", "array<string>"), F.array(F.try_variant_get("node", "$['@type']", "string")))
    return objects.select("page_id", "node", F.explode_outer(kinds).alias("type"))


def markup_faults(records: DataFrame) -> DataFrame:
    """page_id, type, required and recommended: the properties that nodes of known types lack. Of a group of which
    one is enough, all are named. Blank texts, empty arrays and nulls count as lacking."""
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rule = lambda must, one, should: F.struct(text(must).alias("must"), (F.array(*map(text, one)) if one else F.array().cast("array<array<string>>")).alias("one"), text(should).alias("should"))
    rules = F.create_map(*(x for kind, r in MARKUP_RULES.items() for x in (F.lit(kind), rule(*r))))
    typed = nodes(records).withColumn("rule", F.try_element_at(rules, F.col("type"))).where("rule IS NOT NULL")
    given = F.from_json(F.to_json("node"), "map<string,string>")
    keys = F.map_keys(F.map_filter(given, lambda _, v: v.isNotNull() & ~F.trim(v).isin("", "[]", "null")))
    lacking = F.concat(F.array_except(F.col("rule.must"), F.col("keys")), F.transform(F.filter("rule.one", lambda g: ~F.arrays_overlap(g, F.col("keys"))), lambda g: F.array_join(g, "|")))
    return typed.withColumn("keys", keys).select("page_id", "type", lacking.alias("required"), F.array_except(F.col("rule.should"), F.col("keys")).alias("recommended"))


def schema_scores(records: DataFrame) -> DataFrame:
    """page_id and score: 80, less 12 an error (60 at most) and 2 a warning (20 at most), and 5 a type (20 at
    most); pages without markup have 0. An error is a broken document or a required property that lacks."""
    faults = markup_faults(records).groupBy("page_id").agg(F.sum(F.size("required")).alias("errors"), F.sum(F.size("recommended")).alias("warnings"))
    types = nodes(records).where("type IS NOT NULL").groupBy("page_id").agg(F.countDistinct("type").alias("types"))
    broken = F.size(F.filter("json_ld", lambda j: F.try_parse_json(j).isNull()))
    base = answered(records).select("page_id", F.size("json_ld").alias("blocks"), broken.alias("broken")).join(faults, "page_id", "left").join(types, "page_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = 80 - F.least(F.lit(60), 12 * (F.col("broken") + zero("errors"))) - F.least(F.lit(20), 2 * zero("warnings")) + F.least(F.lit(20), 5 * zero("types"))
    return base.select("page_id", F.when(F.col("blocks") > 0, score).otherwise(0).cast("long").alias("score"))


def page_dates(records: DataFrame) -> DataFrame:
    """page_id, the newest date stated and where: markup first, then time elements."""
    stated = F.coalesce(*(F.try_variant_get("node", f"$.{k}", "string") for k in ("dateModified", "datePublished"))).try_cast("date")
    marked = nodes(records).select("page_id", stated.alias("d")).groupBy("page_id").agg(F.max("d").alias("marked"))
    shown = F.array_max(F.transform("dates", lambda d: d.try_cast("date")))
    both = answered(records).select("page_id", shown.alias("shown")).join(marked, "page_id", "left")
    return both.select("page_id", F.coalesce("marked", "shown").alias("day"), F.when(F.col("marked").isNotNull(), "markup").when(F.col("shown").isNotNull(), "time").alias("found"))


# Access of agents.
def probes(crawl: DataFrame) -> DataFrame:
    """page_id, agent and verdict of probes by each retrieval agent; some could not be measured."""
    spread = crawl.select("page_id", F.posexplode(F.array(*map(F.lit, RETRIEVAL_AGENTS))).alias("k", "agent"))
    at = (F.col("page_id") + F.col("k")) % 4
    return spread.select("page_id", "agent", F.when(at == 1, "blocked").when(at > 1, "ok").alias("verdict"))


def readiness(records: DataFrame, probes_: DataFrame) -> DataFrame:
    """page_id and score: up to 55 for the share of measured agents that get through (0 where none was
    measured), and points for content, indexing, a main element, a fast answer and transport security."""
    access = probes_.groupBy("page_id").agg(F.count_if(F.col("verdict") == "ok").alias("ok"), F.count("verdict").alias("measured"))
    points = lambda when, n: F.when(when, n).otherwise(0)
    base = answered(records).join(access, "page_id", "left")
    score = (
        F.round(55 * F.coalesce(F.try_divide(F.col("ok").cast("double"), F.col("measured").cast("double")), F.lit(0.0))).cast("int") + points(~client_rendered(), 15)
        + points(~F.coalesce(F.col("robots").contains("noindex"), F.lit(False)), 10) + points(F.col("main"), 8) + points(F.col("elapsed_ms") < 800, 7) + points(F.col("hsts"), 5)
    )
    return base.select("page_id", F.least(F.lit(100), F.greatest(F.lit(0), score)).alias("score"))


def standing(value: Column, good: float, warn: float, rising: bool = False) -> Column:
    """good, warn or fail by two bounds; unknown without a value. `rising`: more is better."""
    at_least = lambda bound: value >= bound if rising else value <= bound
    return F.when(value.isNull(), "unknown").when(at_least(good), "good").when(at_least(warn), "warn").otherwise("fail")


def measures(rows: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
    """metric, value and status in long form, from one aggregate over the rows. wanted: a function of the
    measure's column, and its bounds, by metric."""
    totals = rows.agg(*(column().cast("double").alias(name) for name, (column, *_) in wanted.items()))
    parts = [F.struct(F.lit(name).alias("metric"), F.round(F.col(name), 6).alias("value"), standing(F.col(name), *bounds).alias("status")) for name, (_, *bounds) in wanted.items()]
    return totals.select(F.explode(F.array(*parts)).alias("m")).select("m.*")
