"""Composite scores and verdicts over the crawled site, phrases and texts: link graph, checklist, report, page types,
on-page score, noise reasons, briefs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import documents, site_checks
from rankweave.sources import phrases, site
from rankweave.sources.phrases import KEYWORDS

#: The checklist's weights, and the report's pillars with theirs.
CHECKLIST = {"crawl": 18, "index": 12, "content": 16, "titles": 14, "links": 12, "markup": 16, "speed": 8, "security": 4}
PILLARS = {"foundations": 28, "content": 20, "links": 20, "markup": 12, "speed": 12, "security": 8}
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]
_MONTHS_AND_DAYS = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.read(site.crawl(spark, sf_dir))


def link_graph(records: DataFrame, share: float = 0.6) -> DataFrame:
    """page_id with inbound and outbound editorial links and inbound template links: links in navigation, and to
    pages that at least `share` of all pages link to, belong to the template."""
    pages = site_checks.answered(records)
    edges = documents.links(pages).groupBy("page_id", "target").agg(F.min(F.col("nav").cast("int")).alias("nav")).join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("target")), "target")
    counted = edges.groupBy("to").agg(F.count("*").alias("sources"))
    bound = pages.agg(F.ceil(F.count("*") * share).alias("bound"))
    wide = counted.join(F.broadcast(bound), F.col("sources") >= F.col("bound")).select("to", F.lit(True).alias("wide"))
    split = edges.join(wide, "to", "left").select("page_id", "to", ((F.col("nav") == 1) | F.coalesce("wide", F.lit(False))).alias("template"))
    into = split.groupBy(F.col("to").alias("page_id")).agg(F.count_if(~F.col("template")).alias("inbound"), F.count_if("template").alias("template"))
    out = split.where("NOT template").groupBy("page_id").agg(F.count("*").alias("outbound"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return pages.select("page_id").join(into, "page_id", "left").join(out, "page_id", "left").select("page_id", zero("inbound"), zero("template"), zero("outbound"))


def checklist(records: DataFrame) -> DataFrame:
    """page_id and score of the eight weighted checks: pass 1, warn one half, anything else nothing, with the
    weight kept."""
    noindex = F.coalesce(F.col("robots").contains("noindex"), F.lit(False))
    graded = {
        "crawl": F.when(F.col("status") == 200, 1.0).when(F.col("status") < 400, 0.5), "index": F.when(site_checks.indexable(), 1.0).when(~noindex, 0.5), "content": F.when(F.col("words") >= 80, 1.0).when(F.col("words") >= 40, 0.5),
        "titles": F.when(F.length("title").between(10, 60), 1.0).when(F.col("title").isNotNull(), 0.5), "links": F.when(F.size("links") >= 4, 1.0).when(F.size("links") >= 3, 0.5),
        "markup": F.when(F.exists("json_ld", lambda j: F.try_parse_json(j).isNotNull()), 1.0).when(F.size("json_ld") > 0, 0.5), "speed": F.when(F.col("elapsed_ms") <= 800, 1.0).when(F.col("elapsed_ms") <= 1800, 0.5),
        "security": F.when(F.col("hsts"), 1.0).when(F.col("url").startswith("https:"), 0.5),
    }
    total = sum((F.coalesce(graded[k], F.lit(0.0)) * w for k, w in CHECKLIST.items()), F.lit(0.0))
    return site_checks.answered(records).select("page_id", F.round(100 * total / sum(CHECKLIST.values()), 4).alias("score"))


_WORDS = """CASE p % 12 WHEN 5 THEN 0 ELSE 2 END + CASE WHEN p % 3 <> 0 THEN 2 ELSE 0 END + CAST(p % 21 = 0 AS INTEGER) + CAST(p % 14 = 0 AS INTEGER) + CAST(p % 7 < 3 AS INTEGER) + CAST(p % 4 = 1 AS INTEGER)
    + CASE WHEN shell THEN 0 ELSE words + 1 + CASE WHEN p % 6 <> 0 THEN 2 ELSE 0 END + CASE WHEN h1s = 0 THEN 0 ELSE 2 END END"""
_LINKS = "2 + CAST(p % 3 <> 0 AS INTEGER) + CAST(p % 21 = 0 AS INTEGER) + CAST(p % 14 = 0 AS INTEGER) + CAST(p % 7 < 3 AS INTEGER)"


def report(events: DataFrame) -> DataFrame:
    """user_id, score and grade: weighted mean of six pillars, of which those without a value count on neither side."""
    names = list(PILLARS)
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = events.where("event_id % 8 < 6").groupBy("user_id", kind.alias("pillar")).agg(F.least(F.lit(100.0), F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) / (F.count("*") * 100))).alias("v"))
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in PILLARS.items() for x in pair)), F.col("pillar"))
    scored = rows.groupBy("user_id").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("score"), F.count("*").alias("pillars"))
    return scored.select("user_id", F.round("score", 6).alias("score"), "pillars", F.coalesce(*(F.when(F.col("score") >= least, grade) for least, grade in GRADES), F.lit("E")).alias("grade"))


def page_types(records: DataFrame) -> DataFrame:
    """page_id and the type with the most evidence: markup counts most, then words and links; ties by name."""
    has = lambda t: F.exists("types", lambda x: x == t)
    types = site_checks.nodes(records).where("type IS NOT NULL").groupBy("page_id").agg(F.collect_set("type").alias("types"))
    base = site_checks.answered(records).join(types, "page_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    points = lambda when, n: F.when(when, n).otherwise(0)
    scores = {
        "article": points(has("Article"), 40) + points(F.size("dates") > 0, 10) + points(F.col("words") >= 80, 8),
        "product": points(has("Product"), 40) + points(has("Offer"), 20) + points(F.size("images") >= 2, 8),
        "listing": points(F.size("links") >= 5, 12) + points(F.col("words") < 60, 6),
    }
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("first"), F.lit(t).alias("type")) for k, (t, s) in enumerate(sorted(scores.items())))))
    return base.select("page_id", best.alias("b")).select("page_id", F.when(F.col("b.score") > 0, F.col("b.type")).otherwise("other").alias("type"), F.col("b.score").cast("int").alias("score"))


def on_page(docs: DataFrame) -> DataFrame:
    """doc_id and score: weights 30 coverage (absent where the text has no language, then the rest is scaled up),
    15 word length, 20 named things, 25 lines, 10 opening, 10 headings; less up to 25 for repetition."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size("w")
    base = docs.select("doc_id", "lang", words.alias("w"), F.size(F.split(text, "\n")).alias("lines"))
    part = {
        "coverage": (30, F.when(F.col("lang").isNotNull(), F.least(F.lit(1.0), F.size(F.array_distinct("w")) / 200.0))), "length": (15, F.least(F.lit(1.0), F.try_divide(F.length(F.array_join("w", "")) * 1.0, n * 6.0))),
        "names": (20, F.least(F.lit(1.0), F.size(F.filter("w", lambda x: x.rlike("^[A-Z]"))) / 20.0)), "lines": (25, F.least(F.lit(1.0), F.col("lines") / 10.0)), "opening": (10, (n >= 100).cast("double")), "headings": (10, (F.col("lines") >= 3).cast("double")),
    }
    total = sum((F.coalesce(v, F.lit(0.0)) * w for w, v in part.values()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0) for w, v in part.values()), F.lit(0))
    penalty = F.least(F.lit(25.0), 25 * (1 - F.try_divide(F.size(F.array_distinct("w")) * 1.0, n * 1.0)))
    return base.select("doc_id", F.when(n > 0, F.round(F.greatest(F.lit(0.0), 100 * total / weight - penalty), 4)).otherwise(0.0).alias("score"))


def noise_reasons(docs: DataFrame) -> DataFrame:
    """Capitalised words of texts with the reason for which they are no named things, where there is one."""
    word = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][A-Za-z]*|[0-9]+"), F.lit(0)))
    counted = docs.select(word.alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))
    low = F.lower("surface")
    reason = F.when(low.isin("home", "menu", "search", "contact", "about"), "label").when(F.col("surface").rlike("^[A-Z]{1,2}$"), "two letters").when(low.isin(_MONTHS_AND_DAYS), "calendar").when(F.col("surface").rlike("^[0-9]+$"), "number")
    return counted.select("surface", "n", reason.alias("reason")).where("reason IS NOT NULL")


def briefs(keywords: DataFrame) -> DataFrame:
    """page with the title and description of a brief: the strongest phrase, in at most 60 characters, and what
    its three strongest phrases say, in at most 155."""
    order = Window.partitionBy("page").orderBy(F.desc("impressions"), "keyword")
    top = keywords.withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "keyword"))).alias("t"))
    names = F.transform("t", lambda x: x["keyword"])
    lead = F.get(names, F.lit(0))
    title = F.concat(F.upper(F.substring(lead, 1, 1)), F.substring(lead, 2, 100), F.when(F.length(lead) <= 40, F.lit(" | Guide")).otherwise(""))
    return top.select("page", F.substring(title, 1, 60).alias("title"), F.substring(F.concat(F.lit("All about "), F.array_join(names, ", "), F.lit(".")), 1, 155).alias("description"))


def register(add: Callable, given: Callable) -> None:
    """Adds this module's queries."""
    facts = site.FACTS
    add("GRF1", lambda s, d: link_graph(_records(s, d)), f"""WITH {facts}, e AS (SELECT p, q, min(nav) AS nav FROM (SELECT p, q, 0 AS nav FROM links UNION ALL SELECT p, 0, 1 FROM ok) WHERE q IN (SELECT p FROM ok) GROUP BY p, q),
        w AS (SELECT q FROM e GROUP BY q HAVING count(*) >= (SELECT ceil(count(*) * 0.6) FROM ok)), x AS (SELECT p, q, nav = 1 OR q IN (SELECT q FROM w) AS t FROM e)
        SELECT p AS page_id, (SELECT count(*) FROM x WHERE x.q = ok.p AND NOT t) AS inbound, (SELECT count(*) FROM x WHERE x.q = ok.p AND t) AS template, (SELECT count(*) FROM x WHERE x.p = ok.p AND NOT t) AS outbound FROM ok""")
    add("SCR2", lambda s, d: checklist(_records(s, d)), f"""WITH {facts}, g AS (SELECT p, 18.0 + CASE WHEN p % 47 <> 5 AND p % 13 NOT IN (0, 2) THEN 12 WHEN p % 47 <> 5 THEN 6 ELSE 0 END + CASE WHEN {_WORDS} >= 80 THEN 16 WHEN {_WORDS} >= 40 THEN 8 ELSE 0 END
            + CASE WHEN length(title) BETWEEN 10 AND 60 THEN 14 WHEN title IS NOT NULL THEN 7 ELSE 0 END + CASE WHEN {_LINKS} >= 4 THEN 12 WHEN {_LINKS} >= 3 THEN 6 ELSE 0 END + CASE p % 6 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 16 END
            + CASE WHEN elapsed_ms <= 800 THEN 8 WHEN elapsed_ms <= 1800 THEN 4 ELSE 0 END + CASE WHEN hsts THEN 4 ELSE 2 END AS t FROM ok) SELECT p AS page_id, CAST(round(100 * t / 100, 4) AS DOUBLE) AS score FROM g""")
    names = list(PILLARS)
    add("SCR12", given("events", report), f"""WITH m AS (SELECT user_id, event_id % 8 AS k, least(100.0, floor(sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (count(*) * 100))) AS v FROM events WHERE event_id % 8 < 6 GROUP BY ALL), w AS (SELECT *, {[PILLARS[n] for n in names]}[k + 1] AS w FROM m),
        s AS (SELECT user_id, sum(w * v)::DOUBLE / sum(w) AS s, count(*) AS pillars FROM w GROUP BY 1) SELECT user_id, round(s, 6) AS score, pillars, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'E' END AS grade FROM s""")
    add("STR23", lambda s, d: page_types(_records(s, d)), f"""WITH {facts}, s AS (SELECT p, CASE WHEN p % 6 = 4 THEN 40 ELSE 0 END + CASE WHEN p % 4 = 1 THEN 10 ELSE 0 END + CASE WHEN {_WORDS} >= 80 THEN 8 ELSE 0 END AS a,
            CASE WHEN {_LINKS} >= 5 THEN 12 ELSE 0 END + CASE WHEN {_WORDS} < 60 THEN 6 ELSE 0 END AS l, CASE WHEN p % 6 IN (2, 3, 5) THEN 40 ELSE 0 END + CASE WHEN p % 6 = 3 THEN 20 ELSE 0 END + CASE WHEN images >= 2 THEN 8 ELSE 0 END AS r FROM ok)
        SELECT p AS page_id, CASE WHEN greatest(a, l, r) = 0 THEN 'other' WHEN a >= l AND a >= r THEN 'article' WHEN l >= r THEN 'listing' ELSE 'product' END AS type, CAST(greatest(a, l, r) AS INTEGER) AS score FROM s""")
    add("STR25", given("documents", on_page), r"""WITH d AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents),
        b AS (SELECT doc_id, lang, lines, len(w) AS n, len(list_distinct(w)) AS k, length(array_to_string(w, '')) AS chars, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS caps FROM d),
        s AS (SELECT doc_id, n, k, CASE WHEN lang IS NULL THEN 80 ELSE 110 END AS weight, CASE WHEN lang IS NULL THEN 0 ELSE 30 * least(1.0::DOUBLE, k / 200.0::DOUBLE) END + 15 * least(1.0::DOUBLE, CASE WHEN n > 0 THEN chars / (n * 6.0::DOUBLE) END) + 20 * least(1.0::DOUBLE, caps / 20.0::DOUBLE)
            + 25 * least(1.0::DOUBLE, lines / 10.0::DOUBLE) + CASE WHEN n >= 100 THEN 10 ELSE 0 END + CASE WHEN lines >= 3 THEN 10 ELSE 0 END AS t FROM b)
        SELECT doc_id, CASE WHEN n > 0 THEN round(greatest(0.0::DOUBLE, 100 * t / weight - least(25.0::DOUBLE, 25 * (1 - k::DOUBLE / n))), 4) ELSE 0 END AS score FROM s""")
    add("STR26", given("documents", noise_reasons), f"""WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Za-z]*|[0-9]+')) AS surface FROM documents), c AS (SELECT surface, count(*) AS n FROM w GROUP BY 1),
        r AS (SELECT surface, n, CASE WHEN lower(surface) IN ('home', 'menu', 'search', 'contact', 'about') THEN 'label' WHEN regexp_matches(surface, '^[A-Z]{{1,2}}$') THEN 'two letters' WHEN list_contains({_MONTHS_AND_DAYS}, lower(surface)) THEN 'calendar' WHEN regexp_matches(surface, '^[0-9]+$') THEN 'number' END AS reason FROM c)
        SELECT * FROM r WHERE reason IS NOT NULL""")
    add("STR30", lambda s, d: briefs(phrases.keywords(s, d)), f"""WITH {KEYWORDS}, t AS (SELECT page, list(keyword ORDER BY impressions DESC, keyword)[1:3] AS t FROM keywords GROUP BY page)
        SELECT page, left(upper(left(t[1], 1)) || substr(t[1], 2, 100) || CASE WHEN length(t[1]) <= 40 THEN ' | Guide' ELSE '' END, 60) AS title, left('All about ' || array_to_string(t, ', ') || '.', 155) AS description FROM t""")
    add("MTH1", given("lineitem", changes), """WITH y AS (SELECT l_suppkey AS page, CAST(sum(CASE WHEN year(l_shipdate) = 1998 THEN l_quantity ELSE 0 END) AS BIGINT) AS r, CAST(sum(CASE WHEN year(l_shipdate) = 1997 AND l_suppkey % 4 <> 0 THEN l_quantity ELSE 0 END) AS BIGINT) AS p FROM lineitem GROUP BY 1)
        SELECT page, CASE WHEN p = 0 THEN CASE WHEN r > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE (r - p) * 100.0::DOUBLE / p END AS change, CASE WHEN p <= 0 THEN 0 ELSE greatest(0.0::DOUBLE, (p - r) * 100.0::DOUBLE / p) END AS fall, CASE WHEN p > 0 THEN (r - p) * 100.0::DOUBLE / p END AS delta,
            CASE WHEN p > 0 THEN (r - p) * 100.0::DOUBLE / p WHEN r > 0 THEN 100 ELSE 0 END AS leads FROM y""")


def changes(lines: DataFrame) -> DataFrame:
    """page and its change by each of the four measures, which differ in what a zero prior means."""
    from rankweave.functions import safe

    q = F.col("l_quantity")
    sums = lines.groupBy(F.col("l_suppkey").alias("page")).agg(
        F.sum(F.when(F.year("l_shipdate") == 1998, q).otherwise(0)).cast("long").alias("r"), F.sum(F.when((F.year("l_shipdate") == 1997) & (F.col("l_suppkey") % 4 != 0), q).otherwise(0)).cast("long").alias("p")
    )
    r, p = F.col("r"), F.col("p")
    return sums.select("page", safe.pct_change(r, p).alias("change"), safe.drop_pct(r, p).alias("fall"), safe.delta_pct(r, p).alias("delta"), safe.lead_pct(r, p).alias("leads"))
