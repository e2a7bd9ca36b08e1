"""Roll-ups, joins and scores over phrases, pages, orders and events that the other modules don't hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import cosines, documents, language, matching, site_checks
from rankweave.plans.texts import _STOP, _TOKENS
from rankweave.sources import phrases, site, tables
from rankweave.sources.phrases import KEYWORDS
from rankweave.sources.tables import table, twin


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, site and position of search results; position is null where a site was looked for in vain."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("keyword"), (F.col("l_suppkey") % 6).alias("site")).agg(F.min(F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int"))).alias("position"))


_CAPTURES = "c AS (SELECT l_partkey AS keyword, l_suppkey % 6 AS site, min(CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INTEGER) END) AS position FROM lineitem GROUP BY ALL)"


def _leaders(captures: DataFrame) -> DataFrame:
    """site, prompts, present, share of what was measured, best and mean position."""
    rows = captures.groupBy("site").agg(F.count("*").alias("prompts"), F.count("position").alias("present"), F.min("position").alias("best"), F.round(F.avg("position"), 6).alias("mean"))
    return rows.withColumn("share", F.round(F.try_divide(F.col("present").cast("double"), F.col("prompts").cast("double")), 6))


def _authority(captures: DataFrame) -> DataFrame:
    """keyword and score of how hard it is: by the shares of results that are large, match, are first, are users'."""
    share = lambda when: F.avg(when.cast("int"))
    score = 20 + 45 * share(F.col("site") < 2) + 25 * share(F.col("position") <= 20) + 15 * share(F.col("site") == 0) - 20 * share(F.col("site") == 5)
    return captures.where("position IS NOT NULL").groupBy("keyword").agg(F.round(F.greatest(F.lit(5.0), F.least(F.lit(100.0), score)), 6).alias("score"))


def _standings(captures: DataFrame) -> DataFrame:
    """keyword and state of site 0 against the best of the others."""
    ours, theirs = F.min(F.when(F.col("site") == 0, F.col("position"))), F.min(F.when(F.col("site") != 0, F.col("position")))
    both = captures.groupBy("keyword").agg(ours.alias("ours"), theirs.alias("theirs"))
    state = F.when(F.col("ours").isNull() & F.col("theirs").isNull(), "nobody ranks").when(F.col("ours").isNull(), "absent").when(F.col("theirs").isNull() | (F.col("ours") <= F.col("theirs")), "we lead").otherwise("behind")
    return both.select("keyword", state.alias("state"))


def _topics(docs: DataFrame) -> DataFrame:
    """topic (source) by language: 40 for the share of texts, 40 for that of openings, 20 for depth, and the
    deficit against the best language."""
    totals = docs.groupBy("lang").agg(F.count("*").alias("all"))
    met = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 2000).alias("deep"))
    scored = met.join(F.broadcast(totals), "lang").select("lang", "source", F.round(80 * F.col("n") / F.col("all") + F.when(F.col("deep") > 3, 20).otherwise(0), 6).alias("score"))
    best = scored.groupBy("source").agg(F.max("score").alias("best"))
    return scored.join(best, "source").select("source", "lang", "score", F.round(F.col("best") - F.col("score"), 6).alias("deficit"))


def _page_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path with clicks, position weighted by impressions, leads, leads per 100 clicks and value per click."""
    seen = tables.metric_daily(spark, sf_dir).groupBy((F.col("entity") % 25).alias("path")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("i"), F.sum("pos").alias("w"))
    leads = tables.leads(spark, sf_dir).groupBy((F.col("person") % 30).alias("path")).agg(F.count("*").alias("leads"), F.sum("value").alias("value"))
    both = seen.join(leads, "path", "full")
    per = lambda top: F.round(F.try_divide(top.cast("double"), F.col("clicks").cast("double")), 6)
    return both.select("path", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.round(F.try_divide(F.col("w").cast("double"), F.col("i").cast("double")), 6).alias("position"), F.coalesce("leads", F.lit(0)).alias("leads"), per(F.col("leads") * 100).alias("leads_per_100"), per(F.col("value")).alias("value_per_click"))


def _phrase_of_page(pages: DataFrame) -> DataFrame:
    """page_id and its strongest phrase: 2- to 4-word runs of the title (weight 3) that the text has too; a
    run's score is its weight and words."""
    html = F.coalesce("html", F.lit(""))
    words = lambda t: F.filter(F.split(F.lower(t), r"[^a-z]+"), lambda w: F.length(w) > 0)
    base = pages.select("page_id", words(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("t"), F.concat(F.lit(" "), F.array_join(words(F.regexp_replace(F.regexp_extract(html, r"(?is)<article>(.*)", 1), r"(?is)<h1>.*?</h1>|<[^>]*>", " ")), " "), F.lit(" ")).alias("b"))
    def runs(n: int) -> DataFrame:
        joined = F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))
        return base.where(F.size("t") >= n).select("page_id", "b", F.lit(n).alias("n"), F.explode(joined).alias("phrase"))

    every = runs(2).unionByName(runs(3)).unionByName(runs(4))
    met = every.where(F.contains("b", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).groupBy("page_id", "phrase").agg(F.sum(3 + F.col("n")).alias("score"))
    return met.groupBy("page_id").agg(F.max_by(F.struct("phrase", "score"), F.struct("score", "phrase")).alias("m")).select("page_id", "m.phrase", "m.score")


def _rivals_by_host(pages: DataFrame) -> DataFrame:
    """site (language section) and host counts of pages that refer to it, its own host left out; top 8 a site."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    rows = pages.select(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-z]{2})/", 1).alias("site"), host.alias("host")).where("site <> '' AND NOT host LIKE concat('%', site, '.example%')")
    counted = rows.groupBy("site", "host").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "host"))).where("place <= 8").select("site", "host", "n")


def _link_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b and 0.65 of the Jaccard of their stems plus 0.35 of their cosine, of all phrases at or over 0.6. The
    cosine of two sets is never below their Jaccard, so it has to reach that as well."""
    t = phrases.keywords(spark, sf_dir).select("keyword", language.phrase_tokens(F.col("keyword"), _STOP).alias("t"))
    near = cosines.cosine_pairs(t.select(F.col("keyword").alias("id"), F.explode("t").alias("term"), F.lit(1).alias("n")), 0.599)
    side = lambda c, name: t.select(F.col("keyword").alias(c), F.col("t").alias(name))
    met = near.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    nx, ny = F.size("x"), F.size("y")
    score = F.round(0.65 * F.col("n") / (nx + ny - F.col("n")) + 0.35 * F.col("n") / F.sqrt(nx * ny * 1.0), 3)
    return met.select("a", "b", score.alias("score")).where("score >= 0.6")


def _best_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and the best phrase head for its name by score: equal 100, contained in the head 80, containing it
    60; place 1 is the best match of all. Every name is a head itself, so the best match alone would never need the
    other scores. Different names meet different heads once, however many parts have them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    names = parts.select(F.col("name").alias("t")).where("t is not null").distinct()
    heads = names.union(names.selectExpr("concat(t, ' set') AS t")).distinct()
    equal = names.selectExpr("t AS name", "t AS head", "100 AS score")
    within = matching.contained(names, heads).selectExpr("needle AS name", "hay AS head", "80 AS score")
    around = matching.contained(heads, names).selectExpr("hay AS name", "needle AS head", "60 AS score")
    best = equal.union(within).union(around).groupBy("name", "score").agg(F.max("head").alias("head"))
    met = parts.join(best, "name").groupBy("p_partkey", "score").agg(F.max("head").alias("head"))
    return met.select("p_partkey", "head", "score", F.dense_rank().over(Window.partitionBy("p_partkey").orderBy(F.desc("score"))).cast("long").alias("place"))


def _brief_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword and its best pages by shared words: top 8 by overlap, then page."""
    k = phrases.keywords(spark, sf_dir).select("keyword", F.explode(F.split("keyword", " ")).alias("w")).distinct()
    # Of pages with the same text the first 8 are enough for any phrase's best 8, and one stands for all in the join.
    text = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))), " ")
    ranked = table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).withColumn("k", F.row_number().over(Window.partitionBy("text").orderBy("p_partkey"))).where("k <= 8")
    words = ranked.where("k = 1").select("text", F.explode(F.split("text", " ")).alias("w"))
    met = k.join(words, "w").groupBy("keyword", "text").agg(F.count("*").alias("shared")).where("shared >= 2").join(ranked, "text")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("shared"), "p_partkey"))).where("place <= 8").select("keyword", "p_partkey", "shared")


def _latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind and brand (which may be null) the newest run with its findings' number, null-safe."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5).alias("brand"))
    last = runs.groupBy("kind", "brand").agg(F.max("id").alias("id"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("findings"))
    return last.join(items, "id", "left").select("kind", "brand", "id", F.coalesce("findings", F.lit(0)).alias("findings"))


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword, evidence and impressions of measured and suggested phrases together."""
    measured = phrases.keywords(spark, sf_dir).where("page <= 25").select("keyword", "impressions")
    suggested = phrases.keywords(spark, sf_dir).where("page > 20").select("keyword", F.lit(True).alias("s"))
    evidence = F.when(F.col("s").isNull(), "measured").when(F.col("impressions").isNull(), "suggested").otherwise("both")
    return measured.join(suggested, "keyword", "full").select("keyword", evidence.alias("evidence"), "impressions")


def _cadence(events: DataFrame) -> DataFrame:
    """user_id and how often it comes, by the median-free mean gap: hourly, daily, weekly, monthly or rare."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    rows = events.groupBy("user_id").agg(F.try_divide(span, (F.count("*") - 1) * 60_000_000).alias("minutes"))
    name = F.when(F.col("minutes").isNull(), "once").when(F.col("minutes") <= 55, "hourly").when(F.col("minutes") <= 23 * 60, "daily").when(F.col("minutes") <= 6.8 * 1440, "weekly").when(F.col("minutes") <= 27 * 1440, "monthly").otherwise("rare")
    return rows.select("user_id", name.alias("cadence"))


def cron_due(minute: Column, hour: Column, day: Column, month: Column, weekday: Column, at: Column) -> Column:
    """Whether a time meets a cron line's five fields: *, */n, lists and ranges. Where both day fields are
    bound, one of them is enough."""
    def meets(field: Column, value: Column, low: int) -> Column:
        part = lambda p: (p == "*") | (p.rlike(r"^\*/[0-9]+$") & ((value - low) % F.greatest(F.lit(1), F.regexp_extract(p, r"([0-9]+)$", 1).try_cast("int")) == 0)) | (p.try_cast("int") == value) | (p.rlike(r"^[0-9]+-[0-9]+$") & value.between(F.regexp_extract(p, r"^([0-9]+)", 1).try_cast("int"), F.regexp_extract(p, r"([0-9]+)$", 1).try_cast("int")))
        return F.exists(F.split(field, ","), lambda p: F.coalesce(part(p), F.lit(False)))

    dom, dow = meets(day, F.dayofmonth(at), 1), meets(weekday, F.dayofweek(at) - 1, 0)
    days = F.when((day != "*") & (weekday != "*"), dom | dow).otherwise(dom & dow)
    return meets(minute, F.minute(at), 0) & meets(hour, F.hour(at), 0) & meets(month, F.month(at), 1) & days


def _due(events: DataFrame) -> DataFrame:
    field = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    when = cron_due(field(["*/15", "0,30", "5-20", "*"], "event_id"), field(["*", "0-11", "*/6"], "user_id"), field(["*", "1-15"], "user_id"), F.lit("1"), field(["*", "1", "0,6"], "event_id"), F.col("ts"))
    return events.where(when).select("event_id")


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the first verdict that holds, by drift, clicks and age."""
    r = site_checks.page_dates(documents.read(site.crawl(spark, sf_dir))).select("page_id", F.datediff(F.lit("2024-06-01").cast("date"), "day").alias("age"))
    drift, change, rising = (F.col("page_id") % 100) / 100, F.col("page_id") % 80 - 40, F.col("page_id") % 2 == 0
    verdict = F.when((drift >= 0.35) & (F.col("page_id") % 11 >= 5), "intent-drift").when(change <= -25, "decaying").when((F.col("age") >= 365) & ~rising, "stale").when(F.col("age").isNull(), "unknown-age").when(F.col("age") >= 365, "old-but-healthy").otherwise("ok")
    return r.select("page_id", verdict.alias("verdict"))


_FRESH = f"""{site.FACTS}, f AS (SELECT p, CASE WHEN (p % 100) / 100.0 >= 0.35 AND p % 11 >= 5 THEN 'intent-drift' WHEN p % 80 - 40 <= -25 THEN 'decaying'
    WHEN p % 6 IN (2, 4) THEN 'ok' WHEN p % 4 = 1 THEN CASE WHEN DATE '2024-06-01' - (DATE '2023-05-01' + CAST(p % 28 AS INTEGER)) < 365 THEN 'ok' WHEN p % 2 = 1 THEN 'stale' ELSE 'old-but-healthy' END ELSE 'unknown-age' END AS verdict FROM ok)"""


def _architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: pages, orphans, share of pages that link on, share with breadcrumbs, and the score."""
    r = site_checks.answered(documents.read(site.crawl(spark, sf_dir)))
    linked = site_checks.inbound(r).select(F.col("target").alias("url"), F.lit(True).alias("linked"))
    crumbs = site_checks.nodes(r).where("type = 'BreadcrumbList'").select("page_id", F.lit(True).alias("crumbs")).distinct()
    spokes = documents.links(r).where("NOT nav AND target <> url").select("page_id", F.lit(True).alias("spoke")).distinct()
    every = r.select("page_id", "url").join(linked, "url", "left").join(crumbs, "page_id", "left").join(spokes, "page_id", "left")
    share = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    rows = every.agg(F.count("*").alias("pages"), share("linked").alias("a"), share("spoke").alias("b"), share("crumbs").alias("c"))
    return rows.select("pages", F.round("a", 6).alias("linked"), F.round("b", 6).alias("spokes"), F.round("c", 6).alias("crumbs"), F.round(40 * F.col("a") + 35 * F.col("b") + 25 * F.col("c")).cast("int").alias("score"))


def _competitive(captures: DataFrame) -> DataFrame:
    """site and the share of four measures in which it is at least the mean of its rivals."""
    m = captures.groupBy("site").agg(F.count("position").alias("a"), F.count("*").alias("b"), F.count_if(F.col("position") <= 15).alias("c"), F.sum(F.lit(50) - F.coalesce("position", F.lit(50))).alias("d"))
    every = Window.partitionBy()
    wins = sum((((F.sum(c).over(every) - F.col(c)) <= F.col(c) * (F.count("*").over(every) - 1)).cast("int") for c in "abcd"), F.lit(0))
    return m.withColumn("n", F.count("*").over(every)).select("site", F.when(F.col("n") > 1, wins / 4).alias("score"))


def register(add: Callable, given: Callable) -> None:
    """Adds this module's queries."""
    over = lambda work: lambda s, d: work(_captures(s, d))
    add("AGG8", given("events", lambda e: e.withColumn("list", F.concat_ws(" , ", "event_type", F.when(F.col("event_id") % 3 == 0, "extra"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")))).select(F.explode(F.split("list", ",")).alias("t"), "value").groupBy(F.trim("t").alias("token")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("weight"))),
        """WITH t AS (SELECT event_type AS token, value FROM events UNION ALL SELECT 'extra', value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_type, value FROM events WHERE event_id % 7 = 0)
        SELECT token, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS weight FROM t GROUP BY 1""")
    add("AGG11", _page_leads, twin("""WITH s AS (SELECT entity % 25 AS path, CAST(sum(clicks) AS BIGINT) AS clicks, sum(impressions) AS i, sum(pos) AS w FROM metric GROUP BY 1), l AS (SELECT person % 30 AS path, count(*) AS leads, sum(value) AS value FROM leads GROUP BY 1)
        SELECT coalesce(s.path, l.path) AS path, coalesce(clicks, 0) AS clicks, CASE WHEN i > 0 THEN round(w::DOUBLE / i, 6) END AS position, coalesce(leads, 0) AS leads, CASE WHEN clicks > 0 THEN round(leads * 100.0::DOUBLE / clicks, 6) END AS leads_per_100,
            CASE WHEN clicks > 0 THEN round(value::DOUBLE / clicks, 6) END AS value_per_click FROM s FULL JOIN l ON s.path = l.path""", "metric", "leads"))
    add("AGG33", given("documents", _topics), """WITH n AS (SELECT lang, count(*) AS al FROM documents GROUP BY 1), m AS (SELECT lang, source, count(*) AS n, count(CASE WHEN length(text) > 2000 THEN 1 END) AS deep FROM documents GROUP BY ALL),
        s AS (SELECT source, m.lang, round(80 * m.n::DOUBLE / al + CASE WHEN deep > 3 THEN 20 ELSE 0 END, 6) AS score FROM m JOIN n ON m.lang = n.lang) SELECT source, lang, score, round(max(score) OVER (PARTITION BY source) - score, 6) AS deficit FROM s""")
    add("AGG36", over(_leaders), f"WITH {_CAPTURES} SELECT site, count(*) AS prompts, count(position) AS present, min(position) AS best, round(avg(position), 6) AS mean, round(count(position)::DOUBLE / count(*), 6) AS share FROM c GROUP BY 1")
    add("AGG37", over(_authority), f"""WITH {_CAPTURES} SELECT keyword, round(greatest(5.0, least(100.0, 20 + 45 * avg(CAST(site < 2 AS INTEGER)) + 25 * avg(CAST(position <= 20 AS INTEGER)) + 15 * avg(CAST(site = 0 AS INTEGER)) - 20 * avg(CAST(site = 5 AS INTEGER)))), 6) AS score
        FROM c WHERE position IS NOT NULL GROUP BY 1""")
    add("AGG43", lambda s, d: _captures(s, d).groupBy("site").agg(F.count_if(F.col("position").isNull()).alias("gaps"), F.sum(F.coalesce("position", F.lit(0))).alias("total"), F.round(F.avg((F.col("position") <= 20).cast("int")), 6).alias("visible")).orderBy(F.desc("gaps"), "site").limit(8),
        f"WITH {_CAPTURES} SELECT site, count(*) - count(position) AS gaps, CAST(sum(coalesce(position, 0)) AS BIGINT) AS total, round(avg(CAST(position <= 20 AS INTEGER)), 6) AS visible FROM c GROUP BY 1 ORDER BY gaps DESC, site LIMIT 8")
    add("AGG44", given("pages", _phrase_of_page), r"""WITH b AS (SELECT page_id, list_filter(regexp_split_to_array(lower(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)), '[^a-z]+'), lambda w: w <> '') AS t,
            ' ' || array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<article>(.*)', 1), '(?is)<h1>.*?</h1>|<[^>]*>', ' ', 'g')), '[^a-z]+'), lambda w: w <> ''), ' ') || ' ' AS b FROM pages),
        n AS (SELECT page_id, t, b, unnest([2, 3, 4]) AS n FROM b), r AS (SELECT page_id, b, n, t, unnest(range(1, len(t) - n + 2)) AS i FROM n WHERE len(t) >= n), p AS (SELECT page_id, b, n, array_to_string(t[i : i + n - 1], ' ') AS phrase FROM r),
        s AS (SELECT page_id, phrase, CAST(sum(3 + n) AS BIGINT) AS score FROM p WHERE contains(b, ' ' || phrase || ' ') GROUP BY ALL) SELECT page_id, phrase, score FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, phrase DESC) = 1""")
    add("JOIN5", _latest_runs, """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS kind, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS brand FROM orders)
        SELECT kind, brand, id, (SELECT count(*) FROM lineitem WHERE l_orderkey = r.id) AS findings FROM r WHERE id = (SELECT max(id) FROM r x WHERE x.kind = r.kind AND x.brand IS NOT DISTINCT FROM r.brand)""")
    add("JOIN15", lambda s, d: tables.query_page(s, d).groupBy("query").agg(F.countDistinct("page").alias("pages"), F.max_by("page", F.struct("impressions", "page")).alias("top")).where("pages > 20"), twin("SELECT query, count(DISTINCT page) AS pages, arg_max(page, (impressions, page)) AS top FROM query_page GROUP BY 1 HAVING pages > 20", "query_page"))
    add("JOIN20", over(_standings), f"""WITH {_CAPTURES}, s AS (SELECT keyword, min(CASE WHEN site = 0 THEN position END) AS o, min(CASE WHEN site <> 0 THEN position END) AS t FROM c GROUP BY 1)
        SELECT keyword, CASE WHEN o IS NULL AND t IS NULL THEN 'nobody ranks' WHEN o IS NULL THEN 'absent' WHEN t IS NULL OR o <= t THEN 'we lead' ELSE 'behind' END AS state FROM s""")
    add("JOIN21", _suggested, f"WITH {KEYWORDS} SELECT keyword, CASE WHEN page <= 20 THEN 'measured' WHEN page > 25 THEN 'suggested' ELSE 'both' END AS evidence, CASE WHEN page <= 25 THEN impressions END AS impressions FROM keywords")
    add("JOIN24", _brief_pages, f"""WITH {KEYWORDS}, k AS (SELECT DISTINCT keyword, unnest(string_split(keyword, ' ')) AS w FROM keywords), p AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)
        SELECT keyword, p_partkey, count(*) AS shared FROM k JOIN p USING (w) GROUP BY 1, 2 HAVING shared >= 2 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY shared DESC, p_partkey) <= 8""")
    add("JOIN25", _best_fuzzy, """WITH n AS (SELECT DISTINCT lower(p_name) AS h FROM part), h AS (SELECT h FROM n UNION ALL SELECT h || ' set' FROM n), m AS (SELECT p_partkey, h, CASE WHEN h = lower(p_name) THEN 100 WHEN contains(h, lower(p_name)) THEN 80 WHEN contains(lower(p_name), h) THEN 60 END AS score FROM part, h)
        SELECT p_partkey, h AS head, score, dense_rank() OVER (PARTITION BY p_partkey ORDER BY score DESC) AS place FROM m WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey, score ORDER BY h DESC) = 1""")
    add("WIN13", lambda s, d: tables.metric_daily(s, d).groupBy("entity", "date").agg(F.sum("clicks").alias("clicks")).withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("date"))).withColumn("n", F.count("*").over(Window.partitionBy("entity"))).groupBy("entity").agg(F.sum(F.when(F.col("k") <= F.floor(F.col("n") / 2), F.col("clicks")).otherwise(0)).alias("early"), F.sum(F.when(F.col("k") > F.floor(F.col("n") / 2), F.col("clicks")).otherwise(0)).alias("late")),
        twin("""WITH d AS (SELECT entity, date, sum(clicks) AS c, row_number() OVER (PARTITION BY entity ORDER BY date) AS k, count(*) OVER (PARTITION BY entity) AS n FROM metric GROUP BY entity, date)
        SELECT entity, CAST(sum(CASE WHEN k <= n // 2 THEN c ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN k > n // 2 THEN c ELSE 0 END) AS BIGINT) AS late FROM d GROUP BY 1""", "metric"))
    add("DAT4", given("events", _due), """WITH e AS (SELECT event_id, user_id, minute(ts) AS mi, hour(ts) AS h, day(ts) AS d, month(ts) AS mo, dayofweek(ts) AS w FROM events), m AS (SELECT *, CASE event_id % 4 WHEN 0 THEN mi % 15 = 0 WHEN 1 THEN mi IN (0, 30) WHEN 2 THEN mi BETWEEN 5 AND 20 ELSE true END AS a,
        CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN h <= 11 ELSE h % 6 = 0 END AS b, user_id % 2 = 1 AS dset, user_id % 2 = 0 OR d <= 15 AS dom, event_id % 3 <> 0 AS wset, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN w = 1 ELSE w IN (0, 6) END AS dow FROM e)
        SELECT event_id FROM m WHERE a AND b AND mo = 1 AND CASE WHEN dset AND wset THEN dom OR dow ELSE dom AND dow END""")
    add("DAT5", given("events", _cadence), """WITH g AS (SELECT user_id, CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / ((count(*) - 1) * 60000000) END AS m FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN m IS NULL THEN 'once' WHEN m <= 55 THEN 'hourly' WHEN m <= 1380 THEN 'daily' WHEN m <= 6.8 * 1440 THEN 'weekly' WHEN m <= 27 * 1440 THEN 'monthly' ELSE 'rare' END AS cadence FROM g""")
    add("DAT6", lambda s, d: tables.leads(s, d).groupBy().agg(F.max("day").alias("last")).select(F.explode(F.sequence(F.add_months(F.trunc("last", "month"), -11), F.trunc("last", "month"), F.expr("interval 1 month"))).alias("month")).join(tables.leads(s, d).groupBy(F.trunc("day", "month").alias("month")).agg(F.count("*").alias("leads")), "month", "left").select("month", F.coalesce("leads", F.lit(0)).alias("leads")),
        twin("WITH x AS (SELECT date_trunc('month', max(day)) AS m FROM leads), r AS (SELECT CAST(unnest(range(m - INTERVAL 11 MONTH, m + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM x) SELECT month, (SELECT count(*) FROM leads WHERE CAST(date_trunc('month', day) AS DATE) = month) AS leads FROM r", "leads"))
    add("MTH7", given("part", lambda p: p.groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", "n", F.when(F.col("n") >= 8, F.greatest(F.lit(3), F.least(F.ceil(F.round(F.col("n") * 0.07, 9)), F.col("n")))).otherwise(F.greatest(F.lit(2), F.least(F.ceil(F.round(F.col("n") * 0.07, 9)), F.col("n")))).cast("long").alias("bound"))),
        "SELECT p_size, count(*) AS n, CAST(greatest(CASE WHEN count(*) >= 8 THEN 3 ELSE 2 END, least(ceil(round(count(*) * 0.07, 9)), count(*))) AS BIGINT) AS bound FROM part GROUP BY 1")
    add("GRF9", given("pages", _rivals_by_host), r"""WITH r AS (SELECT regexp_extract(url, '^[a-zA-Z]+://[^/]+/([a-z]{2})/', 1) AS site, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages)
        SELECT site, host, count(*) AS n FROM r WHERE site <> '' AND NOT contains(host, site || '.example') GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, host) <= 8""")
    add("SCR11", _link_relevance, f"""WITH {KEYWORDS}, {_TOKENS}, u AS (SELECT keyword, len(tokens) AS n, unnest(tokens) AS m FROM k)
        SELECT x.keyword AS a, y.keyword AS b, round(0.65 * count(*)::DOUBLE / (x.n + y.n - count(*)) + 0.35 * count(*) / sqrt(x.n * y.n), 3) AS score FROM u x JOIN u y ON x.m = y.m AND x.keyword < y.keyword GROUP BY x.keyword, y.keyword, x.n, y.n HAVING score >= 0.6""")
    add("SCR4", _architecture, f"""WITH {site.FACTS}, i AS (SELECT DISTINCT q FROM (SELECT p, q FROM links UNION ALL SELECT p, 0 FROM ok) WHERE p <> q), a AS (SELECT count(*) AS pages, avg(CASE WHEN p IN (SELECT q FROM i) THEN 1 ELSE 0 END) AS a, avg(CASE WHEN p IN (SELECT p FROM links WHERE p <> q) OR p % 21 = 0 OR p % 14 = 0 THEN 1 ELSE 0 END) AS b, avg(CASE WHEN p % 6 = 3 THEN 1 ELSE 0 END) AS c FROM ok)
        SELECT pages, round(a, 6) AS linked, round(b, 6) AS spokes, round(c, 6) AS crumbs, CAST(round(40 * a + 35 * b + 25 * c) AS INTEGER) AS score FROM a""")
    add("SCR5", over(_competitive), f"""WITH {_CAPTURES}, m AS (SELECT site, count(position) AS a, count(*) AS b, count(CASE WHEN position <= 15 THEN 1 END) AS c, sum(50 - coalesce(position, 50)) AS d FROM c GROUP BY 1)
        SELECT site, (SELECT CAST(m.a >= avg(a) AS INTEGER) + CAST(m.b >= avg(b) AS INTEGER) + CAST(m.c >= avg(c) AS INTEGER) + CAST(m.d >= avg(d) AS INTEGER) FROM m r WHERE r.site <> m.site) / 4 AS score FROM m""")
    add("SCR6", _freshness, f"WITH {_FRESH} SELECT p AS page_id, verdict FROM f")
    add("SCR7", lambda s, d: _freshness(s, d).agg(F.round(F.avg(F.col("verdict").isin("ok", "old-but-healthy").cast("int")), 6).alias("score"), F.count("*").alias("pages")), f"WITH {_FRESH} SELECT round(avg(CASE WHEN verdict IN ('ok', 'old-but-healthy') THEN 1 ELSE 0 END), 6) AS score, count(*) AS pages FROM f")
    add("ALR45", lambda s, d: _freshness(s, d).where("verdict = 'intent-drift'").select("page_id"), f"WITH {_FRESH} SELECT p AS page_id FROM f WHERE verdict = 'intent-drift'")
