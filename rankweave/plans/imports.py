"""Queries on imports and sinks. Exports are written from the given events and read back by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import documents, imports, site_checks
from rankweave.sources import shared, site, tables
from rankweave.sources.tables import table, twin

_CELLS = [("12", 12.0), (">100", None), ("100+", None), ("-", None), ("n/a", None), ("7.5", 7.5), ("101", None), ("#3", 3.0)]
_DAYS = ["2024-03-04", "2024/3/4", "4 Mar 2024", "Mar 4, 2024", "03/04/2024"]


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, at and line: the physical lines of an export a user, wide where user_id % 3 = 0, delimited by user_id % 4.
    Some quoted keywords go over two lines."""
    d = "element_at(array(',', ';', '\\t', '|'), cast(user_id % 4 + 1 as int))"
    cell = f"element_at({_array([c for c, _ in _CELLS])}, cast(event_id % 8 + 1 as int))"
    keyword = f"""CASE WHEN event_id % 5 = 0 THEN concat('"say ""', event_id % 40, '""', {d}, ' go"') WHEN event_id % 7 = 0 THEN concat('"kw ', event_id % 40, '\\n', {d}, 'more"') ELSE concat('kw ', event_id % 40) END"""
    events = table(spark, sf_dir, "events")
    quoted = lambda x: f"if({x} LIKE concat('%', {d}, '%'), concat('\"', {x}, '\"'), {x})"
    wide = f"concat_ws({d}, '﻿Keyword', '2024-01-05', {quoted("'Jan 6, 2024'")})"
    heads = events.select("user_id").distinct().selectExpr("user_id AS file", "-4L AS at", f"if(user_id % 3 = 0, {wide}, concat_ws({d}, 'Search_Term', 'Current Rank', 'Note', 'Check Date', 'Device', 'Market')) AS text")
    day = quoted(f"element_at({_array(_DAYS)}, cast(event_id % 5 + 1 as int))")
    long_ = f"concat_ws({d}, {keyword}, {cell}, 'x', {day}, if(event_id % 2 = 0, 'Mobile', ''), if(event_id % 3 = 0, 'Leeds', ''))"
    body = events.selectExpr("user_id AS file", "event_id * 4 AS at", f"if(user_id % 3 = 0, concat_ws({d}, {keyword}, {cell}, '5'), {long_}) AS text")
    return heads.union(body).select("file", "at", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("file", (F.col("at") + F.col("k")).alias("at"), "line")


_D = "[',', ';', chr(9), '|'][user_id % 4 + 1]"
_KEYWORD = f"""CASE WHEN event_id % 5 = 0 THEN 'say "' || (event_id % 40) || '"' || {_D} || ' go' WHEN event_id % 7 = 0 THEN 'kw ' || (event_id % 40) || chr(10) || {_D} || 'more' ELSE 'kw ' || (event_id % 40) END"""
_CELL = "[" + ", ".join(f"'{c}'" for c, _ in _CELLS) + "][event_id % 8 + 1]"
_RANK = "[" + ", ".join("NULL" if r is None else str(r) for _, r in _CELLS) + "][event_id % 8 + 1]"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.delimited(_lines(spark, sf_dir))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and xml: a feed a source of the documents' openings, fifty ids each."""
    entry = "concat('<item><title>', regexp_replace(coalesce(text, ''), '[&<>]', ' '), '</title><link>https://n.example/', doc_id, '</link><pubDate>2024-02-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'), '</pubDate></item>')"
    return table(spark, sf_dir, "documents").selectExpr("doc_id div 50 AS file", f"{entry} AS e").groupBy("file").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("e"), ""), F.lit("</channel></rss>")).alias("xml"))


def _items(feeds: DataFrame) -> DataFrame:
    from rankweave.operators.content import all_matches

    part = lambda name: F.regexp_extract("i", rf"(?is)<{name}>\s*(.*?)\s*</{name}>", 1)
    return feeds.select(F.explode(all_matches(F.col("xml"), r"(?is)<item>.*?</item>")).alias("i")).select(part("link").alias("url"), part("title").alias("title"), part("pubDate").try_cast("date").alias("published"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and a lead's fields after coercion: the first alias that isn't blank, a number from a display
    string, a day that is not in the future."""
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", """to_json(struct(if(o_orderkey % 3 = 0, '  ', concat('/p', o_orderkey % 9)) AS landing_page, concat('/q', o_orderkey % 9) AS url, concat('$', format_number(o_totalprice, 2), ' USD') AS amount,
            if(o_orderkey % 4 = 0, 'not a day', if(o_orderkey % 4 = 1, '2999-01-01', cast(cast(o_orderdate as date) as string))) AS created_at, if(o_orderkey % 5 = 0, 'WON', 'odd') AS status)) AS payload""")  # fmt: skip
    field = lambda k: F.get_json_object("payload", f"$.{k}")
    pick = lambda *names: F.coalesce(*(F.when(F.trim(field(n)) != "", F.trim(field(n))) for n in names))
    now = F.lit("2000-01-01").cast("date")
    day = pick("occurred_at", "created_at", "date").try_cast("date")
    status = F.lower(pick("status"))
    return raw.select(
        "o_orderkey", pick("landing_page", "landingPage", "page", "url").alias("page"), F.regexp_replace(pick("value", "amount"), r"[^0-9.\-]", "").try_cast("double").alias("value"),
        F.when(day <= now, day).otherwise(now).alias("day"), F.when(status.isin("new", "qualified", "won", "lost"), status).otherwise("new").alias("status"),
    )


def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url and tier of 60 pages to inspect: broken ones, then orphans, then those with most links; first tier wins."""
    r = documents.read(site.crawl(spark, sf_dir))
    broken = r.where("status = 404").select("url", "page_id", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("n"))
    alone = site_checks.orphans(documents.entries(site.sitemaps(spark, sf_dir)), r).select("url", "page_id", F.lit(2).alias("tier"), F.lit(0).cast("long").alias("n"))
    linked = r.join(site_checks.inbound(r), F.col("url") == F.col("target")).select("url", "page_id", F.lit(3).alias("tier"), F.col("sources").alias("n"))
    every = broken.union(alone).union(linked).groupBy("url", "page_id").agg(F.min("tier").alias("tier"), F.max("n").alias("n"))
    return every.orderBy("tier", F.desc("n"), "page_id").limit(60).select("url", "tier")


def _windows(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_returnflag").alias("brand"), F.year("l_shipdate").alias("period"), F.col("l_suppkey").alias("page")).agg(F.sum(F.col("l_quantity").cast("long")).alias("clicks"))


def _snapshots(lines: DataFrame) -> DataFrame:
    """Snapshots of all periods, of which brand A's last one comes again, larger: only it is replaced."""
    all_ = _windows(lines)
    again = all_.where("brand = 'A' AND period = 1998").withColumn("clicks", F.col("clicks") + 1)
    return imports.replaced(all_, again, ["brand", "period"]).groupBy("brand", "period").agg(F.count("*").alias("pages"), F.sum("clicks").alias("clicks"))


def _runs(events: DataFrame) -> DataFrame:
    """Runs of each day with their findings and measures, written as three tables by run and read back."""
    run = F.to_date("ts").alias("run")
    findings = events.where("value > 50").select(run, F.col("event_id").alias("finding"))
    measures = events.groupBy(run, "event_type").agg(F.count("*").alias("n"))
    heads = events.groupBy(run).agg(F.count("*").alias("events"))
    kept = [imports.replaced(t, t.where("run = DATE '2024-01-02'"), ["run"]) for t in (heads, findings, measures)]
    found = kept[1].groupBy("run").agg(F.count("*").alias("findings"))
    return kept[0].join(found, "run", "left").join(kept[2].groupBy("run").agg(F.count("*").alias("measures")), "run").select("run", "events", F.coalesce("findings", F.lit(0)).alias("findings"), "measures")


def register(add: Callable, given: Callable) -> None:
    """Adds this module's queries."""
    heads = "CASE WHEN user_id % 3 = 0 THEN 'Keyword¦2024-01-05¦Jan 6, 2024' ELSE 'Search_Term¦Current Rank¦Note¦Check Date¦Device¦Market' END"
    day = f"{_DAYS}[event_id % 5 + 1]"
    device, market = "CASE WHEN event_id % 2 = 0 THEN 'Mobile' ELSE '' END", "CASE WHEN event_id % 3 = 0 THEN 'Leeds' ELSE '' END"
    add("SRC17", lambda s, d: _rows(s, d).select("file", "at", F.array_join("cells", "¦").alias("cells")), f"""SELECT DISTINCT user_id AS file, -4 AS "at", {heads} AS cells FROM events UNION ALL SELECT user_id, event_id * 4,
        {_KEYWORD} || '¦' || {_CELL} || CASE WHEN user_id % 3 = 0 THEN '¦5' ELSE '¦x¦' || {day} || '¦' || {device} || '¦' || {market} END FROM events""")
    add("SRC18", lambda s, d: imports.headers(_rows(s, d)).select("file", "k", "name", "field", "day"), """WITH f AS (SELECT DISTINCT user_id AS file FROM events), h AS (SELECT file, unnest(CASE WHEN file % 3 = 0
        THEN [{'k': 0, 'name': 'Keyword', 'field': 'keyword', 'day': NULL}, {'k': 1, 'name': '2024-01-05', 'field': NULL, 'day': '2024-01-05'}, {'k': 2, 'name': 'Jan 6, 2024', 'field': NULL, 'day': '2024-01-06'}]
        ELSE [{'k': 0, 'name': 'Search_Term', 'field': 'keyword', 'day': NULL}, {'k': 1, 'name': 'Current Rank', 'field': 'position', 'day': NULL}, {'k': 2, 'name': 'Note', 'field': NULL, 'day': NULL}, {'k': 3, 'name': 'Check Date', 'field': 'captured_on', 'day': NULL},
            {'k': 4, 'name': 'Device', 'field': 'device', 'day': NULL}, {'k': 5, 'name': 'Market', 'field': 'location', 'day': NULL}] END) AS x FROM f)
        SELECT file, CAST(x.k AS INTEGER) AS k, x.name AS name, x.field AS field, CAST(x.day AS DATE) AS day FROM h""")
    add("SRC19", lambda s, d: imports.ranks(_rows(s, d)), f"""WITH e AS (SELECT user_id AS file, event_id, {_KEYWORD} AS keyword, {_RANK} AS rank, lower({device}) AS device, coalesce(nullif({market}, ''), 'default') AS location FROM events),
        x AS (SELECT file, event_id, keyword, DATE '2024-01-05' AS captured_on, 'default' AS location, '' AS device, rank FROM e WHERE file % 3 = 0 UNION ALL SELECT file, event_id, keyword, DATE '2024-01-06', 'default', '', 5 FROM e WHERE file % 3 = 0
            UNION ALL SELECT file, event_id, keyword, DATE '2024-03-04', location, device, rank FROM e WHERE file % 3 <> 0 AND event_id % 5 <> 4)
        SELECT file, keyword, captured_on, location, device, '' AS engine, CAST(rank AS DOUBLE) AS position FROM x QUALIFY row_number() OVER (PARTITION BY file, keyword, captured_on, location, device ORDER BY event_id DESC) = 1""")
    add("STR19", given("events", lambda e: e.selectExpr("event_id", f"element_at({_array([c for c, _ in _CELLS])}, cast(event_id % 8 + 1 as int)) AS cell", f"element_at({_array(_DAYS)}, cast(event_id % 5 + 1 as int)) AS day").select("event_id", imports.as_position(F.col("cell")).alias("position"), imports.as_date(F.col("day")).alias("day"))),
        f"SELECT event_id, CAST({_RANK} AS DOUBLE) AS position, CASE WHEN event_id % 5 < 4 THEN DATE '2024-03-04' END AS day FROM events")
    add("STR20", _payloads, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/q' || (o_orderkey % 9) ELSE '/p' || (o_orderkey % 9) END AS page, round(o_totalprice, 2) AS value,
        CASE WHEN o_orderkey % 4 > 1 AND CAST(o_orderdate AS DATE) <= DATE '2000-01-01' THEN CAST(o_orderdate AS DATE) ELSE DATE '2000-01-01' END AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'won' ELSE 'new' END AS status FROM orders""")
    add("SRC20", given("part", lambda p: p.select(F.trim("p_name").alias("keyword"), "p_partkey").unionByName(p.select(F.upper("p_name").alias("keyword"), "p_partkey")).groupBy(F.lower("keyword").alias("k")).agg(F.min_by("keyword", F.struct("p_partkey", "keyword")).alias("keyword"), F.count("*").alias("n")).select("keyword", "n")),
        "SELECT arg_min(w, (p_partkey, w)) AS keyword, count(*) AS n FROM (SELECT trim(p_name) AS w, p_partkey FROM part UNION ALL SELECT upper(p_name), p_partkey FROM part) GROUP BY lower(w)")
    merged = lambda p: p.select(F.regexp_replace(F.lower("url"), r"([?#].*|/+)$", "").alias("u"), "page_id").groupBy("u").agg(F.count("*").alias("rows"), F.sum(F.col("page_id") + 1).alias("impressions"), (F.sum((F.col("page_id") + 1) * (F.col("page_id") % 50 + 1)) / F.sum(F.col("page_id") + 1)).alias("position"))
    add("SRC21", given("pages", lambda p: merged(p).withColumn("matched", F.col("u").rlike(r"/en/"))), "SELECT regexp_replace(lower(url), '([?#].*|/+)$', '') AS u, count(*) AS rows, CAST(sum(page_id + 1) AS BIGINT) AS impressions, sum((page_id + 1) * (page_id % 50 + 1))::DOUBLE / sum(page_id + 1) AS position, contains(regexp_replace(lower(url), '([?#].*|/+)$', ''), '/en/') AS matched FROM pages GROUP BY 1")
    add("SRC22", given("part", lambda p: imports.facets(p, ["p_type", "p_brand", "p_size"])), """WITH c AS (SELECT 'p_type' AS name, p_type AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part), n AS (SELECT name, value, count(*) AS rows FROM c GROUP BY ALL)
        SELECT * FROM n WHERE name IN (SELECT name FROM n GROUP BY name HAVING count(*) BETWEEN 2 AND 12)""")
    audits = lambda e: e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", F.col("event_type").alias("id"), F.col("value").cast("int").alias("failed"))).alias("findings"))).alias("doc"))
    add("SRC23", given("events", lambda e: audits(e).select("user_id", F.explode(F.from_json("doc", "findings array<struct<id string, failed int>>")["findings"]).alias("f")).groupBy("user_id", "f.id").agg(F.sum("f.failed").alias("failed"), F.count("*").alias("n"))), """
        SELECT user_id, event_type AS id, CAST(sum(CAST(trunc(value) AS INTEGER)) AS BIGINT) AS failed, count(*) AS n FROM events GROUP BY ALL""")
    add("SRC28", lambda s, d: _items(_feed(s, d)), "SELECT 'https://n.example/' || doc_id AS url, trim(regexp_replace(coalesce(text, ''), '[&<>]', ' ', 'g'), ' ' || chr(9) || chr(10)) AS title, DATE '2024-02-01' + CAST(doc_id % 28 AS INTEGER) AS published FROM documents")
    add("SRC32", given("events", lambda e: e.select("event_id", F.to_json(F.struct(F.struct((F.col("value") / 1000).alias("score")).alias("performance"), F.struct(F.struct((F.col("value") * 40).alias("numericValue")).alias("lcp")).alias("audits"))).alias("doc")).select("event_id", F.round(F.get_json_object("doc", "$.performance.score").cast("double"), 6).alias("score"), F.round(F.get_json_object("doc", "$.audits.lcp.numericValue").cast("double"), 6).alias("lcp"))),
        "SELECT event_id, round(value / 1000, 6) AS score, round(value * 40, 6) AS lcp FROM events")
    add("SRC14", _inspected, f"""WITH {site.FACTS}, i AS (SELECT q, count(DISTINCT p) AS sources FROM (SELECT p, q FROM links UNION ALL SELECT p, 0 FROM ok) WHERE p <> q GROUP BY q),
        x AS (SELECT url, p, 1 AS tier, 0 AS n FROM site WHERE status = 404 UNION ALL SELECT url, p, 2, 0 FROM ok WHERE p % 5 <> 4 AND p NOT IN (SELECT q FROM i) UNION ALL SELECT url, p, 3, sources FROM site JOIN i ON i.q = p), y AS (SELECT url, p, min(tier) AS tier, max(n) AS n FROM x GROUP BY ALL)
        SELECT url, CAST(tier AS INTEGER) AS tier FROM y ORDER BY tier, n DESC, p LIMIT 60""")
    add("SRC5", given("lineitem", _snapshots), """SELECT brand, period, count(*) AS pages, CAST(sum(clicks) + CASE WHEN brand = 'A' AND period = 1998 THEN count(*) ELSE 0 END AS BIGINT) AS clicks
        FROM (SELECT l_returnflag AS brand, year(l_shipdate) AS period, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks FROM lineitem GROUP BY ALL) GROUP BY brand, period""")
    add("SRC7", lambda s, d: imports.replaced(documents.entries(site.sitemaps(s, d)).selectExpr("file % 3 AS brand", "loc"), documents.entries(site.sitemaps(s, d)).selectExpr("file % 3 AS brand", "loc").where("brand = 1"), ["brand"]).groupBy("brand").agg(F.count("*").alias("submitted")),
        "SELECT page_id // 50 % 3 AS brand, count(*) + count(CASE WHEN page_id % 40 = 0 THEN 1 END) AS submitted FROM pages WHERE page_id % 5 <> 4 GROUP BY 1")
    add("SRC34", given("events", _runs), "SELECT CAST(ts AS DATE) AS run, count(*) AS events, count(CASE WHEN value > 50 THEN 1 END) AS findings, count(DISTINCT event_type) AS measures FROM events GROUP BY 1")
    months = lambda m: m.groupBy("brand", "entity").pivot("month", [1, 2, 3]).agg(F.sum("clicks"))
    add("SRC33", lambda s, d: imports.written_csv(months(tables.long_daily(s, d).where("year(date) = 1997").withColumn("month", F.month("date"))).selectExpr("brand", "entity", "`1` AS jan", "`2` AS feb", "`3` AS mar")),
        twin("SELECT brand, entity, CAST(sum(CASE WHEN month(date) = 1 THEN clicks END) AS BIGINT) AS jan, CAST(sum(CASE WHEN month(date) = 2 THEN clicks END) AS BIGINT) AS feb, CAST(sum(CASE WHEN month(date) = 3 THEN clicks END) AS BIGINT) AS mar FROM long_daily WHERE year(date) = 1997 GROUP BY ALL", "long_daily"))
    add("SRC35", lambda s, d: tables.metric_daily(s, d).groupBy("brand").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")).select("brand", F.to_json(F.struct("clicks", "impressions")).alias("snapshot")),
        twin("SELECT brand, '{\"clicks\":' || CAST(sum(clicks) AS BIGINT) || ',\"impressions\":' || CAST(sum(impressions) AS BIGINT) || '}' AS snapshot FROM metric GROUP BY brand", "metric"))
    add("SRC6", lambda s, d: tables.metric_daily(s, d).groupBy("brand").agg(F.max("date").alias("date"), F.sum("clicks").alias("clicks"), F.countDistinct("entity").alias("kinds")), twin("SELECT brand, max(date) AS date, CAST(sum(clicks) AS BIGINT) AS clicks, count(DISTINCT entity) AS kinds FROM metric GROUP BY brand", "metric"))
    def upserts(key: str) -> tuple[Callable, str]:
        """Visits by day and a dimension, stored by a load and by a second one that overlaps and is run twice."""
        def run(s: SparkSession, d: str) -> DataFrame:
            v = tables.visits_daily(s, d).withColumn("synced", F.lit(1))
            again = v.where("entity % 2 = 0").withColumn("sessions", F.col("sessions") + 1).withColumn("synced", F.lit(2))
            stored = imports.Upserts(v.schema, ["brand", "date", "entity"], ["synced"], shared.folder(s)).load(v).load(again).load(again)
            return stored.read(s).groupBy(key).agg(F.count("*").alias("rows"), F.sum("sessions").alias("sessions"), F.sum("conversions").alias("conversions"))

        return run, twin(f"SELECT {key}, count(*) AS rows, CAST(sum(sessions + CASE WHEN entity % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS sessions, CAST(sum(conversions) AS BIGINT) AS conversions FROM visits GROUP BY {key}", "visits")

    add("SRC8", *upserts("date"))
    add("SRC10", *upserts("brand"))


    def cohorts(s: SparkSession, d: str) -> DataFrame:
        seen = table(s, d, "events").select("user_id", (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("week")).distinct()
        firsts = seen.groupBy("user_id").agg(F.min("week").alias("cohort"))
        counted = seen.join(firsts, "user_id").groupBy("cohort", (F.col("week") - F.col("cohort")).alias("index")).agg(F.count("*").alias("active"))
        return counted.groupBy("cohort").pivot("index", [0, 1, 2, 3]).agg(F.first("active")).selectExpr("cohort", "`0` AS w0", "`1` AS w1", "`2` AS w2", "`3` AS w3").orderBy(F.desc("cohort")).limit(8)

    cohort_sql = """WITH s AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INTEGER) AS week FROM events), f AS (SELECT user_id, min(week) AS cohort FROM s GROUP BY 1), c AS (SELECT cohort, week - cohort AS i, count(*) AS n FROM s JOIN f USING (user_id) GROUP BY ALL)
        SELECT cohort, CAST(sum(n) FILTER (i = 0) AS BIGINT) AS w0, CAST(sum(n) FILTER (i = 1) AS BIGINT) AS w1, CAST(sum(n) FILTER (i = 2) AS BIGINT) AS w2, CAST(sum(n) FILTER (i = 3) AS BIGINT) AS w3 FROM c GROUP BY cohort ORDER BY cohort DESC LIMIT 8"""
    add("SRC9", cohorts, cohort_sql)
    add("WIN10", cohorts, cohort_sql)
    def probe_log(s: SparkSession, d: str) -> DataFrame:
        """Probes appended in two loads, errors as rows, read back and counted by day."""
        e, path = table(s, d, "events"), shared.folder(s)
        rows = e.select(F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", "failed").otherwise("fine").alias("outcome"), "value")
        for half in ("day < DATE '2024-01-16'", "day >= DATE '2024-01-16'"):
            rows.where(half).write.mode("append").parquet(path)
        return s.read.schema(rows.schema).parquet(path).groupBy("day", "outcome").agg(F.count("*").alias("probes"))

    add("SRC12", probe_log, "SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'fine' END AS outcome, count(*) AS probes FROM events GROUP BY ALL")
