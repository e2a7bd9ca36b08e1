"""Roll-ups, latest rows, set operations, look-ups and scores. Loaded by the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.safe import ratio_null
from rankweave.operators import content, imports, performance
from rankweave.sources import shared, tables
from rankweave.sources.tables import table, twin


def _newest(rows: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= k)


def anchor_texts(pages: DataFrame, k: int = 40) -> DataFrame:
    """The most frequent link texts of at most 70 characters, with their number of targets and the first three."""
    html, link = F.coalesce("html", F.lit("")), r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    pairs = pages.select(F.explode(F.arrays_zip(content.all_matches(html, link, 1).alias("href"), content.all_matches(html, link, 2).alias("label"))).alias("x"))
    counted = pairs.select(F.lower(F.trim("x.label")).alias("label"), "x.href").where(F.length("label").between(1, 70)).groupBy("label", "href").agg(F.count("*").alias("n"))
    top = counted.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("targets")).where("n >= 2").orderBy(F.desc("n"), "label").limit(k)
    first = _newest(counted, ["label"], 3, F.col("href")).groupBy("label").agg(F.array_join(F.sort_array(F.collect_list("href")), " | ").alias("first_targets"))
    return top.join(first, "label")


def heading_faults(pages: DataFrame) -> DataFrame:
    """Headings of each page, levels skipped between neighbours, and neighbours of one level."""
    levels = F.transform(content.all_matches(F.coalesce("html", F.lit("")), r"(?i)<h([1-6])[\s>]", 1), lambda x: x.cast("int"))
    steps = F.when(F.size("levels") >= 2, F.zip_with(F.slice("levels", 2, F.size("levels") - 1), F.slice("levels", 1, F.size("levels") - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<int>"))
    found = pages.select("page_id", levels.alias("levels")).select("page_id", "levels", steps.alias("steps"))
    return found.select("page_id", F.size("levels").cast("long").alias("headings"), F.size(F.filter("steps", lambda x: x > 1)).cast("long").alias("skipped"), F.size(F.filter("steps", lambda x: x == 0)).cast("long").alias("level_repeats"))


def supported_rate(metric: DataFrame, least: int) -> DataFrame:
    """Each entity's click rate against the whole site's, between 0.5 and 2; null below `least` impressions."""
    own = metric.groupBy("entity").agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i"))
    site = own.agg(F.sum("c").alias("sc"), F.sum("i").alias("si"))  # one row
    rate = (F.col("c") / F.col("i")) / (F.col("sc") / F.col("si"))
    return own.crossJoin(F.broadcast(site)).select("entity", "i", F.when(F.col("i") >= least, F.greatest(F.lit(0.5), F.least(F.lit(2.0), rate))).alias("multiplier"))


def halves(events: DataFrame) -> DataFrame:
    """Jaccard of each user's event types before and since the 16th, by both rules for two empty sets."""
    sets = events.groupBy("user_id").agg(F.collect_set(F.when(F.dayofmonth("ts") < 16, F.col("event_type"))).alias("a"), F.collect_set(F.when((F.dayofmonth("ts") >= 16) & (F.col("value") > 100), F.col("event_type"))).alias("b"))
    shared, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return sets.select("user_id", F.coalesce(ratio_null(shared, either), F.lit(1.0)).alias("empty_is_one"), F.coalesce(ratio_null(shared, either), F.lit(0.0)).alias("empty_is_zero"), ratio_null(shared, F.least(F.size("a"), F.size("b"))).alias("overlap"))


_HITS = "event_type, user_id, count(*) AS hits, CAST(min(ts) AS DATE) AS first_seen, CAST(max(ts) AS DATE) AS last_seen, last(event_id ORDER BY ts, event_id) AS last_id FROM events GROUP BY event_type, user_id"


def register(add: Callable, over: Callable, given: Callable, compared: Callable[[str, int], str]) -> None:
    """Adds this module's queries."""
    # Roll-ups.
    add("AGG15", given("events", lambda e: e.groupBy("event_type", "user_id").agg(F.count("*").alias("hits"), F.to_date(F.min("ts")).alias("first_seen"), F.to_date(F.max("ts")).alias("last_seen"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))), f"SELECT {_HITS}")
    add("AGG16", given("events", lambda e: e.groupBy("event_type").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("hits"), ratio_null(F.count_if(F.col("value") > 100), F.count("*")).alias("slow_share"))),
        "SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS hits, count(CASE WHEN value > 100 THEN 1 END)::DOUBLE / count(*) AS slow_share FROM events GROUP BY event_type")
    add("AGG18", over(tables.leads, lambda x: x.groupBy("status", "channel").agg(F.count_distinct("person").alias("people"), F.max("day").alias("last_day"))), twin("SELECT status, channel, count(DISTINCT person) AS people, max(day) AS last_day FROM leads GROUP BY status, channel", "leads"))
    add("AGG21", over(tables.query_page, lambda q: q.groupBy("page").agg(F.sum("impressions").alias("impressions"), ratio_null(F.sum(F.when(F.col("position") <= 3, F.col("impressions")).otherwise(0)), F.sum("impressions")).alias("share"))),
        twin("SELECT page, CAST(sum(impressions) AS BIGINT) AS impressions, sum(CASE WHEN position <= 3 THEN impressions ELSE 0 END)::DOUBLE / nullif(sum(impressions), 0) AS share FROM query_page GROUP BY page", "query_page"))
    add("AGG22", over(tables.metric_daily, lambda m: supported_rate(m, 200_000)), twin("""WITH o AS (SELECT entity, CAST(sum(clicks) AS BIGINT) AS c, CAST(sum(impressions) AS BIGINT) AS i FROM metric GROUP BY entity), s AS (SELECT sum(c) AS sc, sum(i) AS si FROM o)
        SELECT entity, i, CASE WHEN i >= 200000 THEN greatest(0.5, least(2.0, (c::DOUBLE / i) / (sc::DOUBLE / si))) END AS multiplier FROM o, s""", "metric"))  # fmt: skip
    add("AGG23", over(tables.metric_daily, lambda m: performance.compare(m, ["brand", "entity"], 7).select("brand", "entity", "rc", "pc", ratio_null(F.col("rc"), F.col("pc")).alias("ratio"))), twin(f"WITH {compared('brand, entity', 7)} SELECT brand, entity, rc, pc, rc::DOUBLE / nullif(pc, 0) AS ratio FROM c", "metric"))
    add("AGG24", given("documents", lambda d: d.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("lang"))).select("lang", "source", "n", (F.floor(F.col("n") * 1000 / F.col("total") + 0.5) / 10).alias("percent"))),
        "SELECT lang, source, count(*) AS n, floor(count(*) * 1000 / CAST(sum(count(*)) OVER (PARTITION BY lang) AS BIGINT) + 0.5) / 10 AS percent FROM documents GROUP BY lang, source")
    add("AGG26", over(tables.leads, lambda x: x.groupBy("channel").agg(F.count("*").alias("total"), F.count_distinct("person").alias("people"), F.count_distinct("day").alias("active_days"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("states"))),
        twin("SELECT channel, count(*) AS total, count(DISTINCT person) AS people, count(DISTINCT day) AS active_days, array_to_string(list_sort(list(DISTINCT status)), ',') AS states FROM leads GROUP BY channel", "leads"))
    by_day = lambda x: x.groupBy("person", "day").agg(F.count("*").alias("n")).groupBy("person").agg(F.sum("n").alias("dated"), F.count("*").alias("days"), F.max("n").alias("most"))
    add("AGG27", over(tables.leads, lambda x: by_day(x).select("person", "dated", "days", ((F.col("dated") >= 5) & ~((2 * F.col("most") > F.col("dated")) & (F.col("days") < 8))).alias("usable"))),
        twin("WITH d AS (SELECT person, day, count(*) AS n FROM leads GROUP BY 1, 2), p AS (SELECT person, CAST(sum(n) AS BIGINT) AS dated, count(*) AS days, max(n) AS most FROM d GROUP BY 1) SELECT person, dated, days, dated >= 5 AND NOT (2 * most > dated AND days < 8) AS usable FROM p", "leads"))
    add("AGG29", given("pages", anchor_texts), r"""WITH x AS (SELECT unnest(regexp_extract_all(coalesce(html, ''), '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(coalesce(html, ''), '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS label FROM pages),
        c AS (SELECT lower(trim(label)) AS label, href, count(*) AS n FROM x WHERE length(lower(trim(label))) BETWEEN 1 AND 70 GROUP BY 1, 2)
        SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS targets, array_to_string(list_sort(list(href))[1:3], ' | ') AS first_targets FROM c GROUP BY label HAVING sum(n) >= 2 ORDER BY n DESC, label LIMIT 40""")  # fmt: skip
    add("AGG40", given("orders", lambda o: o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))), "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY o_orderstatus")

    # Latest rows, sorts and pages.
    runs = lambda o: _newest(o.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], 2, F.desc("o_orderkey"))
    add("WIN4", given("orders", lambda o: runs(o).groupBy("o_custkey").agg(F.max(F.when(F.col("k") == 1, F.col("o_orderkey"))).alias("latest"), F.max(F.when(F.col("k") == 2, F.col("o_orderkey"))).alias("previous"))),
        "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT o_custkey, max(CASE WHEN k = 1 THEN o_orderkey END) AS latest, max(CASE WHEN k = 2 THEN o_orderkey END) AS previous FROM n WHERE k <= 2 GROUP BY o_custkey")
    def loads(o: DataFrame) -> DataFrame:
        """The newest order of each customer and status, stored by a load of each half of the days; the second one is run twice."""
        rows = o.select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
        early, late = rows.where("o_orderdate < DATE '1995-01-01'"), rows.where("o_orderdate >= DATE '1995-01-01'")
        stored = imports.Upserts(rows.schema, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], shared.folder(o.sparkSession)).load(early).load(late).load(late)
        return stored.read(o.sparkSession).select("o_custkey", "o_orderstatus", "o_orderkey")

    add("SRC4", given("orders", loads),
        "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
    add("SRC11", over(tables.leads, lambda x: x.groupBy("channel", "status").agg(F.count("*").alias("leads"), F.sum("value").alias("value")).unpivot(["channel", "status"], ["leads", "value"], "metric", "amount")),
        twin("WITH s AS (SELECT channel, status, count(*) AS n, CAST(sum(value) AS BIGINT) AS v FROM leads GROUP BY 1, 2) SELECT channel, status, 'leads' AS metric, n AS amount FROM s UNION ALL SELECT channel, status, 'value', v FROM s", "leads"))
    add("WIN14", given("pages", heading_faults), r"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<h([1-6])[\s>]', 1), lambda x: CAST(x AS INTEGER)) AS v FROM pages)
        SELECT page_id, len(v) AS headings, len(list_filter(generate_series(2, len(v)), lambda i: v[i] - v[i - 1] > 1)) AS skipped, len(list_filter(generate_series(2, len(v)), lambda i: v[i] = v[i - 1])) AS level_repeats FROM l""")  # fmt: skip
    add("TOP2", over(tables.rank_positions, lambda r: r.orderBy(F.coalesce("position", F.lit(101)), "keyword", "captured_on").limit(40).select("keyword", "captured_on", "position")), twin("SELECT keyword, captured_on, position FROM ranks ORDER BY coalesce(position, 101), keyword, captured_on LIMIT 40", "ranks"))
    add("TOP7", given("customer", lambda c: c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(50).select("c_custkey", "c_acctbal")), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 50")
    add("TOP8", given("orders", lambda o: o.orderBy(F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2), "o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus", "o_orderpriority")),
        "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 100")

    # Sets and look-ups.
    add("SET3", given("events", halves), """WITH s AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (day(ts) < 16), []) AS a, coalesce(list(DISTINCT event_type) FILTER (day(ts) >= 16 AND value > 100), []) AS b FROM events GROUP BY user_id),
        n AS (SELECT user_id, len(list_intersect(a, b)) AS x, len(list_distinct(list_concat(a, b))) AS u, least(len(a), len(b)) AS m FROM s)
        SELECT user_id, coalesce(x::DOUBLE / nullif(u, 0), 1.0) AS empty_is_one, coalesce(x::DOUBLE / nullif(u, 0), 0.0) AS empty_is_zero, x::DOUBLE / nullif(m, 0) AS overlap FROM n""")  # fmt: skip
    add("SET4", given("part", lambda p: p.groupBy(F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("first"), F.min_by("p_name", "p_partkey").alias("name"))), "SELECT lower(p_name) AS key, min(p_partkey) AS first, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1")

    def new_errors(spark, sf_dir):
        days = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day"))
        return days.crossJoin(F.broadcast(days.agg(F.max("day").alias("hi")))).groupBy("user_id").agg(F.max((F.col("day") == F.col("hi"))).alias("now"), F.max(F.col("day") == F.date_sub("hi", 1)).alias("before")).where("now AND NOT before").select("user_id")

    add("SET5", new_errors, "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'), h AS (SELECT max(day) AS hi FROM d) SELECT user_id FROM d, h WHERE day = hi EXCEPT SELECT user_id FROM d, h WHERE day = hi - 1")

    def three_sources(spark, sf_dir):
        e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("hits"))
        o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders"))
        s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("lines"))
        return e.join(o, "key", "full_outer").join(s, "key", "full_outer")

    add("JOIN4", three_sources, """WITH e AS (SELECT user_id AS key, count(*) AS hits FROM events GROUP BY 1), o AS (SELECT o_custkey AS key, count(*) AS orders FROM orders GROUP BY 1), s AS (SELECT l_suppkey AS key, count(*) AS lines FROM lineitem GROUP BY 1)
        SELECT * FROM e FULL JOIN o USING (key) FULL JOIN s USING (key)""")  # fmt: skip
    add("JOIN6", lambda s, d: table(s, d, "customer").select("c_custkey").join(table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("opened")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("opened", F.lit(0)).alias("opened")),
        "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS opened FROM customer")

    def ladder(spark, sf_dir):
        seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("v1"))
        paid = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v2"))
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
        met = c.join(seen, c["c_custkey"] == seen["user_id"], "left").join(paid, c["c_custkey"] == paid["o_custkey"], "left")
        return met.select("c_custkey", F.coalesce("v1", "v2", "c_acctbal").alias("value"), F.when(F.col("v1").isNotNull(), "measured").when(F.col("v2").isNotNull(), "paid").otherwise("stated").alias("basis"))

    add("JOIN22", ladder, """WITH e AS (SELECT user_id, max(value) AS v1 FROM events GROUP BY 1), o AS (SELECT o_custkey, max(o_totalprice) AS v2 FROM orders GROUP BY 1)
        SELECT c_custkey, coalesce(v1, v2, c_acctbal) AS value, CASE WHEN v1 IS NOT NULL THEN 'measured' WHEN v2 IS NOT NULL THEN 'paid' ELSE 'stated' END AS basis FROM customer LEFT JOIN e ON c_custkey = user_id LEFT JOIN o ON c_custkey = o_custkey""")  # fmt: skip
    add("FLT9", given("part", lambda p: p.where((F.coalesce("p_retailprice", F.lit(0.0)) >= 950) & (F.coalesce("p_size", F.lit(0)) <= 40) & (F.size(F.split("p_name", " ")) >= 2) & ~F.lower("p_name").contains("xyz")).select("p_partkey", "p_name")),
        "SELECT p_partkey, p_name FROM part WHERE coalesce(p_retailprice, 0) >= 950 AND coalesce(p_size, 0) <= 40 AND len(string_split(p_name, ' ')) >= 2 AND NOT contains(lower(p_name), 'xyz')")

    # Scores.
    add("SCR9", over(tables.rank_positions, lambda r: r.groupBy("captured_on").agg(F.when(F.count("position") > 0, F.least(F.lit(100), 4 * F.count_if(F.col("position").between(4, 20)) + 2 * F.count_if(F.col("position") <= 3))).cast("long").alias("score"))),
        twin("SELECT captured_on, CASE WHEN count(position) > 0 THEN least(100, 4 * count(CASE WHEN position BETWEEN 4 AND 20 THEN 1 END) + 2 * count(CASE WHEN position <= 3 THEN 1 END)) END AS score FROM ranks GROUP BY captured_on", "ranks"))
