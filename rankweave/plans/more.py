"""Further queries: filters, joins, set operations, sorts, streaming. Loaded by the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from rankweave.functions.safe import delta_pct, lead_pct
from rankweave.operators import matching, performance, series
from rankweave.sources import tables
from rankweave.sources.tables import table, twin
from rankweave.streaming import counters


def register(add: Callable, over: Callable, given: Callable) -> None:
    """Adds this module's queries."""
    # Filters.
    add("FLT5", given("events", lambda e: e.select("event_id", "event_type", (F.col("event_type") == "purchase").alias("good")).orderBy("good", F.desc("event_id")).offset(20).limit(50)),
        "SELECT event_id, event_type, event_type = 'purchase' AS good FROM events ORDER BY good, event_id DESC LIMIT 50 OFFSET 20")
    add("FLT6", given("customer", lambda c: c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").ilike("%customer#%7%") & (F.col("c_acctbal") > 0)).select("c_custkey", "c_name", "c_mktsegment")),
        "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name ILIKE '%customer#%7%' AND c_acctbal > 0")
    add("FLT10", given("pages", lambda p: p.select("page_id", F.coalesce("url", F.lit("")).rlike(r"(?i)\.(css|js|png|jpe?g|gif|svg|woff2?|ico)(\?|$)").alias("static"))),
        r"SELECT page_id, regexp_matches(coalesce(url, ''), '(?i)\.(css|js|png|jpe?g|gif|svg|woff2?|ico)(\?|$)') AS static FROM pages")
    add("FLT15", given("pages", lambda p: p.select("page_id", F.when(F.col("url").rlike(r"(?i)/(feed|rss)(/|$)"), "feed").when(F.col("url").rlike(r"[?&](q|s|search)="), "search").when(F.col("url").rlike(r"([?&]page=|/page/)\d+"), "pagination").when(F.col("url").rlike(r"/(tag|category|archive)/"), "archive").otherwise("content").alias("kind"))),
        r"SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/(feed|rss)(/|$)') THEN 'feed' WHEN regexp_matches(url, '[?&](q|s|search)=') THEN 'search' WHEN regexp_matches(url, '([?&]page=|/page/)\d+') THEN 'pagination' WHEN regexp_matches(url, '/(tag|category|archive)/') THEN 'archive' ELSE 'content' END AS kind FROM pages")
    add("FLT18", given("orders", lambda o: o.groupBy().agg(F.max("o_orderdate").alias("now")).transform(lambda now: o.crossJoin(F.broadcast(now))).where(F.datediff("now", "o_orderdate") <= F.when(F.col("o_orderstatus") == "P", 7).otherwise(90)).select("o_orderkey", "o_orderstatus")),
        "SELECT o_orderkey, o_orderstatus FROM orders, (SELECT max(o_orderdate) AS now FROM orders) WHERE date_diff('day', o_orderdate, now) <= CASE WHEN o_orderstatus = 'P' THEN 7 ELSE 90 END")

    # Joins.
    halves = lambda m: (performance.anchored(m).where(performance.in_window(7, 7)), performance.anchored(m).where(performance.in_window(7)))
    anchored = "a AS (SELECT brand, max(date) AS anchor FROM metric GROUP BY brand), w AS (SELECT * FROM metric JOIN a USING (brand)), p AS (SELECT brand, entity, CAST(sum(clicks) AS BIGINT) AS pc FROM w WHERE date BETWEEN anchor - 13 AND anchor - 7 GROUP BY 1, 2), r AS (SELECT brand, entity, CAST(sum(clicks) AS BIGINT) AS rc FROM w WHERE date > anchor - 7 GROUP BY 1, 2)"

    def sums(rows, name):
        return rows.groupBy("brand", "entity").agg(F.sum("clicks").alias(name))

    def left_windows(m):
        prior, recent = halves(m)
        return sums(prior, "pc").where("pc >= 2").join(sums(recent, "rc"), ["brand", "entity"], "left").select("brand", "entity", "pc", F.coalesce("rc", F.lit(0)).alias("rc"))

    def full_windows(m):
        prior, recent = halves(m)
        both = sums(prior, "pc").join(sums(recent, "rc"), ["brand", "entity"], "full_outer").select("brand", "entity", F.coalesce("pc", F.lit(0)).alias("pc"), F.coalesce("rc", F.lit(0)).alias("rc"))
        return both.select("*", delta_pct(F.col("rc"), F.col("pc")).alias("delta"), lead_pct(F.col("rc"), F.col("pc")).alias("lead"))

    add("JOIN2", over(tables.metric_daily, left_windows), twin(f"WITH {anchored} SELECT brand, entity, pc, coalesce(rc, 0) AS rc FROM p LEFT JOIN r USING (brand, entity) WHERE pc >= 2", "metric"))
    add("JOIN3", over(tables.metric_daily, full_windows), twin(f"""WITH {anchored}, f AS (SELECT brand, entity, coalesce(pc, 0) AS pc, coalesce(rc, 0) AS rc FROM p FULL JOIN r USING (brand, entity))
        SELECT *, CASE WHEN pc > 0 THEN (rc - pc) * 100::DOUBLE / pc END AS delta, CASE WHEN pc > 0 THEN (rc - pc) * 100::DOUBLE / pc WHEN rc > 0 THEN 100 ELSE 0 END AS lead FROM f""", "metric"))  # fmt: skip
    windows = (over(tables.metric_daily, full_windows), twin(f"""WITH {anchored}, f AS (SELECT brand, entity, coalesce(pc, 0) AS pc, coalesce(rc, 0) AS rc FROM p FULL JOIN r USING (brand, entity))
        SELECT *, CASE WHEN pc > 0 THEN (rc - pc) * 100::DOUBLE / pc END AS delta, CASE WHEN pc > 0 THEN (rc - pc) * 100::DOUBLE / pc WHEN rc > 0 THEN 100 ELSE 0 END AS lead FROM f""", "metric"))  # fmt: skip
    add("JOIN7", lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name"),
        "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
    add("JOIN13", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    add("JOIN28", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")

    def captures(spark, sf_dir):
        seen = tables.rank_positions(spark, sf_dir)
        return matching.snapshot_diff(seen.where("captured_on <= DATE '2024-01-03'"), seen.where("captured_on >= DATE '2024-01-28'"), "keyword")

    add("JOIN14", captures, twin("""WITH b AS (SELECT DISTINCT keyword FROM ranks WHERE captured_on <= DATE '2024-01-03'), c AS (SELECT DISTINCT keyword FROM ranks WHERE captured_on >= DATE '2024-01-28')
        SELECT coalesce(b.keyword, c.keyword) AS keyword, CASE WHEN b.keyword IS NULL THEN 'new' WHEN c.keyword IS NULL THEN 'removed' ELSE 'kept' END AS state FROM b FULL JOIN c ON b.keyword = c.keyword""", "ranks"))  # fmt: skip
    add("JOIN16", given("lineitem", lambda x: matching.shared_members(x, "l_suppkey", "l_partkey", 14)),
        """WITH r AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS m FROM lineitem), n AS (SELECT e, count(*) AS n FROM r GROUP BY e),
        b AS (SELECT x.e AS a, y.e AS b, count(*) AS shared FROM r x JOIN r y ON x.m = y.m AND x.e < y.e GROUP BY 1, 2), j AS (SELECT a, b, shared, shared::DOUBLE / (p.n + q.n - shared) AS jaccard FROM b JOIN n p ON a = p.e JOIN n q ON b.b = q.e)
        SELECT * FROM j WHERE jaccard >= 0.14""")  # fmt: skip

    # Sets, sorts, shingles.
    add("SET1", lambda s, d: matching.first_of(table(s, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit(1).alias("rank")).unionByName(table(s, d, "part").select(F.col("p_brand").alias("name"), F.lit(2).alias("rank"))), "name", F.col("rank"), F.col("name")),
        'WITH u AS (SELECT c_mktsegment AS name, 1 AS rank FROM customer UNION ALL SELECT p_brand, 2 FROM part) SELECT name, rank FROM u QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY rank, name) = 1')
    add("SET2", lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k")).distinct()), "SELECT p_partkey AS k FROM part EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48")
    add("TOP3", over(tables.rank_positions, lambda r: r.groupBy("keyword").agg(F.max_by("position", "captured_on").alias("position")).orderBy(F.asc_nulls_last("position"), "keyword").limit(60)),
        twin("SELECT keyword, position FROM ranks QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY captured_on DESC) = 1 ORDER BY position ASC NULLS LAST, keyword LIMIT 60", "ranks"))
    add("TOP4", given("orders", lambda o: o.select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2).alias("severity")).orderBy("severity", "o_orderkey").limit(100)),
        "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS severity FROM orders ORDER BY severity, o_orderkey LIMIT 100")
    add("ARR6", given("documents", matching.shingle_overlap), r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, CASE WHEN len(w) >= 8 THEN CAST(len(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) AS BIGINT) ELSE 0 END AS shingles FROM w""")  # fmt: skip
    add("STR21", given("pages", lambda p: p.select("page_id", F.substring(F.sha1(F.coalesce("url", F.lit(""))), 1, 24).alias("sha1"), F.sha2(F.coalesce("url", F.lit("")), 256).alias("sha256"))), "SELECT page_id, substr(sha1(coalesce(url, '')), 1, 24) AS sha1, sha256(coalesce(url, '')) AS sha256 FROM pages")
    add("ARR5", given("events", lambda e: e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))), "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
    add("AGG42", over(tables.metric_series, lambda m: series.places(m, "key", "value", (0.4, 0.5, 0.6, 0.85), 3)),
        twin("WITH v AS (SELECT key, list_sort(list(value)) AS v FROM series GROUP BY key) SELECT key, " + ", ".join(f"v[CAST(floor({p} * (len(v) - 1)) AS BIGINT) + 1] AS p{int(p * 100)}" for p in (0.4, 0.5, 0.6, 0.85)) + " FROM v WHERE len(v) >= 3", "series"))
    add("WIN11", over(tables.metric_series, lambda s: series.newest(s, 5).select("key", "id", "value")), twin("SELECT key, id, value FROM series QUALIFY row_number() OVER (PARTITION BY key ORDER BY seen DESC, id DESC) <= 5", "series"))

    # Streams.
    add("STM4", lambda s, d: counters.drained(counters.daily_counters(counters.events_stream(s, d)), "complete"), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS hits, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1, 2")
    add("STM7", lambda s, d: counters.recounted_days(counters.events_stream(s, d)), "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS hits, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events WHERE CAST(ts AS DATE) <= (SELECT CAST(max(ts) AS DATE) - 2 FROM events) GROUP BY 1, 2")
    add("STM5", lambda s, d: counters.drained(counters.emit_once(counters.events_stream(s, d)), "append"), "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
