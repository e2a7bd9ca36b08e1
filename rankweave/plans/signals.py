"""Session alerts, newest measurements, filters, range joins and scores. Loaded by the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from rankweave.functions.safe import ratio_null
from rankweave.operators import content, performance, visits
from rankweave.sources import tables
from rankweave.sources.tables import table, twin

#: Rules over change(): level, condition and severity; thresholds scaled to what the view holds.
VISIT_RULES = {
    "ALR24": (["brand"], "p_sessions >= 30 AND sessions_drop >= 1", "high"),
    "ALR25": (["brand"], "p_conversions >= 5 AND conversions_drop >= 1", "critical"),
    "ALR26": (["brand"], "p_sessions >= 100 AND p_conversions_rate - r_conversions_rate >= 0.1", "high"),
    "ALR27": (["brand"], "p_sessions >= 100 AND p_engaged_rate - r_engaged_rate >= 0.1", "medium"),
    "ALR28": (["brand", "entity"], "p_sessions >= 3 AND sessions_drop >= 35", "medium"),
}


def _change_sql(keys: str, days: int) -> str:
    def part(c, w):
        return f"CAST(coalesce(sum(CASE WHEN {w} THEN {c} END), 0) AS BIGINT)"

    r, p = f"date > anchor - {days}", f"date <= anchor - {days}"
    sums = ", ".join(f"{part(c, w)} AS {n}_{c}" for n, w in (("r", r), ("p", p)) for c in ("sessions", "engaged", "conversions"))
    rate = lambda n, c: f"coalesce({n}_{c} * 100.0::DOUBLE / nullif({n}_sessions, 0), 0) AS {n}_{c}_rate"
    fall = lambda c: f"CASE WHEN p_{c} <= 0 THEN 0 ELSE greatest(0, (p_{c} - r_{c}) * 100.0::DOUBLE / p_{c}) END AS {c}_drop"
    return f"""a AS (SELECT brand, max(date) AS anchor FROM visits GROUP BY brand), s AS (SELECT {keys}, {sums} FROM visits JOIN a USING (brand) WHERE date > anchor - {2 * days} GROUP BY {keys}),
        c AS (SELECT *, {fall("sessions")}, {fall("conversions")}, {", ".join(rate(n, c) for n in "rp" for c in ("engaged", "conversions"))} FROM s)"""


def register(add: Callable, over: Callable, given: Callable) -> None:
    """Adds this module's queries."""
    for name, (keys, when, severity) in VISIT_RULES.items():
        k = ", ".join(keys)
        fire = lambda v, keys=keys, when=when, severity=severity: visits.change(v, keys, 7).where(when).select(*keys, "r_sessions", "p_sessions", "r_conversions", "p_conversions", F.lit(severity).alias("severity"))
        add(name, over(tables.visits_daily, fire), twin(f"WITH {_change_sql(k, 7)} SELECT {k}, r_sessions, p_sessions, r_conversions, p_conversions, '{severity}' AS severity FROM c WHERE {when}", "visits"))
    add("AGG2", over(tables.visits_daily, lambda v: visits.rates(v, "entity")),
        twin("""WITH s AS (SELECT entity, CAST(sum(sessions) AS BIGINT) AS sessions, sum(engaged) AS e, sum(conversions) AS c, sum(seconds) AS d FROM visits GROUP BY entity)
        SELECT entity, sessions, d::DOUBLE / sessions AS avg_duration, e::DOUBLE / sessions AS engagement_rate, (sessions - e)::DOUBLE / sessions AS bounce_rate, c::DOUBLE / sessions AS conversion_rate FROM s""", "visits"))  # fmt: skip
    stall = "WITH n AS (SELECT {k}, max(date) AS newest FROM {v} GROUP BY {k}) SELECT {k}, newest, CAST((SELECT max(newest) FROM n) - newest AS INTEGER) AS age FROM n WHERE (SELECT max(newest) FROM n) - newest > {d}"
    for name, view, source, keys, days in (("ALR7", "metric", tables.metric_daily, ["brand", "entity"], 5), ("ALR29", "visits", tables.visits_daily, ["entity"], 0), ("ALR46", "metric", tables.metric_daily, ["brand", "entity"], 10)):
        add(name, over(source, lambda m, keys=keys, days=days: visits.stalled(m, keys, days)), twin(stall.format(k=", ".join(keys), v=view, d=days), view))
    add("ALR12", over(tables.query_page, lambda q: performance.cannibalised(q, 0, 1, 300).join(q.groupBy("query").agg(F.sum("clicks").alias("clicks")), "query").where("clicks < 0.15 * impressions AND position <= 20").select("query", "impressions", "clicks", "page")),
        twin("""WITH p AS (SELECT query, page, sum(impressions) AS i, sum(clicks) AS c, sum(impressions * position) AS w FROM query_page GROUP BY 1, 2),
        s AS (SELECT query, CAST(sum(i) AS BIGINT) AS impressions, CAST(sum(c) AS BIGINT) AS clicks, sum(w) AS w, arg_max(page, (i, -page)) AS page FROM p GROUP BY 1) SELECT query, impressions, clicks, page FROM s WHERE impressions >= 300 AND clicks < 0.15 * impressions AND w <= 20 * impressions""", "query_page"))  # fmt: skip
    add("ALR14", over(tables.query_page, lambda q: performance.cannibalised(q, 1, 3, 100).select("query", "pages", "impressions")), twin("SELECT query, count(DISTINCT page) AS pages, CAST(sum(impressions) AS BIGINT) AS impressions FROM query_page WHERE impressions >= 1 GROUP BY query HAVING count(DISTINCT page) >= 3 AND sum(impressions) >= 100", "query_page"))

    # Newest measurements.
    pair = "WITH n AS (SELECT user_id, event_type, {v} AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), p AS (SELECT user_id, event_type, max(CASE WHEN k = 1 THEN v END) AS latest, max(CASE WHEN k = 2 THEN v END) AS previous FROM n WHERE k <= 2 GROUP BY 1, 2) SELECT user_id, latest, previous FROM p WHERE {w}"
    cents, in_props = (lambda: F.round(F.col("value") * 100).cast("long")), (lambda: F.get_json_object("props", "$.k").cast("long"))
    for name, value, sql, when in (
        ("ALR30", cents, "CAST(round(value * 100) AS BIGINT)", "event_type = 'view' AND latest > 2500"), ("ALR31", cents, "CAST(round(value * 100) AS BIGINT)", "event_type = 'click' AND latest > 200"), ("ALR32", cents, "CAST(round(value * 100) AS BIGINT)", "event_type = 'error' AND latest > 1000"),
        ("ALR33", in_props, "CAST(props->>'$.k' AS BIGINT)", "event_type = 'signup' AND previous - latest >= 10"), ("ALR37", in_props, "CAST(props->>'$.k' AS BIGINT)", "event_type = 'error' AND latest - previous >= 5"),
        ("ALR38", in_props, "CAST(props->>'$.k' AS BIGINT)", "event_type = 'view' AND previous - latest >= 5"), ("ALR40", in_props, "CAST(props->>'$.k' AS BIGINT)", "event_type = 'click' AND latest - previous >= 3"),
    ):
        add(name, given("events", lambda e, value=value, when=when: visits.last_two(e, ["user_id", "event_type"], value(), "ts", "event_id").where(when).select("user_id", "latest", "previous")), pair.format(v=sql, w=when))
    add("MTH10", given("lineitem", lambda x: visits.upper_median(x, "l_suppkey", "l_quantity")), "SELECT l_suppkey, list_sort(list(l_quantity))[count(l_quantity) // 2 + 1] AS median, count(l_quantity) AS samples FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_suppkey")

    # Filters and range joins.
    months = lambda x: x.select("l_returnflag", F.trunc("l_shipdate", "month").alias("period"), F.col("l_quantity").cast("long").alias("q"))

    def newest_period(spark, sf_dir):
        rows = months(table(spark, sf_dir, "lineitem")).groupBy("l_returnflag", "period").agg(F.sum("q").alias("quantity"))
        return rows.groupBy("l_returnflag").agg(F.max("period").alias("period"), F.max_by("quantity", "period").alias("quantity"))

    add("FLT4", newest_period, "SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY period DESC) = 1")
    add("FLT7", lambda s, d: tables.leads(s, d).where("status IN ('O', 'P')").join(table(s, d, "customer").select(F.col("c_custkey").alias("person"), "c_mktsegment"), "person").groupBy("c_mktsegment", "status", "channel").agg(F.count("*").alias("n"), F.sum("value").alias("value")),
        twin("SELECT c_mktsegment, status, channel, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM leads JOIN customer ON person = c_custkey WHERE status IN ('O', 'P') GROUP BY 1, 2, 3", "leads"))
    notes = lambda e: e.where("event_type IN ('signup', 'error')").groupBy(F.col("event_type").alias("brand"), "user_id").agg(F.to_date(F.min("ts")).alias("starts"), F.when(F.count("*") > 1, F.to_date(F.max("ts"))).alias("ends"))
    notes_sql = "n AS (SELECT event_type AS brand, user_id, CAST(min(ts) AS DATE) AS starts, CASE WHEN count(*) > 1 THEN CAST(max(ts) AS DATE) END AS ends FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2)"
    add("FLT8", given("events", lambda e: notes(e).where("coalesce(ends, starts) >= DATE'2024-01-05' AND starts <= DATE'2024-01-09'")), f"WITH {notes_sql} SELECT * FROM n WHERE coalesce(ends, starts) >= DATE '2024-01-05' AND starts <= DATE '2024-01-09'")
    add("JOIN10", lambda s, d: visits.in_intervals(notes(table(s, d, "events")), tables.metric_daily(s, d).groupBy("brand", "date").agg(F.sum("clicks").alias("clicks"))).groupBy("brand", "user_id").agg(F.sum("clicks").alias("clicks"), F.count("*").alias("days")),
        twin(f"WITH {notes_sql}, m AS (SELECT brand, date, CAST(sum(clicks) AS BIGINT) AS clicks FROM metric GROUP BY 1, 2) SELECT n.brand, user_id, CAST(sum(clicks) AS BIGINT) AS clicks, count(*) AS days FROM n JOIN m ON n.brand = m.brand AND date BETWEEN starts AND coalesce(ends, starts) GROUP BY 1, 2", "metric"))
    squashed = lambda: F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    add("FLT11", given("part", lambda p: p.where(squashed().contains("redbolt") | F.lower("p_name").contains("blue widget") | F.arrays_overlap(F.split(F.lower("p_name"), "[^a-z0-9]+"), F.array(F.lit("ring")))).select("p_partkey", "p_name")),
        "SELECT p_partkey, p_name FROM part WHERE contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'redbolt') OR contains(lower(p_name), 'blue widget') OR list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'ring')")

    # Texts.
    grams = lambda t: F.when(F.size(t) >= 2, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    add("STR10", given("documents", lambda d: content.tokens(d).select("doc_id", F.explode(F.array_distinct(grams(F.col("tokens")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "gram").limit(100)),
        """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9''-]*') AS t FROM documents), g AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM t)
        SELECT gram, count(*) AS docs FROM g GROUP BY gram ORDER BY docs DESC, gram LIMIT 100""")  # fmt: skip
    flat = lambda: F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " "))
    add("STR11", given("documents", lambda d: d.select("doc_id", F.filter(F.split(flat(), r"(?<=[.!?]) (?=[A-Z0-9\"'(])"), lambda x: x != "").alias("s")).select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))),
        r"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'), ' ') AS f FROM documents), s AS (SELECT doc_id, list_filter(string_split(regexp_replace(f, '([.!?]) ([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM f)
        SELECT doc_id, len(s) AS sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM s""")  # fmt: skip

    # Scores.
    volume = lambda: F.least(F.lit(60.0), F.log10(F.col("volume") + 1) * 18)
    seen = lambda: F.least(F.lit(50.0), F.log10(F.col("impressions") + 1) * 16)
    near = lambda: F.when(F.col("position").between(4, 20), 16).otherwise(0)
    keyword = lambda q: q.groupBy("query").agg(F.count("*").alias("volume"), F.sum("impressions").alias("impressions"), ratio_null(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions")).alias("position"))
    add("MTH8", over(tables.query_page, lambda q: keyword(q).select("query", F.round((volume() + seen() + near()) * F.when(F.col("query") % 10 == 0, 0.35).otherwise(1.0) * (1 - F.col("query") % 101 / 100 * 0.45), 6).alias("score"))),
        twin("""WITH k AS (SELECT query, count(*) AS volume, sum(impressions) AS i, sum(position * impressions)::DOUBLE / nullif(sum(impressions), 0) AS position FROM query_page GROUP BY query)
        SELECT query, round((least(60, log10(volume + 1) * 18) + least(50, log10(i + 1) * 16) + CASE WHEN position BETWEEN 4 AND 20 THEN 16 ELSE 0 END) * CASE WHEN query % 10 = 0 THEN 0.35::DOUBLE ELSE 1 END * (1 - (query % 101)::DOUBLE / 100 * 0.45::DOUBLE), 6) AS score FROM k""", "query_page"))  # fmt: skip
    kinds = lambda *t: F.count_if(F.col("event_type").isin(*t))
    mentions = lambda e: e.groupBy("user_id").agg(F.count("*").alias("n"), kinds("purchase", "signup").alias("good"), kinds("error").alias("bad"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 50)).alias("risks"))
    mood = lambda: F.coalesce((ratio_null(F.col("good") - F.col("bad"), F.col("good") + F.col("bad")) + 1) * 20, F.lit(25.0))
    add("SCR3", given("events", lambda e: mentions(e).select("user_id", F.round(F.least(F.lit(50.0), F.floor(25 * F.log10(F.col("n") + 1) + 0.5).cast("double")) + mood() + 10 - F.least(F.lit(20), 5 * F.col("risks")), 6).alias("score"))),
        """WITH m AS (SELECT user_id, count(*) AS n, count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END) AS g, count(CASE WHEN event_type = 'error' THEN 1 END) AS b, count(CASE WHEN event_type = 'error' AND value > 50 THEN 1 END) AS r FROM events GROUP BY 1)
        SELECT user_id, round(least(50, floor(25 * log10(n + 1) + 0.5)) + coalesce(((g - b)::DOUBLE / nullif(g + b, 0) + 1) * 20, 25) + 10 - least(20, 5 * r), 6) AS score FROM m""")  # fmt: skip
    add("SCR10", given("events", lambda e: e.groupBy("user_id").agg(ratio_null(F.sum(F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2)), F.sum(F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "error", 1))).alias("share"))),
        "SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 END)::DOUBLE / sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'error' THEN 1 END) AS share FROM events GROUP BY user_id")

    # Buckets, shares, dates and tasks.
    add("AGG12", given("orders", lambda o: o.groupBy(F.nullif(F.regexp_extract("o_orderpriority", "^[1-3]-(.*)$", 1), F.lit("")).alias("path")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("value")).where("path IS NULL").select("n", "value")),
        "SELECT count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders WHERE o_orderpriority IS NULL OR NOT regexp_matches(o_orderpriority, '^[1-3]-.+$') HAVING count(*) > 0")

    def group_shares(spark, sf_dir):
        sums = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
        all_ = sums.agg(F.sum("size").alias("all"))  # one row
        return sums.crossJoin(F.broadcast(all_)).select("p_type", "n", "size", ratio_null(F.col("size"), F.col("all")).alias("share")).orderBy(F.desc("size"), "p_type").limit(40)

    add("AGG34", group_shares, "WITH s AS (SELECT p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1) SELECT p_type, n, size, size::DOUBLE / (SELECT sum(size) FROM s) AS share FROM s ORDER BY size DESC, p_type LIMIT 40")
    add("DAT1", over(tables.visits_daily, lambda v: performance.anchored(v).groupBy("brand", "anchor").agg(F.count_if(performance.in_window(7)).alias("recent"), F.count_if(performance.in_window(7, 7)).alias("prior")).withColumn("starts", F.date_sub("anchor", 6))),
        twin("WITH a AS (SELECT brand, max(date) AS anchor FROM visits GROUP BY 1) SELECT brand, anchor, count(CASE WHEN date > anchor - 7 THEN 1 END) AS recent, count(CASE WHEN date > anchor - 14 AND date <= anchor - 7 THEN 1 END) AS prior, CAST(anchor - 6 AS DATE) AS starts FROM visits JOIN a USING (brand) GROUP BY 1, 2", "visits"))

    def not_queued(spark, sf_dir):
        """Parts that were neither sold in returned lines nor ordered in small numbers: two anti joins."""
        lines = table(spark, sf_dir, "lineitem")
        fresh, queued = (lines.where(w).select(F.col("l_partkey").alias("p_partkey")).distinct() for w in ("l_returnflag = 'R' AND l_linenumber = 1", "l_quantity <= 3"))
        return table(spark, sf_dir, "part").select("p_partkey").join(fresh, "p_partkey", "left_anti").join(queued, "p_partkey", "left_anti")

    add("JOIN27", not_queued, "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity <= 3)")

    def stale_tasks(spark, sf_dir):
        """Open tasks (orders) whose key no current finding (event of that user) has: new ones are dismissed,
        started ones only annotated."""
        current = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey")).distinct()
        tasks = table(spark, sf_dir, "orders").where("o_orderstatus IN ('O', 'P')").select("o_orderkey", "o_custkey", "o_orderstatus")
        return tasks.join(current, "o_custkey", "left_anti").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "dismissed").otherwise("annotated").alias("outcome"))

    add("JOIN26", stale_tasks, "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'dismissed' ELSE 'annotated' END AS outcome FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
