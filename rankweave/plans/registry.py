"""All queries of the analytics library, by the blueprint's row ids, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import content, graph, performance, rules, series
from rankweave.plans import choices, composites, imports, more, relations, scoring, signals, site_audit, texts, traffic, wider
from rankweave.sources import tables
from rankweave.sources.tables import table, twin
from rankweave.streaming import counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _over(view: Callable, work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: work(view(spark, sf_dir))


def _given(name: str, work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: work(table(spark, sf_dir, name))


_BIG = "CAST({} AS BIGINT)"


def _big(expression: str) -> str:
    return _BIG.format(expression)


# Anchored windows and roll-ups.
_ANCHOR = "a AS (SELECT brand, max(date) AS anchor FROM {v} GROUP BY brand), w AS (SELECT * FROM {v} JOIN a USING (brand))"
_METRIC = _ANCHOR.format(v="metric")


def _compared(keys: str, days: int) -> str:
    recent, prior = f"date > anchor - {days}", f"date > anchor - {2 * days} AND date <= anchor - {days}"
    part = lambda c, w: _big(f"coalesce(sum(CASE WHEN {w} THEN {c} END), 0)")
    return f"""{_METRIC}, s AS (SELECT {keys}, {part("clicks", recent)} AS rc, {part("clicks", prior)} AS pc, {part("impressions", recent)} AS ri, {part("impressions", prior)} AS pi,
        {part("pos", recent)} AS rw, {part("pos", prior)} AS pw, count(DISTINCT CASE WHEN {recent} THEN date END) AS rdays, count(DISTINCT CASE WHEN {prior} THEN date END) AS pdays
        FROM w WHERE date > anchor - {2 * days} GROUP BY {keys}),
    c AS (SELECT *, CASE WHEN ri = 0 THEN 0 ELSE rc::DOUBLE / ri END AS rctr, CASE WHEN pi = 0 THEN 0 ELSE pc::DOUBLE / pi END AS pctr, CASE WHEN ri <> 0 THEN rw::DOUBLE / ri END AS rpos,
        CASE WHEN pi <> 0 THEN pw::DOUBLE / pi END AS ppos, CASE WHEN pc <= 0 THEN 0 ELSE greatest(0, (pc - rc) * 100::DOUBLE / pc) END AS click_drop,
        CASE WHEN pi <= 0 THEN 0 ELSE greatest(0, (pi - ri) * 100::DOUBLE / pi) END AS imp_drop,
        CASE WHEN pc = 0 THEN (CASE WHEN rc > 0 THEN 'inf'::DOUBLE ELSE 0 END) ELSE (rc - pc) * 100::DOUBLE / pc END AS click_change FROM s)"""


_add("FLT1", _over(tables.metric_daily, lambda m: performance.anchored(m).where(performance.in_window(7, 2)).select("brand", "date", "entity", "clicks", "impressions")),
     twin(f"WITH {_METRIC} SELECT brand, date, entity, clicks, impressions FROM w WHERE date BETWEEN anchor - 8 AND anchor - 2", "metric"))
_add("FLT2", _over(tables.metric_daily, performance.anchors), twin("SELECT brand, max(date) AS anchor FROM metric GROUP BY brand", "metric"))
_add("FLT3", _over(tables.metric_daily, performance.last_week), twin(f"""WITH {_METRIC}, e AS (SELECT *, anchor - CAST(dayofweek(anchor) AS INTEGER) AS "end" FROM w)
    SELECT brand, "end", {", ".join(_big(f"coalesce(sum(CASE WHEN date BETWEEN {lo} AND {hi} THEN {c} END), 0)") + f" AS {n}_{c}" for n, lo, hi in (("week", '"end" - 6', '"end"'), ("prior", '"end" - 13', '"end" - 7')) for c in ("clicks", "impressions"))}
    FROM e GROUP BY brand, "end" """, "metric"))  # fmt: skip
_add("AGG1", _over(tables.metric_daily, lambda m: performance.totals(m, 14)), twin(f"""WITH {_METRIC} SELECT brand, {_big("sum(clicks)")} AS clicks, {_big("sum(impressions)")} AS impressions, count(*) AS rows,
    CASE WHEN sum(impressions) = 0 THEN 0 ELSE sum(clicks)::DOUBLE / sum(impressions) END AS ctr, CASE WHEN sum(impressions) = 0 THEN 0 ELSE sum(pos)::DOUBLE / sum(impressions) END AS position
    FROM w WHERE date > anchor - 14 GROUP BY brand""", "metric"))  # fmt: skip


def _rolled(keys: str, having: str = "") -> str:
    return f"""SELECT {keys}, {_big("sum(clicks)")} AS clicks, {_big("sum(impressions)")} AS impressions, CASE WHEN sum(impressions) <> 0 THEN sum(clicks)::DOUBLE / sum(impressions) END AS ctr,
        CASE WHEN sum(impressions) <> 0 THEN sum(pos)::DOUBLE / sum(impressions) END AS position FROM metric GROUP BY {keys} {having}"""


_add("AGG3", _over(tables.metric_daily, lambda m: performance.roll_up(m, ["entity"])), twin(_rolled("entity"), "metric"))
_add("AGG4", _over(tables.metric_daily, lambda m: performance.roll_up(m, ["brand", "date"])), twin(_rolled("brand, date"), "metric"))
_add("AGG5", _over(tables.metric_daily, lambda m: performance.roll_up(m, ["brand", "entity"], 40_000)), twin(_rolled("brand, entity", "HAVING sum(impressions) >= 40000"), "metric"))
_add("AGG6", _over(tables.query_page, lambda q: performance.cannibalised(q, 5, 20, 500)), twin(f"""WITH p AS (SELECT query, page, sum(impressions) AS i, sum(position * impressions) AS w, min(position) AS best FROM query_page WHERE impressions >= 5 GROUP BY query, page)
    SELECT query, count(*) AS pages, {_big("sum(i)")} AS impressions, sum(w)::DOUBLE / sum(i) AS position, min(best) AS best_position, arg_max(page, i * 1000000 - page) AS page
    FROM p GROUP BY query HAVING count(*) >= 20 AND sum(i) >= 500""", "query_page"))  # fmt: skip
_add("WIN6", _over(tables.query_page, lambda q: performance.top_per(q.groupBy("query", "page").agg(F.sum("impressions").alias("impressions")), "query", 1, F.desc("impressions"), F.col("page")).drop("place")),
     twin(f"""WITH p AS (SELECT query, page, {_big("sum(impressions)")} AS impressions FROM query_page GROUP BY query, page)
    SELECT query, page, impressions FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) = 1""", "query_page"))  # fmt: skip
_add("AGG9", _over(tables.metric_daily, lambda m: performance.distinct_in_windows(m, 2)), twin(f"""WITH {_METRIC} SELECT brand, count(DISTINCT CASE WHEN date > anchor - 2 AND impressions > 0 THEN entity END) AS recent,
    count(DISTINCT CASE WHEN date > anchor - 4 AND date <= anchor - 2 AND impressions > 0 THEN entity END) AS prior FROM w WHERE date > anchor - 4 GROUP BY brand""", "metric"))  # fmt: skip
_add("JOIN1", _over(tables.metric_daily, lambda m: performance.compare(m, ["brand", "entity"], 7).where("pi >= 100").select("brand", "entity", "rc", "pc", "ri", "pi", "rpos", "ppos")),
     twin(f"WITH {_compared('brand, entity', 7)} SELECT brand, entity, rc, pc, ri, pi, rpos, ppos FROM c WHERE pi >= 100", "metric"))
_add("TOP1", _over(tables.metric_daily, lambda m: performance.top(performance.roll_up(m, ["brand", "entity"]), 50, F.desc("clicks"), F.desc("impressions"), F.col("brand"), F.col("entity")).select("brand", "entity", "clicks", "impressions")),
     twin(f"WITH r AS ({_rolled('brand, entity')}) SELECT brand, entity, clicks, impressions FROM r ORDER BY clicks DESC, impressions DESC, brand, entity LIMIT 50", "metric"))
_add("TOP5", _over(tables.metric_daily, lambda m: performance.top(performance.compare(m, ["brand", "entity"], 7).where("rpos > ppos").select("brand", "entity", "pi", F.round((F.col("rpos") - F.col("ppos")) * F.col("pi"), 3).alias("weight")), 40, F.desc("weight"), F.col("brand"), F.col("entity"))),
     twin(f"WITH {_compared('brand, entity', 7)} SELECT brand, entity, pi, round((rpos - ppos) * pi, 3) AS weight FROM c WHERE rpos > ppos ORDER BY weight DESC, brand, entity LIMIT 40", "metric"))
_add("TOP6", _over(tables.metric_daily, lambda m: performance.top_per(performance.roll_up(m, ["brand", "entity"]), "brand", 10, F.desc("impressions"), F.col("entity")).select("brand", "entity", "impressions", "place")),
     twin(f"WITH r AS ({_rolled('brand, entity')}), n AS (SELECT brand, entity, impressions, row_number() OVER (PARTITION BY brand ORDER BY impressions DESC, entity) AS place FROM r) SELECT brand, entity, impressions, CAST(place AS INTEGER) AS place FROM n WHERE place <= 10", "metric"))
for _id, _rule in rules.RULES.items():
    _keys = ", ".join(_rule.keys)
    _add(_id, _over(tables.metric_daily, lambda m, r=_rule: rules.evaluate(m, r)), twin(f"WITH {_compared(_keys, _rule.days)} SELECT {_keys}, rc, pc, ri, pi, '{_rule.severity}' AS severity FROM c WHERE {_rule.when}", "metric"))
_add("ALR21", _over(tables.metric_daily, lambda m: performance.distinct_in_windows(m, 7).where("prior >= 10").withColumn("change", F.col("recent") - F.col("prior"))), twin(f"""WITH {_METRIC}, d AS (SELECT brand, count(DISTINCT CASE WHEN date > anchor - 7 AND impressions > 0 THEN entity END) AS recent,
    count(DISTINCT CASE WHEN date <= anchor - 7 AND impressions > 0 THEN entity END) AS prior FROM w WHERE date > anchor - 14 GROUP BY brand) SELECT brand, recent, prior, recent - prior AS change FROM d WHERE prior >= 10""", "metric"))  # fmt: skip
_add("AGG25", _over(tables.metric_daily, performance.split_half_trend), twin("""WITH d AS (SELECT brand, date, sum(clicks) AS clicks FROM metric GROUP BY brand, date),
    p AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY date) AS k, count(*) OVER (PARTITION BY brand) AS n FROM d),
    s AS (SELECT brand, max(n) AS days, CAST(sum(CASE WHEN k <= n // 2 THEN clicks ELSE 0 END) AS BIGINT) AS first_half, CAST(sum(CASE WHEN k > n // 2 THEN clicks ELSE 0 END) AS BIGINT) AS second_half FROM p GROUP BY brand)
    SELECT *, CASE WHEN days >= 4 THEN second_half - first_half END AS change FROM s""", "metric"))  # fmt: skip
_MONTHS = "m AS (SELECT brand, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(clicks) AS BIGINT) AS clicks FROM long_daily GROUP BY 1, 2)"
_add("AGG35", _over(tables.long_daily, performance.monthly_change), twin(f"""WITH {_MONTHS}, p AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY month) AS k, count(*) OVER (PARTITION BY brand) AS n FROM m)
    SELECT brand, max(n) AS months, sum(CASE WHEN k <= 3 THEN clicks ELSE 0 END)::DOUBLE / count(CASE WHEN k <= 3 THEN 1 END) AS "first", sum(CASE WHEN k > n - 3 THEN clicks ELSE 0 END)::DOUBLE / count(CASE WHEN k > n - 3 THEN 1 END) AS "last" FROM p GROUP BY brand""", "long_daily"))  # fmt: skip
_add("WIN9", _over(tables.long_daily, performance.moving_means), twin(f"""WITH {_MONTHS} SELECT brand, month, clicks, CASE WHEN count(*) OVER w = 3 THEN sum(clicks) OVER w::DOUBLE / 3 END AS mean FROM m
    WINDOW w AS (PARTITION BY brand ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "long_daily"))  # fmt: skip
_add("AGG20", _over(tables.query_page, performance.click_curve), twin("""WITH s AS (SELECT CAST(CASE WHEN position <= 10 THEN position WHEN position <= 15 THEN 15 ELSE 20 END AS BIGINT) AS bucket, CAST(sum(clicks) AS BIGINT) AS c, CAST(sum(impressions) AS BIGINT) AS i FROM query_page GROUP BY 1),
    g AS (SELECT sum(clicks)::DOUBLE / sum(impressions) AS g FROM query_page)
    SELECT bucket, c, i, min((c + 1000 * g) / (i + 1000)) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM s, g WHERE i >= 200""", "query_page"))  # fmt: skip
_add("WIN8", _over(tables.rank_positions, lambda r: r.select("keyword", "captured_on", F.min("position").over(Window.partitionBy("keyword").orderBy("captured_on").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("best"))),
     twin("SELECT keyword, captured_on, min(position) OVER (PARTITION BY keyword ORDER BY captured_on ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM ranks", "ranks"))
_add("MTH3", _over(tables.metric_daily, lambda m: performance.divergence(m, 7)), twin(f"""WITH {_compared('brand, entity', 7)}, t AS (SELECT brand, sum(rc) AS r, sum(pc) AS p FROM c GROUP BY brand),
    x AS (SELECT brand, r, p, rc::DOUBLE / r AS a, pc::DOUBLE / p AS b FROM c JOIN t USING (brand))
    SELECT brand, CASE WHEN max(r) > 0 AND max(p) > 0 THEN round(least(1.0, greatest(0.0, (sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END) + sum(CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END)) / 2)), 6) END AS divergence FROM x GROUP BY brand""", "metric"))  # fmt: skip

# Measurement series.
def _monitor(kind: str) -> Query:
    """Views of the state that a stream of measurements leaves."""
    pick = {
        "STM1": lambda m: m.where("status = 'error' AND before = 'error'").selectExpr("key", "2L AS checks", "2L AS failed"),
        "STM2": lambda m: m.where("oks > 0").selectExpr("key", "oks AS checks", "(ok1 + coalesce(ok2, 0) + coalesce(ok3, 0)) / oks AS mean").where("mean > 6000"),
        "STM3": lambda m: m.select("key", "changes", "rows"),
        "STM6": lambda m: m.select("key", "first_id", "last_id", "most", "status"),
    }[kind]
    return lambda spark, sf_dir: pick(counters.drained(counters.monitored(counters.measurements(spark, sf_dir)), "update", ("key",)))


_NEWEST = "n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen DESC, id DESC) AS k FROM series)"
_add("WIN1", _over(tables.metric_series, series.latest), twin(f"WITH {_NEWEST} SELECT key, id, status, value FROM n WHERE k = 1", "series"))
_add("WIN2", _over(tables.metric_series, series.second_latest), twin(f"WITH {_NEWEST} SELECT key, id, status, value FROM n WHERE k = 2", "series"))
_add("WIN3", _over(tables.metric_series, series.turned_bad), twin(f"WITH {_NEWEST}, t AS (SELECT key, max(CASE WHEN k = 1 THEN status END) AS now, max(CASE WHEN k = 2 THEN status END) AS before FROM n WHERE k <= 2 GROUP BY key) SELECT * FROM t WHERE now = 'error' AND before <> 'error'", "series"))
_add("WIN5", _over(tables.metric_series, lambda s: series.newest(s.where("status <> 'error'"), 2).select("key", "id", "value", "k")), twin("WITH n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen DESC, id DESC) AS k FROM series WHERE status <> 'error') SELECT key, id, value, CAST(k AS INTEGER) AS k FROM n WHERE k <= 2", "series"))
_add("STM1", _monitor("STM1"), twin(f"WITH {_NEWEST} SELECT key, count(*) AS checks, count(CASE WHEN status = 'error' THEN 1 END) AS failed FROM n WHERE k <= 2 GROUP BY key HAVING count(*) = 2 AND count(CASE WHEN status = 'error' THEN 1 END) = 2", "series"))
_add("STM2", _monitor("STM2"), twin("WITH n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen DESC, id DESC) AS k FROM series WHERE status <> 'error') SELECT key, count(*) AS checks, sum(value)::DOUBLE / count(*) AS mean FROM n WHERE k <= 3 GROUP BY key HAVING sum(value)::DOUBLE / count(*) > 6000", "series"))
_add("STM3", _monitor("STM3"), twin("WITH l AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY seen, id) AS before FROM series) SELECT key, count(CASE WHEN before <> status THEN 1 END) AS changes, count(*) AS rows FROM l GROUP BY key", "series"))
_add("STM6", _monitor("STM6"), twin("SELECT key, first(id ORDER BY seen, id) AS first_id, last(id ORDER BY seen, id) AS last_id, max(value) AS most, last(status ORDER BY seen, id) AS status FROM series GROUP BY key", "series"))
# The alerts ask the same of the stored rows that the monitors ask of the stream.
_add("ALR34", _over(tables.metric_series, series.failing_run), ORACLES["STM1"])
_add("ALR35", _over(tables.metric_series, series.slow_lately), ORACLES["STM2"])
for _id, _as in (("ALR43", "WIN3"),):
    QUERIES[_id], ORACLES[_id] = QUERIES[_as], ORACLES[_as]
_add("ALR36", _over(tables.metric_series, lambda s: series.newest(s, 2).groupBy("key").agg(F.count_distinct("status").alias("kinds")).where("kinds > 1")), twin(f"WITH {_NEWEST} SELECT key, count(DISTINCT status) AS kinds FROM n WHERE k <= 2 GROUP BY key HAVING count(DISTINCT status) > 1", "series"))

# Leads and ranks.
_LEAD = """count(*) AS total, count(CASE WHEN status = 'F' THEN 1 END) AS won, count(CASE WHEN status = 'O' THEN 1 END) AS "open", count(CASE WHEN status = 'P' THEN 1 END) AS qualified,
    CAST(sum(value) AS BIGINT) AS value, CAST(sum(CASE WHEN status = 'F' THEN value ELSE 0 END) AS BIGINT) AS won_value, count(DISTINCT person) AS people FROM leads"""
_add("AGG10", _over(tables.leads, lambda x: series.lead_summary(x, ["channel"])), twin(f"SELECT channel, {_LEAD} GROUP BY channel", "leads"))
_add("AGG7", _over(tables.leads, lambda x: series.lead_summary(x, ["status"]).select("status", "total", "value")), twin("SELECT status, count(*) AS total, CAST(sum(value) AS BIGINT) AS value FROM leads GROUP BY status", "leads"))
_add("AGG13", _over(tables.leads, series.lead_days), twin("""WITH d AS (SELECT day, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM leads GROUP BY day), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
    SELECT day, coalesce(n, 0) AS n, coalesce(value, 0) AS value FROM s LEFT JOIN d USING (day)""", "leads"))  # fmt: skip
_add("JOIN8", _over(tables.rank_positions, series.rank_moves), twin("""WITH e AS (SELECT max(captured_on) AS hi, min(captured_on) AS lo FROM (SELECT DISTINCT captured_on FROM ranks ORDER BY 1 DESC LIMIT 2)),
    n AS (SELECT keyword, position AS now FROM ranks, e WHERE captured_on = hi), b AS (SELECT keyword, position AS before, true AS present FROM ranks, e WHERE captured_on = lo AND lo < hi)
    SELECT keyword, now, before, CASE WHEN present IS NULL THEN 'new' WHEN before IS NULL AND now IS NULL THEN 'unranked' WHEN before IS NULL THEN 'entered' WHEN now IS NULL THEN 'lost' WHEN now < before THEN 'improved'
        WHEN now > before THEN 'declined' ELSE 'flat' END AS move, before - now AS delta FROM n LEFT JOIN b USING (keyword)""", "ranks"))  # fmt: skip
_add("AGG19", _over(tables.rank_positions, lambda r: series.rank_moves(r).groupBy("move").agg(F.count("*").alias("keywords"))), ORACLES["JOIN8"].replace("SELECT keyword, now, before, CASE", "SELECT CASE").replace(", before - now AS delta FROM", ", count(*) AS keywords FROM") + " GROUP BY 1")
_add("AGG17", _over(tables.rank_positions, series.rank_spread), twin("""SELECT captured_on, count(*) AS tracked, count(position) AS ranked, count(CASE WHEN position <= 3 THEN 1 END) AS top3, count(CASE WHEN position <= 10 THEN 1 END) AS top10,
    count(CASE WHEN position <= 20 THEN 1 END) AS top20, sum(position)::DOUBLE / count(position) AS mean, count(CASE WHEN position <= 10 THEN 1 END)::DOUBLE / count(*) AS top10_share FROM ranks GROUP BY captured_on""", "ranks"))  # fmt: skip
_add("WIN12", _over(tables.rank_positions, lambda r: performance.top(series.rank_moves(r).where("abs(delta) >= 5").select("keyword", "delta"), 20, F.desc(F.abs("delta")), F.col("keyword"))), f"SELECT keyword, delta FROM ({ORACLES['JOIN8']}) WHERE abs(delta) >= 5 ORDER BY abs(delta) DESC, keyword LIMIT 20")

# Pages.
_PAGES = r"""h AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    x AS (SELECT *, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM h),
    r AS (SELECT page_id, url, length(html) AS html_length, replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&') AS title, len(regexp_extract_all(html, '(?i)<title[\s>]')) AS titles, len(regexp_extract_all(html, '(?i)<h1[\s>]')) AS h1s,
    len(regexp_extract_all(html, '(?i)<a\s[^>]*nofollow')) AS nofollow, len(regexp_extract_all(html, '(?i)href="http://')) AS http_links, len(regexp_extract_all(html, '(?i)<a\s[^>]*>\s*</a>')) AS empty_anchors,
    regexp_matches(html, '(?i)<meta[^>]*name="description"') AS has_description, regexp_matches(html, '(?i)<meta[^>]*name="viewport"') AS has_viewport, regexp_matches(html, '(?i)<meta[^>]*charset') AS has_charset,
    regexp_matches(html, '(?i)^\s*<!doctype') AS has_doctype, regexp_matches(html, '(?i)rel="canonical"') AS has_canonical, regexp_matches(html, '(?i)<meta[^>]*name=.?robots[^>]*noindex') AS noindex,
    len(regexp_extract_all(t, '[^ \t\n\r]+')) AS words, length(regexp_replace(t, '[ \t\n\r]+', '', 'g')) AS text_length FROM x)"""
for _id, (_name, _when, _tier) in content.AUDITS.items():
    _add(_id, _given("pages", lambda p, w=_when: content.failing_pages(content.page_record(p), w)), f"WITH {_PAGES} SELECT page_id, url FROM r WHERE {_when}")
_add("AUD4", _given("pages", lambda p: content.duplicate_titles(content.page_record(p))), f"WITH {_PAGES}, d AS (SELECT title, count(*) AS pages FROM r WHERE title <> '' GROUP BY title HAVING count(*) > 1) SELECT page_id, title, d.pages FROM r JOIN d USING (title)")
_URL = r"""u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), q AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host,
    regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS qs FROM u),
    v AS (SELECT page_id, host, regexp_replace(p, '/+$', '') AS path, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts, list_filter(string_split(qs, '&'), lambda x: x <> '') AS ps FROM q)"""
_add("STR2", _given("pages", content.url_parts), f"WITH {_URL} SELECT page_id, host, path, coalesce(parts[1], '') AS section, CAST(len(parts) AS BIGINT) AS depth, coalesce(array_to_string(list_sort(list_distinct(list_transform(ps, lambda x: string_split(x, '=')[1]))), ','), '') AS params FROM v")
_add("AGG28", _given("pages", content.sections), f"WITH {_URL} SELECT coalesce(parts[1], '') AS section, count(*) AS pages FROM v GROUP BY 1 ORDER BY pages DESC, section LIMIT 25")

# Texts.
_TERMS = r"""k AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9''-]*')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM k GROUP BY 1, 2)"""
_add("STR8", _given("documents", lambda d: content.tokens(d).select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("terms"))), r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9''-]*')) AS tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9''-]*'))) AS terms FROM documents")
_add("AGG30", _given("documents", lambda d: content.document_frequency(d, 200)), f"WITH {_TERMS} SELECT term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY term ORDER BY docs DESC, term LIMIT 200")
_add("GRF8", _given("documents", content.rare_terms), f"WITH {_TERMS}, a AS (SELECT term, max(doc_id) AS doc_id FROM c GROUP BY term HAVING count(*) = 1) SELECT doc_id, count(*) AS unique_terms FROM a GROUP BY doc_id")
_add("MTH5", _given("documents", content.tf_idf), f"""WITH {_TERMS}, a AS (SELECT count(*) AS al FROM documents), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    s AS (SELECT doc_id, term, (1 + ln(n)) * (ln((al + 1) / (df + 1)) + 1) AS w FROM c JOIN f USING (term), a WHERE df > 1 AND df <= greatest(2.0, 0.85 * al)),
    u AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM s)
    SELECT doc_id, term, weight FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 3""")  # fmt: skip

# Graphs.
_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey - 1 AS dst FROM lineitem)"
_DEGREES = f"{_EDGES}, g AS (SELECT coalesce(i.node, o.node) AS node, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound FROM (SELECT dst AS node, count(*) AS inbound FROM e GROUP BY dst) i FULL JOIN (SELECT src AS node, count(*) AS outbound FROM e GROUP BY src) o ON i.node = o.node)"
_add("AGG41", _given("lineitem", lambda x: series.gini(graph.degrees(graph.edges(x)), "inbound")), f"WITH {_DEGREES}, i AS (SELECT inbound AS x, row_number() OVER (ORDER BY inbound) AS i, count(*) OVER () AS n FROM g) SELECT max(n) AS n, round(2 * sum(i * x)::DOUBLE / (max(n) * sum(x)) - (max(n) + 1)::DOUBLE / max(n), 3) AS gini FROM i")
_add("WIN7", _given("lineitem", lambda x: series.tie_averaged_rank(graph.degrees(graph.edges(x)), "inbound")), f"WITH {_DEGREES}, t AS (SELECT inbound, count(*) AS ties FROM g GROUP BY inbound) SELECT inbound, ties, (coalesce(sum(ties) OVER (ORDER BY inbound DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ties / 2)::DOUBLE / sum(ties) OVER () AS percentile FROM t")
_add("MTH6", _given("lineitem", lambda x: graph.page_rank(graph.edges(x))))
_add("GRF2", _given("lineitem", lambda x: graph.components(graph.edges(x))))

more.register(_add, _over, _given)
scoring.register(_add, _over, _given, _PAGES)
wider.register(_add, _over, _given, _compared)
traffic.register(_add, _given)
signals.register(_add, _over, _given)
site_audit.register(_add)
texts.register(_add, _given)
imports.register(_add, _given)
relations.register(_add, _given)
choices.register(_add)
composites.register(_add, _given)
