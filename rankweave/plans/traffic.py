"""Access logs, referrals, leads and URL forms. Loaded by the registry. Log lines, referrals and redirects are
written from the given events, orders and pages, and read back by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import access_log, urls
from rankweave.sources.tables import table

#: Agent strings of the written lines with the key expected of each.
_AGENTS = [
    ("Mozilla/5.0 (X11; Linux x86_64) Firefox/125.0", None), ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "googlebot"), ("Googlebot-Image/1.0", "googlebot-image"),
    ("Mozilla/5.0 (compatible; bingbot/2.0)", "bingbot"), ("Applebot-Extended/0.3", "applebot-extended"), ("AhrefsBot/7.0", "ahrefsbot"), ("curl/8.5", "other-bot"), ("GPTBot/1.2", "gptbot"),
]
_SOURCES = [("chatgpt.com", "chatgpt"), ("www.Perplexity.ai/search", "perplexity"), ("google", None), ("foryou.com", None), ("bing.com", "bing"), ("gemini.google.com.", "gemini"), ("", None), ("edge.copilot.cloud.microsoft", "copilot")]


def _pick(values: list, key: str):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_pick(values: list, key: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + f"][{key} % {len(values)} + 1]"


def log_lines(events: DataFrame) -> DataFrame:
    """event_id, file, line: one access-log line an event; each file has one layout, and some lines are cut."""
    day = F.date_format("ts", "yyyy-MM-dd")
    month = F.substring(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), (F.month("ts") - 1) * 3 + 1, F.lit(3))
    common = F.concat(F.substring(day, 9, 2), F.lit("/"), month, F.lit("/"), F.substring(day, 1, 4), F.lit(":"), F.date_format("ts", "HH:mm:ss"), F.lit(" +0500"))
    four = F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256)
    ip = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("2001:db8:"), F.col("user_id") % 8, F.lit("::"), F.col("event_id") % 256)).otherwise(four)
    status = F.when(F.col("value") > 100, 500).when(F.col("value") > 50, 404).when(F.col("value") > 20, 301).otherwise(200)
    size = F.when(F.col("event_id") % 11 == 0, "-").otherwise(F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0)).cast("string"))
    rest = F.concat(F.lit('"GET /'), "event_type", F.lit("/"), "user_id", F.lit(' HTTP/1.1" '), status, F.lit(" "), size, F.lit(' "-" "'), _pick([a for a, _ in _AGENTS], "event_id"), F.lit('"'))
    clf = F.concat(ip, F.lit(" - - ["), common, F.lit("] "), rest)
    iso = F.concat(day, F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("+05:00 "), ip, F.lit(" "), rest)
    whole = F.when(F.col("user_id") % 3 == 0, clf).when(F.col("user_id") % 3 == 1, F.concat(F.lit("shop.example.com:443 "), clf)).otherwise(iso)
    return events.select("event_id", F.col("user_id").alias("file"), F.when(F.col("event_id") % 50 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("line"))


_LAYOUT = "['combined', 'vhost_combined', 'nginx_time_iso'][user_id % 3 + 1]"
_IP = "CASE WHEN event_id % 13 = 0 THEN '2001:db8:' || (user_id % 8) || '::' || (event_id % 256) ELSE '10.0.' || (user_id % 256) || '.' || (event_id % 256) END"
_STATUS = "CASE WHEN value > 100 THEN 500 WHEN value > 50 THEN 404 WHEN value > 20 THEN 301 ELSE 200 END"
_BYTES = "CASE WHEN event_id % 11 = 0 THEN 0 ELSE coalesce(CAST(round(value * 100) AS BIGINT), 0) END"
_KEY = _sql_pick([k for _, k in _AGENTS], "event_id")
_HITS = f"h AS (SELECT *, {_KEY} AS agent_key, {_STATUS} AS status, {_BYTES} AS bytes FROM events WHERE event_id % 50 <> 0)"


def ingest(lines: DataFrame) -> DataFrame:
    """Counters per agent and path of two batches, added up: an upsert that only ever adds."""
    hits = access_log.parse(lines)
    named = hits.withColumn("agent_key", access_log.agent_key(F.col("agent"))).where("agent_key IS NOT NULL")
    sums = lambda rows: rows.groupBy("agent_key", "path").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), F.max(F.to_date("time")).alias("last_day"))
    both = sums(named.where(F.dayofmonth("time") < 16)).unionByName(sums(named.where(F.dayofmonth("time") >= 16)))
    return both.groupBy("agent_key", "path").agg(F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"), F.max("last_day").alias("last_day"))


def register(add: Callable, given: Callable) -> None:
    """Adds this module's queries."""
    logs = lambda work: given("events", lambda e: work(log_lines(e)))
    add("SRC15", logs(lambda x: access_log.parse(x).select("event_id", "layout", "ip", "method", "path", "status", "bytes")),
        f"""SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN {_LAYOUT} END AS layout, CASE WHEN event_id % 50 <> 0 THEN {_IP} END AS ip, CASE WHEN event_id % 50 <> 0 THEN 'GET' END AS method,
        CASE WHEN event_id % 50 <> 0 THEN '/' || event_type || '/' || user_id END AS path, CASE WHEN event_id % 50 <> 0 THEN {_STATUS} END AS status, CASE WHEN event_id % 50 <> 0 THEN {_BYTES} END AS bytes FROM events""")  # fmt: skip
    add("DAT2", logs(lambda x: access_log.parse(x).where("layout IS NOT NULL").select("event_id", F.to_date("time").alias("day"), (F.hour("time") * 3600 + F.minute("time") * 60 + F.second("time")).alias("second"))),
        "SELECT event_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS second FROM events WHERE event_id % 50 <> 0")
    add("FLT12", logs(lambda x: access_log.parse(x).select("event_id", access_log.agent_key(F.col("agent")).alias("agent_key")).withColumn("agent_group", access_log.agent_group(F.col("agent_key"))).where("agent_key IS NOT NULL")),
        f"SELECT event_id, agent_key, CASE agent_key {' '.join(f'''WHEN '{k}' THEN '{g}' ''' for k, g, _ in access_log.AGENTS)} END AS agent_group FROM (SELECT event_id, {_KEY} AS agent_key FROM events WHERE event_id % 50 <> 0) WHERE agent_key IS NOT NULL")
    add("AGG14", logs(lambda x: access_log.counters(access_log.parse(x))),
        f"WITH {_HITS} SELECT agent_key, CAST(ts AS DATE) AS day, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, {', '.join(f'count(CASE WHEN status // 100 = {k} THEN 1 END) AS s{k}xx' for k in (2, 3, 4, 5))} FROM h WHERE agent_key IS NOT NULL GROUP BY 1, 2")
    add("SRC16", logs(ingest), f"WITH {_HITS} SELECT agent_key, '/' || event_type || '/' || user_id AS path, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, max(CAST(ts AS DATE)) AS last_day FROM h WHERE agent_key IS NOT NULL GROUP BY 1, 2")
    add("FLT13", given("events", lambda e: e.select("event_id", urls.assistant(_pick([s for s, _ in _SOURCES], "event_id")).alias("engine")).where("engine IS NOT NULL")),
        f"SELECT * FROM (SELECT event_id, {_sql_pick([k for _, k in _SOURCES], 'event_id')} AS engine FROM events) WHERE engine IS NOT NULL")

    media = ["", "CPC", "organic", None, "newsletter", "billboard", " Social "]
    sources = ["direct", "", "partner"]
    referrers = ["", "https://www.google.co.uk/", "https://chatgpt.com/c/1", "https://old.reddit.com/r/x", "https://blog.example.org/post"]
    by_referrer = ["other", "organic", "ai", "social", "referral"]
    add("FLT14", given("orders", lambda o: o.select("o_orderkey", urls.channel(_pick(sources, "o_custkey"), _pick(media, "o_orderkey"), _pick(referrers, "o_custkey")).alias("channel"))),
        f"""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'paid' WHEN 2 THEN 'organic' WHEN 4 THEN 'email' WHEN 5 THEN 'other' WHEN 6 THEN 'social' ELSE
        CASE WHEN o_custkey % 3 = 0 THEN 'direct' WHEN o_custkey % 5 = 0 AND o_custkey % 3 = 1 THEN 'direct' ELSE {_sql_pick(by_referrer, "o_custkey")} END END AS channel FROM orders""")  # fmt: skip

    # URL forms.
    tracked = "regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|ga_|_ga|mc_[ce]id|vero_|_hs|hsa_|pk_|piwik_)') OR lower(split_part(p, '=', 1)) IN (" + ", ".join(f"'{t}'" for t in urls.TRACKING) + ")"
    parts = "u AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages)"
    canon = f"""{parts}, k AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT ({tracked}))) AS kept FROM u),
        c AS (SELECT page_id, url, scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k)"""
    add("STR3", given("pages", lambda p: p.select("page_id", urls.canonical(F.col("url")).alias("canonical"))), f"WITH {canon} SELECT page_id, canonical FROM c")
    add("STR1", given("pages", lambda p: p.select("page_id", urls.lead_path(F.col("url")).alias("path"))), f"WITH {parts} SELECT page_id, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS path FROM u")
    names = lambda: F.explode(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda x: x != ""))
    add("STR4", given("pages", lambda p: p.select(names().alias("p")).select(F.regexp_extract(F.col("p"), r"^([^=]*)", 1).alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("tracking", urls.is_tracking(F.col("name")))),
        f"WITH {parts}, n AS (SELECT unnest(string_split(query, '&')) AS p FROM u) SELECT split_part(p, '=', 1) AS name, count(*) AS n, bool_or({tracked}) AS tracking FROM n WHERE p <> '' GROUP BY 1")
    add("STR5", given("pages", lambda p: p.select("page_id", F.explode(urls.slug_tokens(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))).alias("token"))),
        f"WITH {parts}, t AS (SELECT page_id, unnest(regexp_split_to_array(lower(path), '[/_.-]+')) AS token FROM u) SELECT page_id, token FROM t WHERE length(token) > 2 AND NOT regexp_matches(token, '^[0-9]+$')")
    add("STR6", given("pages", lambda p: p.groupBy(urls.registrable(urls.host(F.col("url"))).alias("domain")).agg(F.count("*").alias("pages"))),
        f"WITH {parts} SELECT array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(*) AS pages FROM u GROUP BY 1")
    b64 = lambda c: F.regexp_replace(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), "=+$", "")
    wrapped = lambda: F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))).otherwise(F.concat(F.lit("https://www.bing.com/ck/a?u=a1"), b64(F.col("url")), F.lit("&ntb=1")))
    add("STR7", given("pages", lambda p: p.select("page_id", wrapped().alias("link")).select("page_id", urls.unwrapped(F.col("link")).alias("target"))), "SELECT page_id, url AS target FROM pages")
    add("GRF3", given("pages", lambda p: p.withColumn("c", urls.canonical(F.col("url"))).groupBy(F.regexp_replace("c", "^https?", "").alias("key")).agg(F.min_by("url", F.struct(F.length("url"), "url")).alias("url"), F.count("*").alias("variants"))),
        f"WITH {canon} SELECT regexp_replace(canonical, '^https?', '') AS key, arg_min(url, (length(url), url)) AS url, count(*) AS variants FROM c GROUP BY 1")

    networks = "[{'cidr': '10.0.16.0/20', 'name': 'office'}, {'cidr': '10.0.40.0/24', 'name': 'agents'}, {'cidr': '10.0.41.128/25', 'name': 'half'}, {'cidr': '2001:db8:3::/48', 'name': 'six'}]"

    def from_networks(spark, sf_dir):
        """Parsed hits by the network that they come from."""
        hits = access_log.parse(log_lines(table(spark, sf_dir, "events"))).where("layout IS NOT NULL").select("event_id", "ip")
        known = spark.range(1).select(F.explode(F.from_json(F.lit(networks.replace("'", '"')), "array<struct<cidr string, name string>>")).alias("n")).select("n.*")
        return access_log.in_networks(hits, known).select("event_id", "name")

    add("JOIN11", from_networks, """WITH h AS (SELECT event_id, event_id % 13 = 0 AS six, user_id % 256 AS c, event_id % 256 AS d, user_id % 8 AS g FROM events WHERE event_id % 50 <> 0)
        SELECT event_id, 'office' AS name FROM h WHERE NOT six AND c BETWEEN 16 AND 31 UNION ALL SELECT event_id, 'agents' FROM h WHERE NOT six AND c = 40 UNION ALL SELECT event_id, 'half' FROM h WHERE NOT six AND c = 41 AND d >= 128 UNION ALL SELECT event_id, 'six' FROM h WHERE six AND g = 3""")  # fmt: skip

    def never_hit(spark, sf_dir):
        """Paths of pages that no parsed hit has met, whatever the trailing slash."""
        bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z]+://[^/?#]+", ""), r"/*([?#].*)?$", "")
        listed = table(spark, sf_dir, "pages").select("page_id", bare(F.col("url")).alias("path"))
        asked = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id", "ts").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), "url"), "user_id")
        day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        lines = asked.select(F.lit(0).alias("file"), F.concat(day, F.lit('+00:00 10.0.0.1 "GET '), bare(F.col("url")), F.lit('/ HTTP/1.1" 200 5 "-" "x"')).alias("line"))
        return listed.join(access_log.parse(lines).select(bare(F.col("path")).alias("path")).where("path IS NOT NULL").distinct(), "path", "left_anti")

    add("JOIN12", never_hit, f"WITH {parts}, b AS (SELECT page_id, rtrim(path, '/') AS path FROM u) SELECT page_id, path FROM b WHERE path NOT IN (SELECT path FROM b WHERE page_id IN (SELECT user_id FROM events WHERE event_type = 'view'))")
