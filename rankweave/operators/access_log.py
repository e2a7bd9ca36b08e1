"""Access-log lines in three layouts to typed rows, and the agents that asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a line, as the servers' log format documents name them: %h and $remote_addr may be an IPv6 address or
#: a host name, %t stands in brackets, "%r" is method, target and protocol, %>s and %b follow, and then "%{Referer}i"
#: and "%{User-agent}i" where the format has them.
_HOST, _WORD, _CLOCK = r"([0-9A-Za-z._:%-]+)", r"\S+", r"\[([^\]]*)\]"
_ISO = r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)"
_ANSWER = r'"([A-Za-z]+) ([^" ]+)(?: [^"]*)?" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
#: Layouts with the groups of ip, time, method, path, status, bytes and agent. The names are fixed values.
LAYOUTS = {
    "combined": (f"^{_HOST} {_WORD} {_WORD} {_CLOCK} {_ANSWER}", (1, 2, 3, 4, 5, 6, 8)),
    "vhost_combined": (rf"^{_WORD}:\d+ {_HOST} {_WORD} {_WORD} {_CLOCK} {_ANSWER}", (1, 2, 3, 4, 5, 6, 8)),
    "nginx_time_iso": (f"^{_ISO} {_HOST} {_ANSWER}", (2, 1, 3, 4, 5, 6, 8)),
}
_FIELDS = ("ip", "time", "method", "path", "status", "bytes", "agent")

#: Agent key, group and pattern; the first pattern met names the agent.
AGENTS = [
    ("googlebot", "search", r"googlebot(?!-image|-video|-news)|google-inspectiontool"),
    ("googlebot-image", "search", r"googlebot-image"),
    ("googlebot-video", "search", r"googlebot-video"),
    ("google-other", "search", r"googleother"),
    ("google-extended", "ai-training", r"google-extended"),
    ("adsbot", "ads", r"adsbot-google"),
    ("bingbot", "search", r"bingbot|adidxbot"),
    ("bing-preview", "search", r"bingpreview"),
    ("duckduckbot", "search", r"duckduckbot"),
    ("yandexbot", "search", r"yandex(bot|images)"),
    ("baiduspider", "search", r"baiduspider"),
    ("applebot", "search", r"applebot(?!-extended)"),
    ("applebot-extended", "ai-training", r"applebot-extended"),
    ("oai-searchbot", "ai-retrieval", r"oai-searchbot"),
    ("chatgpt-user", "ai-retrieval", r"chatgpt-user"),
    ("gptbot", "ai-training", r"gptbot"),
    ("claudebot", "ai-training", r"claudebot"),
    ("claude-user", "ai-retrieval", r"claude-user|claude-web"),
    ("perplexitybot", "ai-retrieval", r"perplexitybot"),
    ("perplexity-user", "ai-retrieval", r"perplexity-user"),
    ("meta-ai", "ai-training", r"meta-externalagent|facebookbot|meta-externalfetcher"),
    ("bytespider", "ai-training", r"bytespider"),
    ("amazonbot", "ai-training", r"amazonbot"),
    ("ahrefsbot", "seo-tool", r"ahrefsbot"),
    ("semrushbot", "seo-tool", r"semrushbot"),
    ("mj12bot", "seo-tool", r"mj12bot"),
    ("dotbot", "seo-tool", r"dotbot"),
    ("screamingfrog", "seo-tool", r"screaming frog"),
    ("other-bot", "other", r"bot\b|crawler|spider|crawl|slurp|scrape|http-client|python-requests|curl\/|wget"),
]


def _once(value: Column, work: Callable[[Column], Column]) -> Column:
    """work over value, bound once: where a filter moves down, the optimizer can't copy the expression behind
    the value into every place that work uses it."""
    return F.get(F.transform(F.array(value), work), F.lit(0))


def agent_key(agent: Column) -> Column:
    """The first known agent whose pattern the string meets; null for people."""
    first = lambda a: F.coalesce(*(F.when(a.rlike("(?i)" + pattern), key) for key, _, pattern in AGENTS))
    return _once(agent, first)


def agent_group(key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, g, _ in AGENTS for x in (k, g))), key)


def wall_time(time: Column) -> Column:
    """The time as written: a zone offset is left out, so that a day of the log stays that day."""

    def read(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, r"^([0-9]{2})/([A-Za-z]{3})/([0-9]{4}):([0-9]{2}:[0-9]{2}:[0-9]{2})", k)
        month = F.lpad(F.floor((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), part(2)) + 2) / 3).cast("string"), 2, "0")
        common = F.concat(part(3), F.lit("-"), month, F.lit("-"), part(1), F.lit(" "), part(4))
        iso = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
        return F.coalesce(common.try_cast("timestamp_ntz"), iso.try_cast("timestamp_ntz"))

    return _once(time, read)


def layout_votes(lines: DataFrame, by: str) -> DataFrame:
    """How many lines of each file meet each layout; the file's layout is the one most lines meet. All lines
    vote, by sums under conditions, so a file of any size is one row of partial sums a task."""
    meets = {k: F.count_if(F.col("line").rlike(p)) for k, (p, _) in LAYOUTS.items()}
    votes = lines.groupBy(by).agg(F.count("*").alias("lines"), *(n.alias(k) for k, n in meets.items()))
    best = F.greatest(*LAYOUTS)
    return votes.withColumn("layout", F.when(best > 0, F.coalesce(*(F.when(F.col(k) == best, k) for k in LAYOUTS))))


def parse(lines: DataFrame, by: str | None = "file") -> DataFrame:
    """Typed fields of each line, by the layout that most lines of its file meet (by None: the first layout
    that the line itself meets); lines that don't meet it keep nulls. All fields come from one pass of the
    layout's pattern. The votes are one row a file and are broadcast up to 100,000 files."""
    cut = lambda p, groups: F.split(F.regexp_replace("line", p + r"[\s\S]*$", "\u0001".join(f"${g}" for g in groups)), "\u0001")
    meets = [(k, F.col("line").rlike(p), cut(p, groups)) for k, (p, groups) in LAYOUTS.items()]
    if by is None:
        found = lines.withColumn("layout", F.coalesce(*(F.when(m, k) for k, m, _ in meets)))
    else:
        votes = layout_votes(lines, by).select(by, F.col("layout").alias("voted"))
        few = votes.limit(100_001).count() <= 100_000
        found = lines.join(F.broadcast(votes) if few else votes, by, "left")
        found = found.withColumn("layout", F.coalesce(*(F.when((F.col("voted") == k) & m, k) for k, m, _ in meets))).drop("voted")
    found = found.withColumn("cut", _once(F.col("layout"), lambda x: F.coalesce(*(F.when(x == k, c) for k, _, c in meets))))
    typed = {f: F.get("cut", F.lit(place)) for place, f in enumerate(_FIELDS)}
    typed["status"] = typed["status"].cast("int")
    typed["bytes"] = F.when(F.col("layout").isNotNull(), F.coalesce(typed["bytes"].try_cast("long"), F.lit(0)))
    return found.withColumns(typed).withColumn("time", wall_time(F.col("time"))).drop("cut")


def address(ip: Column) -> Column:
    """An address in canonical form: 8 hexadecimal digits for IPv4, 32 for IPv6, whatever way it is written
    (leading zeros, `::`, an IPv4 address at its end, letters of either case); null for anything else."""
    text = F.lower(F.trim(ip))
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    quad = rf"{octet}\.{octet}\.{octet}\.{octet}$"
    digits = lambda k: F.lpad(F.lower(F.hex(F.regexp_extract(text, quad, k).try_cast("long"))), 2, "0")
    four = F.when(text.rlike("^" + quad), F.concat(*map(digits, range(1, 5))))
    tail = F.when(text.rlike(":" + quad), F.concat(digits(1), digits(2), F.lit(":"), digits(3), digits(4)))
    plain = F.when(text.contains("."), F.concat(F.regexp_replace(text, r"[^:]*$", ""), tail)).otherwise(text)

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    halves = F.split(plain, "::")
    left, right = groups(F.get(halves, F.lit(0))), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    given = F.size(left) + F.size(right)
    whole = (F.size(halves) == 2) & (given < 8) | (F.size(halves) == 1) & (given == 8)
    known = whole & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.when(known, 8 - given).otherwise(0)), right)
    six = F.when(known, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))
    return F.coalesce(four, six)


def prefix(digits: Column, bits: Column) -> Column:
    """The first bits of an address in canonical form, as a key: whole digits, and what is left of the next one."""
    rest = (F.conv(F.substring(digits, F.floor(bits / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int") / F.pow(F.lit(2), 4 - bits % 4)).cast("int")
    return F.concat_ws("/", F.substring(digits, F.lit(1), F.floor(bits / 4).cast("int")), F.when(bits % 4 > 0, F.hex(rest)))


def in_networks(hits: DataFrame, networks: DataFrame) -> DataFrame:
    """hits (with ip) and the names of the networks (cidr, name) that hold them. The networks are a binary trie by
    levels: those of one length meet the addresses on so many first bits, an equi-join. An address has a key for
    each length that its family's networks have (33 and 129 at most). What isn't an address or a network is in none."""
    base, bits = address(F.substring_index("cidr", "/", 1)), F.substring_index("cidr", "/", -1).try_cast("int")
    known = networks.select("name", base.alias("digits"), bits.alias("bits")).where("digits IS NOT NULL AND bits BETWEEN 0 AND 4 * length(digits)")
    nets = known.select("name", F.length("digits").alias("family"), "bits", prefix(F.col("digits"), F.col("bits")).alias("key"))
    levels = [(r["family"], r["bits"]) for r in nets.select("family", "bits").distinct().collect()]  # 162 at most
    digits = F.col("digits")
    own = F.array_compact(F.array(*(F.when(F.length(digits) == family, F.struct(F.lit(family).alias("family"), F.lit(n).alias("bits"), prefix(digits, F.lit(n)).alias("key"))) for family, n in levels)))
    if not levels:
        return hits.join(nets.select("name"), F.lit(False))
    placed = hits.withColumn("digits", address(F.col("ip"))).where("digits IS NOT NULL").withColumn("at", F.explode(own))
    same = [F.col(f"at.{c}") == nets[c] for c in ("family", "bits", "key")]
    return placed.join(nets, same).select(*hits.columns, "name")


def counters(hits: DataFrame) -> DataFrame:
    """Hits, bytes and status bands of each agent and day."""
    band = lambda k: F.count_if(F.floor(F.col("status") / 100) == k).alias(f"s{k}xx")
    named = hits.withColumn("agent_key", agent_key(F.col("agent"))).where("agent_key IS NOT NULL AND time IS NOT NULL")
    return named.groupBy("agent_key", F.to_date("time").alias("day")).agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), *map(band, (2, 3, 4, 5)))
