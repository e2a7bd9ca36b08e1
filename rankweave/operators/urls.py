"""URL forms and traffic classes, as column functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track a visit.
TRACKING_PREFIX = r"^(utm_|ga_|_ga|mc_[ce]id|vero_|_hs|hsa_|pk_|piwik_)"
TRACKING = (
    "gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "igshid", "yclid", "twclid", "ttclid", "li_fat_id", "ref", "referrer", "source", "campaign",
    "trk", "sessionid", "phpsessid", "jsessionid", "cid", "epik", "s_kwcid", "gad_source", "srsltid", "mkt_tok",
)

#: Assistants and the hosts that their referrals name.
ASSISTANTS = {
    "chatgpt": ("chatgpt.com", "chat.openai.com", "openai.com"),
    "perplexity": ("perplexity.ai",),
    "gemini": ("gemini.google.com", "bard.google.com"),
    "copilot": ("copilot.microsoft.com", "copilot.cloud.microsoft"),
    "claude": ("claude.ai",),
    "meta-ai": ("meta.ai",),
    "grok": ("grok.com", "x.ai"),
    "deepseek": ("deepseek.com",),
    "mistral": ("mistral.ai",),
    "you": ("you.com",),
    "poe": ("poe.com",),
    "phind": ("phind.com",),
    "huggingface": ("huggingface.co",),
    "bing": ("bing.com",),
}

#: Referrer hosts and utm media of the lead channels.
AI_HOSTS = r"(^|\.)(chatgpt\.com|chat\.openai\.com|perplexity\.ai|claude\.ai|copilot\.microsoft\.com|gemini\.google\.com)$"
SEARCH_HOSTS = r"(^|\.)(google\.[a-z.]+|bing\.com|duckduckgo\.com|yahoo\.[a-z.]+|yandex\.[a-z.]+|baidu\.com|ecosia\.org|brave\.com|search\.marginalia\.nu)$"
SOCIAL_HOSTS = r"(^|\.)(facebook\.com|instagram\.com|linkedin\.com|t\.co|twitter\.com|x\.com|reddit\.com|pinterest\.[a-z.]+|tiktok\.com|youtube\.com)$"
MEDIA = {
    "organic": ("organic", "natural", "seo"),
    "paid": ("cpc", "ppc", "paid", "paidsearch", "paid_search", "display", "cpm", "retargeting"),
    "email": ("email", "newsletter"),
    "social": ("social", "social-network", "social_media", "paid-social"),
    "referral": ("referral",),
    "direct": ("none", "(none)", "direct"),
    "ai": ("ai", "llm"),
}
_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]+)(:[0-9]+)?([^?#]*)(\?[^#]*)?"
_TWO_LEVEL = ("co", "com", "org", "net", "gov", "ac", "edu")


def host(url: Column) -> Column:
    """Lower-case host without www; empty for what is no absolute URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)), r"^www\.", "")


def registrable(name: Column) -> Column:
    """The last two labels of a host, three under a two-level suffix such as co.uk."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    wide = (n > 2) & F.element_at(labels, -2).isin(*_TWO_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    keep = F.when(wide, 3).otherwise(F.least(n, F.lit(2)))
    return F.array_join(F.slice(labels, n - keep + 1, keep), ".")


def is_tracking(name: Column) -> Column:
    return F.lower(name).rlike(TRACKING_PREFIX) | F.lower(name).isin(*TRACKING)


def canonical(url: Column) -> Column:
    """Lower-case host without www and default port, no fragment, no trailing slash, sorted parameters
    without the tracking ones; null for what is no absolute URL."""
    scheme, port = F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 3)
    port = F.when((scheme == "http") & (port == ":80") | (scheme == "https") & (port == ":443"), "").otherwise(port)
    query = F.regexp_replace(F.regexp_extract(url, _URL, 5), r"^\?", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~is_tracking(F.regexp_extract(p, r"^([^=]*)", 1))))
    path = F.regexp_replace(F.regexp_extract(url, _URL, 4), "/+$", "")
    joined = F.concat(scheme, F.lit("://"), host(url), port, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(url.rlike(_URL), joined)


def lead_path(url: Column) -> Column:
    """Path of a full or bare URL: decoded, index file names dropped, no trailing slash; case is kept."""
    bare = F.regexp_extract(F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    short = F.regexp_replace(F.regexp_replace(decoded, r"(?i)/(index|default)\.(html?|php|aspx?)$", "/"), r"/+$", "")
    return F.when(F.trim(url) != "", F.when(short.startswith("/"), short).otherwise(F.concat(F.lit("/"), short)))


def slug_tokens(path: Column) -> Column:
    """Parts of a path of three or more characters that aren't numbers."""
    return F.filter(F.split(F.lower(path), r"[/_.-]+"), lambda x: (F.length(x) > 2) & ~x.rlike(r"^[0-9]+$"))


def assistant(source: Column) -> Column:
    """The assistant that a referral source names, by whole host or subdomain; null for all others."""
    name = F.regexp_replace(F.regexp_extract(F.lower(F.trim(source)), r"^([^/\s?]*)", 1), r"\.$", "")
    meets = lambda hosts: reduce(lambda a, b: a | b, ((name == h) | name.endswith("." + h) for h in hosts))
    return F.coalesce(*(F.when(meets(hosts), key) for key, hosts in ASSISTANTS.items()))


def channel(source: Column, medium: Column, referrer: Column) -> Column:
    """Channel of a lead: its medium decides, then a direct source, then the referrer's host."""
    m, s, r = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (medium, source, referrer))
    named = F.coalesce(*(F.when(m.isin(*names), key) for key, names in MEDIA.items()), F.lit("other"))
    h = host(r)
    by_host = F.when(h == "", "other").when(h.rlike(AI_HOSTS), "ai").when(h.rlike(SEARCH_HOSTS), "organic").when(h.rlike(SOCIAL_HOSTS), "social").otherwise("referral")
    return F.when(m != "", named).when(s.isin("direct", "(direct)"), "direct").when(r == "", F.when(s == "", "direct").otherwise("other")).otherwise(by_host)


def unwrapped(link: Column) -> Column:
    """The target behind a result page's redirect (an encoded `uddg`, or `u=a1` and base64url); else the link."""
    encoded, packed = F.regexp_extract(link, r"[?&]uddg=([^&#]*)", 1), F.translate(F.regexp_extract(link, r"[?&]u=a1([^&#]*)", 1), "-_", "+/")
    padded = F.rpad(packed, F.ceil(F.length(packed) / 4).cast("int") * 4, F.lit("="))
    return F.when(encoded != "", F.coalesce(F.try_url_decode(encoded), link)).when(packed != "", F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), link)).otherwise(link)
