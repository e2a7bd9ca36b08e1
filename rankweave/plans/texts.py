"""Queries on texts and search phrases: stems, named things, sentiment, intent, similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators import content, cosines, language, overlap
from rankweave.sources import phrases, site
from rankweave.sources.phrases import KEYWORDS, MENTIONS
from rankweave.sources.tables import table

_STOP = ["to", "of", "is", "in", "the", "what", "how", "me"]
_WORD = "[a-z0-9][a-z0-9''-]*"
_TERMS = f"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')) AS term FROM documents)"""


def _duck_text_stem(w: str) -> str:
    cut = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= 4 THEN left({w}, length({w}) - {len(s)})" for s in language.TEXT_SUFFIXES)
    return f"CASE WHEN length({w}) <= 4 THEN {w} ELSE regexp_replace(CASE {cut} ELSE {w} END, 'i$', 'y') END"


def _duck_phrase_stem(w: str, lang: str = "en") -> str:
    cut = " ".join(f"WHEN {w} LIKE '%{s}' AND length({w}) >= {n} THEN left({w}, length({w}) - {len(s)})" + (" || 'y'" if (lang, s) == ("en", "ies") else "") for s, n in language.PHRASE_SUFFIXES[lang])
    return f"CASE WHEN length({w}) <= 3 THEN {w} {cut} ELSE {w} END"


_TOKENS = f"""k AS (SELECT keyword, impressions, clicks, page, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(keyword, '[^a-z0-9\\s''-]', ' ', 'g'), '[\\s-]+'),
    lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)), lambda w: {_duck_phrase_stem("w")}))) AS tokens FROM keywords)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.keywords(spark, sf_dir).withColumn("tokens", language.phrase_tokens(F.col("keyword"), _STOP))


def _intents(keywords: DataFrame) -> DataFrame:
    """keyword, intent and score of single phrases: weight of the kind met, halved for a place by preposition."""
    hits = keywords.select("keyword", language.intent_hits(F.col("keyword")).alias("h"))
    at = lambda k: F.get("h", F.lit(k))
    local = next(k for k, (name, *_) in enumerate(language.INTENTS) if name == "Local")
    scores = [F.struct((F.when(at(k), weight * 1.0).when(at(len(language.INTENTS)), weight / 2) if k == local else F.when(at(k), weight * 1.0)).alias("score"), F.lit(-k).alias("first"), F.lit(name).alias("intent")) for k, (name, weight, _) in enumerate(language.INTENTS)]
    best = hits.select("keyword", F.array_max(F.filter(F.array(*scores), lambda s: s["score"].isNotNull())).alias("b"))
    return best.select("keyword", F.coalesce("b.intent", F.lit("Informational")).alias("intent"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def _duck_intents() -> str:
    parts = []
    for k, (name, weight, pattern) in enumerate(language.INTENTS):
        hit = f"regexp_matches(keyword, '{pattern}')"
        if name == "Local":
            weak = f"regexp_matches(keyword, '\\b(?:near|in)\\s+[a-z][a-z.''-]{{2,}}\\b') AND NOT list_contains({language.NOT_PLACES + [x for x in language.WIDE_PLACES if chr(39) not in x]}, regexp_extract(keyword, '\\b(?:near|in)\\s+([a-z][a-z.''-]{{2,}})\\b', 1))"
            parts.append(f"SELECT keyword, '{name}' AS intent, {k} AS k, CASE WHEN {hit} THEN {weight}.0 WHEN {weak} THEN {weight / 2} END AS score FROM keywords")
        else:
            parts.append(f"SELECT keyword, '{name}' AS intent, {k} AS k, CASE WHEN {hit} THEN {weight}.0 END AS score FROM keywords")
    return f"""WITH {KEYWORDS}, s AS ({' UNION ALL '.join(parts)}), b AS (SELECT * FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY score DESC, k) = 1)
        SELECT w.keyword, coalesce(intent, 'Informational') AS intent, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM keywords w LEFT JOIN b ON b.keyword = w.keyword"""


def _stuffing(docs: DataFrame) -> DataFrame:
    """doc_id, term, n, density (percent of tokens) and clustered: terms over 3.5 percent of at least fifty
    tokens; clustered if seven of ten of them stand in one tenth of the text."""
    tokens = content.tokens(docs).select("doc_id", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "term")).where("size >= 50")
    tenth = F.floor(F.col("at") * 10 / F.col("size"))
    spread = tokens.groupBy("doc_id", "size", "term", tenth.alias("tenth")).agg(F.count("*").alias("k"))
    found = spread.groupBy("doc_id", "size", "term").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    return found.where((F.col("n") * 1000 > F.col("size") * 35) & (F.length("term") > 3)).select("doc_id", "term", "n", F.round(F.col("n") * 100 / F.col("size"), 4).alias("density"), (F.col("most") * 10 >= F.col("n") * 7).alias("clustered"))


def _readable(docs: DataFrame) -> DataFrame:
    """doc_id, words, sentences, ease (Flesch, 0 to 100), grade, long_sentences and passives."""
    text = F.coalesce("text", F.lit(""))
    sentences = F.filter(F.split(text, r"[.!?]+\s*"), lambda s: s.rlike("[A-Za-z]"))
    words = F.size(content.all_matches(F.lower(text), content.TOKEN))
    syllables = F.size(content.all_matches(F.lower(text), r"[aeiouy]+"))
    long_ = F.size(F.filter(sentences, lambda s: F.size(content.all_matches(F.lower(s), content.TOKEN)) > 30))
    passive = F.size(content.all_matches(F.lower(text), r"\b(?:is|are|was|were|been|being|be) [a-z]+ed\b"))
    base = docs.select("doc_id", words.alias("words"), F.size(sentences).alias("sentences"), syllables.alias("syllables"), long_.alias("long_sentences"), passive.alias("passives"))
    each, per = F.try_divide(F.col("words") * 1.0, F.col("sentences") * 1.0), F.try_divide(F.col("syllables") * 1.0, F.col("words") * 1.0)
    ease, grade = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * each - 84.6 * per)), 0.39 * each + 11.8 * per - 15.59
    known = each.isNotNull() & per.isNotNull()
    return base.select("doc_id", "words", "sentences", F.when(known, F.round(ease, 4)).alias("ease"), F.when(known, F.round(grade, 4)).alias("grade"), "long_sentences", "passives")


def _consensus(docs: DataFrame) -> DataFrame:
    """source, terms and covered: stems that at least half of a source's languages' texts share, and how many
    of them its English texts have."""
    stems = content.tokens(docs).join(docs.select("doc_id", "source", "lang"), "doc_id").select("source", "lang", F.explode("tokens").alias("t")).where("length(t) > 2").select("source", "lang", language.text_stem(F.col("t")).alias("term")).distinct()
    kinds = stems.groupBy("source").agg(F.countDistinct("lang").alias("k"))
    common = stems.groupBy("source", "term").agg(F.count("*").alias("langs"), F.max((F.col("lang") == "en").cast("int")).alias("own"))
    wanted = common.join(kinds, "source").where(F.col("langs") >= F.greatest(F.lit(2), F.ceil(F.col("k") / 2)))
    return wanted.groupBy("source").agg(F.count("*").alias("terms"), F.sum("own").alias("covered"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, phrase and at: where a benchmark item's first four words stand verbatim in a document."""
    phrases_ = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), r"[^a-z]+").alias("w")).where("size(w) >= 6").select("item_id", F.slice("w", 1, 4).alias("w"))
    phrases_ = phrases_.select("item_id", F.array_join("w", " ").alias("phrase")).groupBy("phrase").agg(F.min("item_id").alias("item_id"))
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+").alias("w")).where("size(w) >= 4")
    runs = words.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("at", "phrase"))
    return runs.join(phrases_, "phrase").groupBy("doc_id", "item_id").agg(F.min("at").cast("long").alias("first"), F.count("*").alias("n"))


def _confidence(mentions: DataFrame) -> DataFrame:
    text = F.lower("said")
    level = F.when(text.contains("shop.example"), "certain").when(text.contains("widget forum") | text.rlike(r"\bwidgets?\b"), "likely").when(F.size(content.all_matches(text, content.TOKEN)) < 4, "unassessable").otherwise("unclear")
    return mentions.select("conv_id", "turn", level.alias("confidence"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title segments that stand on at least a quarter of the pages, and three: labels, not titles."""
    from rankweave.operators import documents

    titles = documents.read(site.crawl(spark, sf_dir)).where("title IS NOT NULL").select("page_id", F.concat("title", F.lit(" | Shop"), F.when(F.col("page_id") % 3 == 0, " - Sale").otherwise("")).alias("t"))
    many = titles.agg(F.greatest(F.lit(3), F.ceil(F.count("*") / 4)).alias("bound"))
    parts = titles.select("page_id", F.explode(F.split("t", r"\s+[|-]\s+")).alias("segment"))
    return parts.groupBy("segment").agg(F.countDistinct("page_id").alias("pages")).join(F.broadcast(many), F.col("pages") >= F.col("bound")).select("segment", "pages")


def register(add: Callable, given: Callable) -> None:
    """Adds this module's queries."""
    term = lambda d: content.tokens(d).select(F.explode("tokens").alias("term")).distinct()
    add("STR9", given("documents", lambda d: term(d).select("term", language.text_stem(F.col("term")).alias("stem"), *(language.phrase_stem(F.col("term"), x).alias(x) for x in language.PHRASE_SUFFIXES))),
        f"WITH {_TERMS} SELECT DISTINCT term, {_duck_text_stem('term')} AS stem, {', '.join(_duck_phrase_stem('term', x) + f' AS {x}' for x in language.PHRASE_SUFFIXES)} FROM t")
    add("STR13", given("documents", lambda d: d.select("doc_id", language.named(F.coalesce("text", F.lit(""))).alias("e"), F.size(content.all_matches(F.coalesce("text", F.lit("")), language.STATISTIC)).alias("figures"), F.size(content.all_matches(F.lower(F.coalesce("text", F.lit(""))), content.TOKEN)).alias("words")).select("doc_id", F.size("e").alias("named"), "figures", F.coalesce(F.round(F.try_divide(F.size(F.array_distinct("e")) * 100.0, F.col("words") * 1.0), 4), F.lit(0.0)).alias("density"))),
        f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_extract_all('. ' || coalesce(text, ''), '(?:[.!?]\\s+)?[A-Z][a-z''-]+(?: +[A-Z][a-z''-]+)*'), lambda x: NOT regexp_matches(x, '^[.!?]') OR regexp_matches(x, ' [A-Z][a-z''-]+ +[A-Z]')) AS e FROM documents),
        b AS (SELECT *, list_transform(e, lambda x: regexp_replace(x, '^[.!?]\\s+', '')) AS n, len(regexp_extract_all(lower(text), '{_WORD}')) AS words FROM r)
        SELECT doc_id, CAST(len(n) AS INTEGER) AS named, CAST(len(regexp_extract_all(text, '{language.STATISTIC}')) AS INTEGER) AS figures, CASE WHEN words > 0 THEN round(len(list_distinct(n)) * 100.0::DOUBLE / words, 4) ELSE 0 END AS density FROM b""")
    add("STR14", given("documents", lambda d: d.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p")).where("trim(p) <> ''").groupBy("doc_id").agg(F.count("*").alias("passages"), F.count_if(language.passage_points(F.col("p")) >= 65).alias("strong"), F.sum(language.passage_points(F.col("p"))).alias("points"))),
        f"""WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p FROM documents), s AS (SELECT doc_id, CASE WHEN regexp_matches(lower(trim(p)), '{language.OPENERS}') THEN 0 ELSE 40 END
            + CASE WHEN len(regexp_extract_all(p, '[0-9]')) >= 2 OR regexp_matches(p, '[0-9]') AND regexp_matches(p, '%|\\$|£|€|\\b(19|20)\\d{{2}}\\b') THEN 25 ELSE 0 END + CASE WHEN len(regexp_extract_all(lower(p), '{_WORD}')) BETWEEN 40 AND 120 THEN 25 ELSE 0 END
            + CASE WHEN len(regexp_extract_all(lower(regexp_extract(p, '^[^.!?]*', 0)), '{_WORD}')) BETWEEN 1 AND 30 THEN 10 ELSE 0 END AS pts FROM p WHERE trim(p, ' ') <> '')
        SELECT doc_id, count(*) AS passages, count(CASE WHEN pts >= 65 THEN 1 END) AS strong, CAST(sum(pts) AS BIGINT) AS points FROM s GROUP BY 1""")
    add("STR15", lambda s, d: phrases.mentions(s, d).select("conv_id", "turn", language.sentiment(F.col("said")).alias("score"), language.risk(F.col("said")).alias("risk")), f"WITH {MENTIONS} SELECT conv_id, turn, CAST(score AS DOUBLE) AS score, risk FROM mentions")
    add("ALR44", lambda s, d: phrases.mentions(s, d).select("conv_id", "turn", "day", language.risk(F.col("said")).alias("risk")).where("risk IS NOT NULL AND turn % 3 <> 0").where(F.col("day") > F.lit("2024-01-27").cast("date")), f"WITH {MENTIONS} SELECT conv_id, turn, day, risk FROM mentions WHERE risk IS NOT NULL AND turn % 3 <> 0 AND day > DATE '2024-01-27'")
    add("STR22", lambda s, d: _confidence(phrases.mentions(s, d)), f"WITH {MENTIONS} SELECT conv_id, turn, CASE WHEN k % 5 = 0 THEN 'certain' WHEN k % 5 IN (1, 2) THEN 'likely' WHEN k % 5 = 3 AND k % 8 IN (0, 5, 6, 7) THEN 'unassessable' ELSE 'unclear' END AS confidence FROM mentions")
    add("STR16", lambda s, d: phrases.keywords(s, d).select("keyword", language.place_key(F.col("keyword")).alias("place")), f"""WITH {KEYWORDS} SELECT keyword, CASE WHEN keyword LIKE '%austin' THEN 'austin' WHEN keyword LIKE '%london' THEN 'london' WHEN keyword LIKE '%new york' THEN 'newyork' ELSE '' END AS place FROM keywords""")
    add("STR17", lambda s, d: _intents(phrases.keywords(s, d)), _duck_intents())
    kinds = ", ".join(f"('{v}', '{i}', '{p}')" for (v, i), p in language.PAGE_TYPES.items())
    add("STR18", given("part", lambda p: p.select("p_partkey", language.page_type(F.when(F.col("p_partkey") % 2 == 0, "shop").otherwise("press"), F.element_at(F.array(*(F.lit(n) for n, *_ in language.INTENTS)), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("page"))),
        f"""WITH k(vertical, intent, page) AS (VALUES {kinds}), q AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'shop' ELSE 'press' END AS v, {[n for n, *_ in language.INTENTS]}[p_partkey % 5 + 1] AS i FROM part)
        SELECT p_partkey, coalesce(a.page, b.page) AS page FROM q LEFT JOIN k a ON a.vertical = v AND a.intent = i LEFT JOIN k b ON b.vertical = 'default' AND b.intent = i""")
    add("STR24", given("documents", _stuffing), f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents), t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term, unnest(range(len(w))) AS k FROM d WHERE len(w) >= 50),
        s AS (SELECT doc_id, size, term, k * 10 // size AS tenth, count(*) AS c FROM t GROUP BY ALL), f AS (SELECT doc_id, size, term, CAST(sum(c) AS BIGINT) AS n, max(c) AS most FROM s GROUP BY ALL)
        SELECT doc_id, term, n, round(n * 100.0::DOUBLE / size, 4) AS density, most * 10 >= n * 7 AS clustered FROM f WHERE n * 1000 > size * 35 AND length(term) > 3""")
    add("STR12", given("documents", _readable), f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{_WORD}')) AS INTEGER) AS words, list_filter(regexp_split_to_array(text, '[.!?]+\\s*'), lambda s: regexp_matches(s, '[A-Za-z]')) AS ss,
            len(regexp_extract_all(lower(text), '[aeiouy]+')) AS syllables, CAST(len(regexp_extract_all(lower(text), '\\b(?:is|are|was|were|been|being|be) [a-z]+ed\\b')) AS INTEGER) AS passives FROM d),
        c AS (SELECT *, CASE WHEN len(ss) > 0 AND words > 0 THEN words::DOUBLE / len(ss) END AS e, CASE WHEN len(ss) > 0 AND words > 0 THEN syllables::DOUBLE / words END AS p FROM b)
        SELECT doc_id, words, CAST(len(ss) AS INTEGER) AS sentences, round(greatest(0.0, least(100.0, 206.835 - 1.015 * e - 84.6 * p)) + 0 * e, 4) AS ease, round(0.39 * e + 11.8 * p - 15.59, 4) AS grade,
            CAST(len(list_filter(ss, lambda s: len(regexp_extract_all(lower(s), '{_WORD}')) > 30)) AS INTEGER) AS long_sentences, passives FROM c""")
    add("STR27", _anchors, """WITH b AS (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM benchmark), p AS (SELECT array_to_string(w[1:4], ' ') AS phrase, min(item_id) AS item_id FROM b WHERE len(w) >= 6 GROUP BY 1),
        d AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') AS w FROM documents), r AS (SELECT doc_id, w, unnest(range(len(w) - 3)) AS k FROM d WHERE len(w) >= 4), q AS (SELECT doc_id, k, array_to_string(w[k + 1 : k + 4], ' ') AS phrase FROM r)
        SELECT doc_id, item_id, min(k) AS "first", count(*) AS n FROM q JOIN p USING (phrase) GROUP BY 1, 2""")
    add("STR28", _labels, f"""WITH {site.FACTS}, t AS (SELECT p, title || ' | Shop' || CASE WHEN p % 3 = 0 THEN ' - Sale' ELSE '' END AS t FROM ok WHERE title IS NOT NULL), n AS (SELECT greatest(3, ceil(count(*) / 4)) AS bound FROM t),
        s AS (SELECT p, unnest(regexp_split_to_array(t, '\\s+[|-]\\s+')) AS segment FROM t) SELECT segment, count(DISTINCT p) AS pages FROM s, n GROUP BY segment, bound HAVING count(DISTINCT p) >= bound""")
    ratio = lambda: F.try_divide((F.col("elapsed_ms") % 100).cast("double"), (F.col("page_id") % 7 * 20).cast("double"))
    add("STR29", lambda s, d: site.crawl(s, d).select("page_id", F.when(ratio().isNull(), "unknown").when(ratio() <= 0.4, "shell").when(ratio() < 0.75, "partial").otherwise("ok").alias("verdict")),
        f"WITH {site.FACTS}, r AS (SELECT p, CASE WHEN p % 7 > 0 THEN (elapsed_ms % 100)::DOUBLE / (p % 7 * 20) END AS r FROM site) SELECT p AS page_id, CASE WHEN r IS NULL THEN 'unknown' WHEN r <= 0.4 THEN 'shell' WHEN r < 0.75 THEN 'partial' ELSE 'ok' END AS verdict FROM r")

    # Similarity.
    vectors = f"WITH {_TERMS}, c AS (SELECT doc_id AS id, term, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT id, sqrt(sum(n * n)) AS norm, sum(n) AS words FROM c GROUP BY id)"
    add("JOIN19", given("documents", lambda d: cosines.text_cosines(content.tokens(d).withColumnRenamed("doc_id", "id"), 0.9, 100)), f"{vectors} SELECT x.id AS a, y.id AS b, round(sum(x.n * y.n) / (p.norm * q.norm), 6) AS cosine FROM c x JOIN c y ON x.term = y.term AND x.id < y.id JOIN m p ON p.id = x.id JOIN m q ON q.id = y.id WHERE p.words >= 100 AND q.words >= 100 GROUP BY x.id, y.id, p.norm, q.norm HAVING sum(x.n * y.n) / (p.norm * q.norm) >= 0.9 - 1e-9")
    titles = lambda s, d: phrases.keywords(s, d).select(F.col("keyword").alias("id"), F.explode(language.phrase_tokens(F.col("keyword"), _STOP)).alias("term"), F.lit(1).alias("n"))
    add("MTH2", lambda s, d: cosines.cosine_pairs(titles(s, d), 0.8), f"""WITH {KEYWORDS}, {_TOKENS}, u AS (SELECT keyword AS id, unnest(tokens) AS term, sqrt(len(tokens)) AS norm FROM k)
        SELECT x.id AS a, y.id AS b, round(count(*) / (x.norm * y.norm), 6) AS cosine FROM u x JOIN u y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id, x.norm, y.norm HAVING count(*) / (x.norm * y.norm) >= 0.8 - 1e-9""")
    def rivals(s: SparkSession, d: str) -> DataFrame:
        """Phrases that compete: on the same page's behalf from 0.30 on, else from 0.55 on with three tokens shared."""
        near = cosines.cosine_pairs(titles(s, d), 0.3)
        heads = _tokens(s, d).select("keyword", "page", "tokens")
        met = near.join(heads.select(F.col("keyword").alias("a"), F.col("page").alias("pa"), F.col("tokens").alias("x")), "a").join(heads.select(F.col("keyword").alias("b"), F.col("page").alias("pb"), F.col("tokens").alias("y")), "b")
        return met.where((F.col("pa") == F.col("pb")) | ((F.col("cosine") >= 0.55) & (F.size(F.array_intersect("x", "y")) >= 3))).select("a", "b", "cosine")

    add("JOIN17", rivals, f"""WITH {KEYWORDS}, {_TOKENS}, u AS (SELECT keyword AS id, page, unnest(tokens) AS term, sqrt(len(tokens)) AS norm FROM k),
        c AS (SELECT x.id AS a, y.id AS b, x.page = y.page AS same, count(*) AS shared, round(count(*) / (x.norm * y.norm), 6) AS cosine FROM u x JOIN u y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id, x.norm, y.norm, x.page, y.page)
        SELECT a, b, cosine FROM c WHERE (same AND cosine >= 0.3) OR (cosine >= 0.55 AND shared >= 3)""")
    add("JOIN18", given("documents", lambda d: overlap.near_copies(d, "doc_id", "text")), """WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM d WHERE len(w) >= 5),
        r AS (SELECT s, min(id) AS rep FROM s GROUP BY s), u AS (SELECT rep, len(s) AS n, unnest(s) AS m FROM r),
        l AS (SELECT x.rep AS a, y.rep AS b FROM u x JOIN u y ON x.m = y.m AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), c AS (SELECT rep, rep AS low FROM r UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.rep), k AS (SELECT rep, min(low) AS class_id FROM c GROUP BY rep)
        SELECT d.id, coalesce(k.class_id, d.id) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.rep) AS links FROM d LEFT JOIN s ON s.id = d.id LEFT JOIN r ON r.s = s.s LEFT JOIN k ON k.rep = r.rep""")
    add("AUD6", given("pages", lambda p: overlap.near_copies(p, "page_id", "html").where("links > 0 OR class_id <> id")), """WITH d AS (SELECT page_id AS id, list_filter(regexp_split_to_array(lower(coalesce(html, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM pages),
        s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM d WHERE len(w) >= 5), r AS (SELECT s, min(id) AS rep FROM s GROUP BY s), u AS (SELECT rep, len(s) AS n, unnest(s) AS m FROM r),
        l AS (SELECT x.rep AS a, y.rep AS b FROM u x JOIN u y ON x.m = y.m AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*)))
        SELECT s.id, least(r.rep, coalesce((SELECT min(a) FROM l WHERE l.b = r.rep), r.rep)) AS class_id, (SELECT count(*) FROM l WHERE a = r.rep OR b = r.rep) AS links FROM s JOIN r ON r.s = s.s WHERE links > 0 OR r.rep <> s.id""")
    add("MTH4", lambda s, d: overlap.mean_jaccard(_tokens(s, d).select(F.col("page").alias("group"), F.col("keyword").alias("id"), "tokens")), f"""WITH {KEYWORDS}, {_TOKENS}, o AS (SELECT page, keyword, tokens, row_number() OVER (PARTITION BY page ORDER BY keyword) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM k),
        x AS (SELECT * FROM o WHERE i % CAST(ceil(n / 40) AS BIGINT) = 0) SELECT a.page AS "group", max(a.n) AS members, round(avg(len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens)))), 6) AS cohesion FROM x a JOIN x b ON a.page = b.page AND a.keyword < b.keyword GROUP BY 1""")
    add("AGG31", given("pages", lambda p: overlap.template_blocks(p, 0.02)), r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:p|li|h1|h2|div)[^>]*>([^<]+)', 1)) AS b FROM pages), n AS (SELECT greatest(3, ceil(count(*) * 0.02)) AS bound FROM pages),
        c AS (SELECT DISTINCT page_id, trim(regexp_replace(lower(b), '\s+', ' ', 'g')) AS block FROM b) SELECT block, count(*) AS pages FROM c, n WHERE block <> '' GROUP BY block, bound HAVING count(*) >= bound""")
    add("AGG32", given("documents", _consensus), f"""WITH x AS (SELECT source, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')) AS t FROM documents), s AS (SELECT DISTINCT source, lang, {_duck_text_stem('t')} AS term FROM x WHERE length(t) > 2),
        n AS (SELECT source, count(DISTINCT lang) AS k FROM s GROUP BY 1), c AS (SELECT source, term, count(*) AS langs, max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS own FROM s GROUP BY ALL)
        SELECT source, count(*) AS terms, CAST(sum(own) AS BIGINT) AS covered FROM c JOIN n USING (source) WHERE langs >= greatest(2, ceil(k / 2)) GROUP BY 1""")
