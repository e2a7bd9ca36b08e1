"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bpe, dialogue_repair, language_id, line_rules, media, mixing, sharding, signature_tree, toxicity, vector_codes, warc, weak_labels
from rankweave.llm.near_dup import near_duplicates
from rankweave.llm.shared import fold_of, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer's vocabulary file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, for all documents."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those outside the fold crc32(doc_id) mod 4 = 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, on 4-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes stored as 8-bit audio, its features as Arrow tensors, and both read back."""
    return media.digests(media.store_features(table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by sources of weight 5, 2, 1, to 150% of all words."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, and what the archives' records say when read back."""
    return warc.archived_index(table(spark, sf_dir, "pages"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of line-first cleaning for all documents."""
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the votes of heuristic labellers."""
    return weak_labels.quality_scores(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the fold crc32(doc_id) mod 5 = 0."""
    docs, held_out = table(spark, sf_dir, "documents"), fold_of("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of even row counts, equal texts together as far as room goes."""
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 16 parts, 64 entries each, 2 rounds, components times 256."""
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents linked on 3-word shingles at a similarity of 0.9."""
    return signature_tree.similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with faults put in, and their cheapest repairs."""
    verdicts, _ = dialogue_repair.repair(dialogue_repair.damaged(table(spark, sf_dir, "conversations")))
    return verdicts


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media, "op2_bpe": op2_bpe, "op3_mixing": op3_mixing, "op4_warc": op4_warc, "op5_line_rules": op5_line_rules,
    "op6_weak_labels": op6_weak_labels, "op7_toxicity": op7_toxicity, "op8_language": op8_language, "op9_sharding": op9_sharding, "op10_minhash": op10_minhash,
    "op11_vector_codes": op11_vector_codes, "op12_signature_tree": op12_signature_tree, "op13_dialogue_repair": op13_dialogue_repair,
}
def vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The plain definition: every part against every entry, a round at a time."""
    assign = lambda k: f"""
        d{k} AS (SELECT q.rid, q.part, b.entry, q.x, list_sum([(q.x[i] - b.x[i]) * (q.x[i] - b.x[i]) FOR i IN generate_series(1, len(q.x))]) AS d
                FROM pieces q JOIN b{k} b USING (part)),
        a{k} AS (SELECT rid, part, min_by(entry, d * {entries} + entry) AS entry, min(d) AS d, any_value(x) AS x FROM d{k} GROUP BY rid, part)"""  # noqa: E731
    means = lambda k: f"""
        m{k} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (
                SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v FROM a{k}, generate_series(1, len(x)) AS g(i) GROUP BY part, entry, i) GROUP BY part, entry),
        b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""  # noqa: E731
    steps = ",".join(f"{assign(k)},{means(k)}" for k in range(rounds))
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
                [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        pieces AS MATERIALIZED (SELECT rid, p AS part, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, generate_series(0, {parts - 1}) AS g(p)),
        b0 AS (SELECT part, rid - 1 AS entry, x FROM pieces WHERE rid <= {entries}),{steps},{assign(rounds)},
        coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
        books AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b{rounds}, generate_series(1, len(x)) AS g(i))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (rid) CROSS JOIN books
    """


def dialogue_repair_sql() -> str:
    """Faults by windows; the cheapest edits row by row, with the best (cost, audit) for each thing that may have come
    last: nothing (z), a system row (s), a user's (u), a pair (p)."""
    add = lambda x, cost, letters, lines: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letters}', 't': {x}.t || {lines}}} END"
    least = lambda *xs: f"list_sort([x FOR x IN [{', '.join(xs)}] IF x IS NOT NULL])[1]"
    user, answer = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    pair = f"{user} || {answer}"
    new_user = [add("z", 3, "I", user), add("s", 3, "I", user), add("p", 3, "I", user)]
    new_pair = [add("u", 3, "I", answer), add("z", 6, "II", pair), add("s", 6, "II", pair)]
    row = lambda x, cost, letter, line: f"CASE WHEN NOT must THEN {add(x, f'{cost} + late', letter, line)} END"
    as_user = lambda x: [f"CASE WHEN ini = 'u' THEN {row(x, 0, 'K', 'line')} END", row(x, 3, "R", f"{user} || text")]
    as_answer = [f"CASE WHEN ini = 'a' THEN {row('cu', 0, 'K', 'line')} END", row("cu", 3, "R", f"{answer} || text")]
    gone = lambda x: add(x, 4, "D", "''")
    space = r"\x20\x09-\x0D"
    return rf"""
        WITH RECURSIVE table_steps AS (
            SELECT i, i AS v, 0 AS k FROM generate_series(0, 255) AS g(i)
            UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM table_steps WHERE k < 8),
        crcs AS (SELECT list(v ORDER BY i) AS vs FROM table_steps WHERE k = 8),
        keys AS (SELECT DISTINCT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        crc AS (
            SELECT conv_id, turn, key, 0 AS pos, CAST(4294967295 AS BIGINT) AS v FROM keys
            UNION ALL SELECT conv_id, turn, key, pos + 1, xor(v >> 8, vs[(xor(v, ascii(substr(key, pos + 1, 1))) & 255) + 1]) FROM crc, crcs WHERE pos < length(key)),
        kinds AS (SELECT conv_id, turn, xor(v, 4294967295) % 20 AS kind FROM crc WHERE pos = length(key)),
        damaged AS (
            SELECT c.conv_id, c.turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, kind
            FROM conversations c JOIN kinds k ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND c.turn IS NOT DISTINCT FROM k.turn),
        copied AS (SELECT * FROM damaged WHERE kind <> 0 UNION ALL SELECT * FROM damaged WHERE kind = 3),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, left(role, 1) AS ini,
                   NOT regexp_matches(text, '[^{space}]') AS blank, NOT regexp_matches(text, '[.!?][{space}]*\z') AS unended
            FROM copied),
        placed AS (
            SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again FROM numbered),
        faults AS MATERIALIZED (
            SELECT *, blank OR again AS must, CASE WHEN unended AND NOT blank AND NOT again THEN 3 ELSE 0 END AS late, chr(10) || role || ':' || text AS line FROM placed),
        walk AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS z, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s,
                   CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS p FROM conversations
            UNION ALL
            SELECT conv_id, rn, {gone("z")}, {least(gone("s"), f"CASE WHEN ini = 's' THEN {row('z', 0, 'K', 'line')} END")},
                   {least(gone("cu"), *as_user("z"), *as_user("s"), *as_user("cp"))}, {least(gone("cp"), *as_answer)}
            FROM (SELECT w.*, f.rn AS next, f.* EXCLUDE (conv_id, rn), {least("u", *new_user)} AS cu, {least("p", *new_pair)} AS cp
                  FROM walk w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.rn = w.rn + 1) AS x(conv_id, was, z, s, u, p, rn, turn, role, text, kind, ini, blank, unended, before, again, must, late, line, cu, cp)),
        ends AS (SELECT conv_id, {least("z", "p", *new_pair)} AS e FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1),
        counted AS (
            SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (late > 0) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id)
        SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, e.c AS cost, e.a AS audit, sha256(substr(e.t, 2)) AS repaired_sha256
        FROM ends LEFT JOIN counted c ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
    """


#: Only what SQL expresses as a whole; the other queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op13_dialogue_repair": dialogue_repair_sql(),
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
        FROM f
    """,
}
