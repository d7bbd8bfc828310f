"""The operators' queries, over whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprint, html_text, lexical, merkle, packing, pii, quality, secrets, simhash, token_counts, url_filter
from . import pipeline as stages
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by words into windows of 2048, no two pieces of one source or duplicate cluster in a window."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", packing.word_count(F.col("text")).alias("units"), packing.content_cluster(F.col("text")).alias("cluster"))
    return packing.pack(sized, "units")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "key")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: hosts with a listed word, and the addresses of junk pages."""
    pages = table(spark, sf_dir, "pages")
    listed = url_filter.listed_hosts(pages).unionByName(url_filter.listed_junk(pages))
    return url_filter.judge_urls(pages.select("page_id", "url"), listed).select("page_id", *(f"judged.{c}" for c in ("host", "path", "rule", "verdict")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key=pii.session_key(spark), counts="found").select("doc_id", "text", *(F.col(f"found.{k}").alias(f"n_{k}") for k in pii.KINDS))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op10_version_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.version_fingerprints(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as an event log, replayed, rendered and read back."""
    return chat.digest_columns(chat.format_log(chat.log_of(chat.with_probe(table(spark, sf_dir, "conversations")))))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_html_extraction, op3_quality_classifier, op4_secret_scan, op5_decontamination, op6_url_filter, op7_simhash_near_dedup, op8_pii_pseudonyms, op9_token_counts, op10_version_fingerprints, op11_merkle_manifest, op12_chat_formatting, op13_ranked_search, pipeline)
}

_ESCAPED = r"replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '<|', '<\|'), '|>', '|\>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
              FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
        p AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
              FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
        h AS (SELECT doc_id, i, p.size, item_id FROM p JOIN g ON p.size = g.size AND p.gram = g.gram),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_url_filter": r"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
              FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
        junk AS (SELECT DISTINCT host AS junk_host, path AS junk_path FROM u JOIN pages USING (page_id)
                 WHERE regexp_matches(html, '[%*#$]{3} .*[%*#$]{3} .*[%*#$]{3} ') AND host <> '' AND starts_with(path, '/')),
        bad AS (SELECT DISTINCT page_id FROM u JOIN junk ON (host = junk_host OR ends_with(host, '.' || junk_host)) AND (path = junk_path OR ends_with(junk_path, '/') AND starts_with(path, junk_path)))
        SELECT page_id, host, path, rule,
               CASE WHEN rule IS NOT NULL THEN v WHEN regexp_matches(host, 'casino|poker|jackpot|viagra') AND starts_with(path, '/') THEN 'block' WHEN page_id IN (SELECT page_id FROM bad) THEN 'block' ELSE 'allow' END AS verdict
        FROM u LEFT JOIN m USING (page_id)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
                   sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) AS claimed FROM documents),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves),
        level(lang, k, d) AS (
            SELECT lang, 0, list(leaf ORDER BY rank) FROM numbered GROUP BY lang
            UNION ALL SELECT lang, k + 1, list_transform(range(0, len(d), 2), lambda i: sha256(d[i + 1] || coalesce(d[i + 2], ''))) FROM level WHERE len(d) > 1),
        levels AS MATERIALIZED (SELECT * FROM level),
        subroots AS (SELECT lang, d[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM levels WHERE len(d) = 1),
        up(k, d) AS (
            SELECT 0, list(subroot ORDER BY rank) FROM subroots
            UNION ALL SELECT k + 1, list_transform(range(0, len(d), 2), lambda i: sha256(d[i + 1] || coalesce(d[i + 2], ''))) FROM up WHERE len(d) > 1),
        steps AS (
            SELECT n.lang, n.doc_id, n.leaf, l.k, (n.rank >> l.k) % 2 AS odd, coalesce(l.d[xor(n.rank >> l.k, 1) + 1], '') AS other
            FROM numbered n JOIN levels l ON l.lang IS NOT DISTINCT FROM n.lang WHERE len(l.d) > 1
            UNION ALL SELECT n.lang, n.doc_id, n.leaf, 1000 + u.k, (s.rank >> u.k) % 2, coalesce(u.d[xor(s.rank >> u.k, 1) + 1], '')
            FROM numbered n JOIN subroots s ON s.lang IS NOT DISTINCT FROM n.lang, up u WHERE len(u.d) > 1),
        proofs AS (SELECT doc_id, leaf, list(odd || other ORDER BY k) AS path FROM steps GROUP BY doc_id, leaf),
        check_sum AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda h, b:
            list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM (SELECT DISTINCT doc_id FROM documents)),
        folded AS (
            SELECT n.doc_id, n.leaf, s.subroot, p.path,
                   list_reduce(list_prepend(CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN claimed ELSE n.leaf END, coalesce(p.path, [])), lambda h, step: CASE WHEN step[1] = '1' THEN sha256(step[2:] || h) ELSE sha256(h || step[2:]) END) AS folded_root
            FROM numbered n JOIN subroots s ON s.lang IS NOT DISTINCT FROM n.lang LEFT JOIN proofs p ON p.doc_id = n.doc_id AND p.leaf = n.leaf JOIN check_sum c ON c.doc_id = n.doc_id)
        SELECT f.doc_id, leaf, subroot, u.d[1] AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = u.d[1] AS verified
        FROM folded f, up u WHERE len(u.d) = 1""",
    "op12_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        said AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                        3 + sum(2 + length({_ESCAPED.format("role")}) + 3 + length({_ESCAPED.format("text")}) + 5) AS formatted_chars FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said""",
    "op13_ranked_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, whole WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
        scored AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
                   FROM q JOIN w USING (term) JOIN tf USING (term) JOIN size USING (doc_id), whole GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
