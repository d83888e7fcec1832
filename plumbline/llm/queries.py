"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprint, jaccard, language, packing, pii, secrets, toxicity, warc, wordbpe
from .common import documents

#: The separator token of the packing vocabulary; its file and pattern come from the installed tokenizers.
PACK_SPECIAL = {"<|endoftext|>": 50256}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return packing.pack_documents(documents(spark, sf_dir), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, PACK_SPECIAL)


def op2_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.crawl(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), ";")
    return found.select("record_id", ((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "url_key", "ts", "source_id", "outcome", "digest", pairs.alias("headers"))


def op5_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir)).drop("spans_found")


def op6_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return wordbpe.encode_documents(documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json"))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op8_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


def op10_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_pii_lstm_crf, op3_exact_dedup, op4_warc_revisits, op5_secret_linking, op6_bpe_prefix_dp, op7_language_crf, op8_prefix_fingerprints, op9_ngram_jaccard_join, op10_toxicity_pu)}

ORACLES = {
    "op4_warc_revisits": r"""
        WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS digest FROM pages),
        again AS (SELECT *, regexp_replace(regexp_replace(url, '^https?://', 'HTTPS://WWW.') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=again', '(#[^?]*)([?].*)$', '\2\1') AS url2 FROM p),
        log AS (
            SELECT page_id * 2 AS record_id, url, page_id * 10 AS ts, 'response' AS type, digest[1:16] AS etag, digest,
                   'content-type=text/html' AS own, 'day ' || CAST(page_id AS VARCHAR) AS day FROM p
            UNION ALL
            SELECT page_id * 2 + 1, url2, page_id * 10 + CASE WHEN page_id % 5 = 0 THEN -5 ELSE 100000 END, 'revisit',
                   CASE page_id % 3 WHEN 0 THEN digest[1:16] WHEN 1 THEN 'other' END, digest, '', '' FROM again),
        cut AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/@?]*@)?', '') AS rest FROM log),
        keyed AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\d*\.', '') AS host,
                   regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                   list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS params FROM cut),
        named AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM keyed),
        found AS (SELECT q.record_id, q.url_key, q.ts, q.etag AS q_etag, q.digest AS q_digest, s.record_id AS s_id, s.etag AS s_etag, s.digest AS s_digest, s.own, s.day
                  FROM (SELECT * FROM named WHERE type = 'revisit') q ASOF LEFT JOIN (SELECT * FROM named WHERE type = 'response') s ON q.url_key = s.url_key AND q.ts > s.ts),
        judged AS (SELECT *, CASE WHEN s_id IS NULL THEN 'missing' WHEN q_etag IS NOT NULL AND q_etag = s_etag THEN 'resolved'
                   WHEN q_etag IS NULL AND q_digest = s_digest THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found)
        SELECT record_id, CAST((record_id - 1) / 2 AS BIGINT) AS page_id, url_key, ts, CASE WHEN outcome = 'resolved' THEN s_id END AS source_id, outcome,
               CASE WHEN outcome = 'resolved' THEN s_digest ELSE q_digest END AS digest,
               CASE WHEN outcome = 'resolved' THEN 'cache-control=no-cache;content-type=text/html;date=now;etag=' || s_etag ELSE 'cache-control=no-cache;content-type=text/plain;date=now' END AS headers
        FROM judged""",
    "op5_secret_linking": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
        rules(kind, name, role, strong, pattern, least) AS (VALUES
          (0, 'assign', 'secret', true, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0),
          (1, 'access', 'access', true, 'AKIA[A-Z0-9]+', 18), (2, 'hex', 'secret', true, '[0-9a-f]+', 16),
          (3, 'link_access', 'access', false, '(?i:client_?id|access_?key(?:_?id)?|user_?name|account)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._@-]{6,}', 0),
          (4, 'link_secret', 'secret', false, '[A-Za-z0-9+/=]+', 40), (5, 'link_endpoint', 'endpoint', false, 'https?://[^ \t\n\x0B\f\r"''<>]+', 0)),
        cut AS (SELECT doc_id, r, kind, name, role, strong, least, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS g FROM t, rules WHERE regexp_matches(text, pattern)),
        each AS (SELECT doc_id, r, kind, name, role, strong, least, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS k FROM cut),
        ends AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY k) AS e FROM each),
        part AS (SELECT r, kind, name, role, strong, e - length(m) AS s, e FROM ends
          WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 12
                          WHEN 4 THEN length(m) = 40 AND NOT contains(m, '=') ELSE length(m) >= least END),
        near AS (SELECT p.r, p.kind, p.s, p.e, bool_or(q.role = 'access') AS a, bool_or(q.role = 'secret') AS b FROM part p JOIN part q ON p.r = q.r AND greatest(p.s - q.e, q.s - p.e) BETWEEN 0 AND 200 WHERE NOT p.strong GROUP BY ALL),
        kept AS (SELECT p.* FROM part p LEFT JOIN near n USING (r, kind, s, e)
          WHERE p.strong OR (p.role <> 'secret' AND NOT p.role = 'endpoint' AND n.b) OR (p.role = 'secret' AND n.a) OR (p.role = 'endpoint' AND n.a AND n.b)),
        shown AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
          string_agg(concat(name, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(concat(name, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, kind, e) AS spans FROM kept GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN shown USING (r)""",
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
}
