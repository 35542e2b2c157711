"""Registered queries of this subpackage and their SQL.

Each ``opN_<name>`` reads its whole table, calls its operator and shapes the columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from meterbook.llm import bpe, decontam, filter_audit, langid, licenses, packing, quality, simhash, suffix_dedup, token_files, url_filter, vector_codes, warc
from meterbook.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digests(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digests(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_token_files": op3_token_files,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_packing": op13_packing,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
occ AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP7 = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""

_OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, c, substr(h, 400 * c + 1, 498) AS h FROM (SELECT doc_id, h, unnest(range(0, (n - 50) // 200 + 1)) AS c FROM d WHERE n >= 50)),
w AS (SELECT doc_id, 200 * c + o AS s, substr(h, 2 * o + 1, 100) AS g FROM (SELECT doc_id, c, h, unnest(range(0, least(200, len(h) // 2 - 49))) AS o FROM p)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT w.doc_id AS doc_id, s FROM w JOIN f ON w.g = f.g AND first < doc_id),
m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM m) GROUP BY doc_id, k),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM i),
k AS (SELECT g.doc_id AS doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last
  FROM g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

_OP10 = """
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort([x FOR x IN string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&') IF x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref=')
      AND NOT starts_with(x, 'fbclid=') AND NOT starts_with(x, 'gclid=')]) AS asked
  FROM r),
c AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM p),
listed AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
v AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    canonical IN (SELECT canonical FROM listed) AS hit
  FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""

_STEPS = ", ".join(
    f"('{''.join(order)}', {k + 1}, {1 << 'ABCDE'.index(name)}, {sum(1 << 'ABCDE'.index(x) for x in order[:k])})" for order in permutations("ABCDE") for k, name in enumerate(order)
)

_OP11 = f"""
WITH w AS (SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN id > min(id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
s AS (SELECT * FROM (VALUES {_STEPS}) AS v(filter_order, step, bit, before)),
c AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & bit <> 0 AND m & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM c
"""


def _rounds(count: int) -> str:
    """The rounds of the codebooks: a{k} has each part's nearest entry as distance * 16 + entry."""
    out = []
    for k in range(count + 1):
        out.append(
            f"a{k} AS MATERIALIZED (SELECT r, p.part AS part, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + entry) AS m"
            f" FROM p JOIN c{k} ON p.part = c{k}.part GROUP BY r, p.part)"
        )
        if k < count:
            out.append(
                f"s{k} AS MATERIALIZED (SELECT part, entry, j, CAST((s - ((s % n + n) % n)) // n AS BIGINT) AS v FROM (SELECT part, entry, j, sum(x) AS s, count(*) AS n FROM"
                f" (SELECT p.part AS part, m % 16 AS entry, unnest(x) AS x, unnest(range(len(x))) AS j FROM a{k} JOIN p ON a{k}.r = p.r AND a{k}.part = p.part) GROUP BY part, entry, j)),"
                f" c{k + 1} AS MATERIALIZED (SELECT c{k}.part AS part, c{k}.entry AS entry, coalesce(n.c, c{k}.c) AS c FROM c{k} LEFT JOIN"
                f" (SELECT part, entry, list(v ORDER BY j) AS c FROM s{k} GROUP BY part, entry) AS n ON c{k}.part = n.part AND c{k}.entry = n.entry)"
            )
    return ",\n".join(out)


_OP12 = f"""
WITH n AS MATERIALIZED (
  SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT r, part, list_slice(v, part * (len(v) // 8) + 1, (part + 1) * (len(v) // 8)) AS x FROM n, range(8) AS t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 16),
{_rounds(6)},
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS v, unnest(range(len(c))) AS j FROM c6)),
e AS (SELECT r, string_agg(format('{{:02x}}', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM n JOIN e ON n.r = e.r, h
"""

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": _OP5,
    "op7_warc": _OP7,
    "op8_suffix_dedup": _OP8,
    "op10_url_filter": _OP10,
    "op11_filter_audit": _OP11,
    "op12_vector_codes": _OP12,
}
