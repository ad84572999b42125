"""The registered queries of the subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm.common import ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op01_cotraining import score
    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op02_langid import identify
    return identify(_read(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op03_suffix_dedup import suffix_dedup
    return suffix_dedup(_read(spark, sf_dir, "documents"))


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op04_toxicity import score
    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op05_secret_ledger import secrets
    return secrets(_read(spark, sf_dir, "documents"))


def op6_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op06_lm_difference import score
    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_bpe_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op07_bpe import encode_documents
    return encode_documents(_read(spark, sf_dir, "documents"), keep_ids=False)


def op8_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op08_decontam import decontaminate
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op09_exact_dedup import exact_dedup
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op10_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op10_minhash import near_dedup
    return near_dedup(_read(spark, sf_dir, "documents"), size=3, percent=85)


def op11_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op11_warc import round_trip
    return round_trip(_read(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op12_prefix_trie import prefix_trie
    return prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scour.llm.op13_whitening import whiten
    return whiten(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


_SQL_OP9 = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def _kind_sql(kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{kind}' AS kind, before + gap AS b, before + gap + hit AS e, val FROM (
  SELECT doc_id, gap, hit, val, coalesce(sum(gap + hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
         AND 1 PRECEDING), 0) AS before FROM (
    SELECT doc_id, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, length(vals[i]) AS val FROM (
      SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM (
        SELECT doc_id, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits,
               regexp_extract_all(text, '{p}', {group}) AS vals FROM documents WHERE text IS NOT NULL))))
WHERE val >= {least}"""


_SQL_OP5 = "WITH s AS (" + "\nUNION ALL".join([
    _kind_sql("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    _kind_sql("access", "AKIA[A-Z0-9]+", 0, 16),
    _kind_sql("hex", "[0-9a-f]+", 0, 32)]) + """),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ','
             ORDER BY b, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)
"""

# Bare base32 of the digest's 40 hex digits: five of them are 20 bits, four characters.
_SQL_OP11 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
         (CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM g
"""

# crc32 of a number's ASCII digits, bit by bit.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
    lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), CAST(4294967295 AS BIGINT))"""

_SQL_OP12 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
             ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS giver, {_CRC.format(c="conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.giver AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
s AS (SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS size,
             string_agg(sha256(length(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS node FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, depth, size, sha256(node) AS node FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS total FROM m GROUP BY conv_id),
n AS (SELECT node, min(m.depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
             coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE m.depth = e.total), '') AS ends
      FROM m JOIN e USING (conv_id) GROUP BY node),
up AS (SELECT n.node, n.depth, m.node AS above, m.depth AS above_depth, n.n_convs, n.size FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth),
k AS (SELECT above AS node, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY above),
u AS (SELECT up.above AS node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((up.n_convs - 1) * up.size) AS saved
      FROM up LEFT JOIN k ON k.node = up.node GROUP BY up.above),
p AS (SELECT up.node, n.conv_id AS parent_conv_id FROM up JOIN n ON n.node = up.above WHERE up.above_depth = up.depth - 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN p USING (node) LEFT JOIN k USING (node) JOIN u USING (node)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_cotraining, op2_ecoc_langid, op3_suffix_array, op4_ftrl_toxicity, op5_secret_ledger, op6_lm_difference, op7_bpe_perfect_hash, op8_simhash_decontam, op9_extendible_dedup, op10_tensor_minhash, op11_warc_salvage, op12_prefix_trie,
                         op13_refined_whitening)
}
ORACLE_SQL: dict[str, str] = {"op5_secret_ledger": _SQL_OP5, "op9_extendible_dedup": _SQL_OP9, "op11_warc_salvage": _SQL_OP11,
                               "op12_prefix_trie": _SQL_OP12}
