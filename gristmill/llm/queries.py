"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers

from gristmill.llm import alignment, bpe, forest_search, language_id, maxent, merkle, mixing, pii, quality, secret_scan, sharding, simhash, url_rules
from gristmill.runtime import table


#: Where the tokenizer files of op10 and op11 lie; parameters of the operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TOKENIZERS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_automaton(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op2_simhash_blocks(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_gru_language(spark, sf_dir):
    return language_id.learn_and_identify(table(spark, sf_dir, "documents"))


def op4_hash_tree_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_robust_outliers(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_fp_growth_urls(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_skip_chain_pii(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_projection_forest(spark, sf_dir):
    return forest_search.search(table(spark, sf_dir, "embeddings"))


def op10_bpe_rank_array(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), *TOKENIZERS)


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_maxent_scores(spark, sf_dir):
    return maxent.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_automaton": op1_secret_automaton,
    "op2_simhash_blocks": op2_simhash_blocks,
    "op3_gru_language": op3_gru_language,
    "op4_hash_tree_shards": op4_hash_tree_shards,
    "op5_robust_outliers": op5_robust_outliers,
    "op6_mix_sources": op6_mix_sources,
    "op7_fp_growth_urls": op7_fp_growth_urls,
    "op8_skip_chain_pii": op8_skip_chain_pii,
    "op9_projection_forest": op9_projection_forest,
    "op10_bpe_rank_array": op10_bpe_rank_array,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_maxent_scores": op13_maxent_scores,
}

ORACLE_SQL = {
    "op6_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
f AS (SELECT level AS free FROM l WHERE cap >= weight * level ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce(weight * free, cap)) AS target FROM l LEFT JOIN f ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE e AS (
  SELECT doc_id, lang, coalesce('+' || lang, '') AS g, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
l AS (
  SELECT doc_id, lang, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || CAST(m AS VARCHAR), '-') || tail) AS altered
  FROM (SELECT *, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS m FROM e)),
r AS (SELECT *, row_number() OVER (ORDER BY g, doc_id, leaf) AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM l),
n AS (
  SELECT g, 0 AS level, pos, leaf AS h, total FROM r
  UNION ALL
  SELECT a.g, a.level + 1, a.pos // 2, sha256(a.h || coalesce(b.h, '')), (a.total + 1) // 2
  FROM n a LEFT JOIN n b ON a.g = b.g AND b.pos = a.pos + 1
  WHERE a.pos % 2 = 0 AND a.total > 1),
s AS (SELECT g, h, level AS depth, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM n WHERE total = 1),
t AS (
  SELECT 0 AS level, pos, h, total FROM s
  UNION ALL
  SELECT a.level + 1, a.pos // 2, sha256(a.h || coalesce(b.h, '')), (a.total + 1) // 2
  FROM t a LEFT JOIN t b ON b.pos = a.pos + 1
  WHERE a.pos % 2 = 0 AND a.total > 1),
p AS (
  SELECT r.id, r.g, 0 AS level, r.pos, r.altered AS f, '' AS beside FROM r
  UNION ALL
  SELECT p.id, p.g, p.level + 1, p.pos // 2, CASE WHEN n.h IS NULL THEN sha256(p.f) WHEN p.pos % 2 = 1 THEN sha256(n.h || p.f) ELSE sha256(p.f || n.h) END, p.beside || coalesce(n.h, '')
  FROM p JOIN s ON p.g = s.g LEFT JOIN n ON n.g = p.g AND n.level = p.level AND n.pos = p.pos + 1 - 2 * (p.pos % 2)
  WHERE p.level < s.depth),
q AS (
  SELECT p.id, 0 AS level, s.pos, p.f, p.beside FROM p JOIN s ON p.g = s.g AND p.level = s.depth
  UNION ALL
  SELECT q.id, q.level + 1, q.pos // 2, CASE WHEN t.h IS NULL THEN sha256(q.f) WHEN q.pos % 2 = 1 THEN sha256(t.h || q.f) ELSE sha256(q.f || t.h) END, q.beside || coalesce(t.h, '')
  FROM q LEFT JOIN t ON t.level = q.level AND t.pos = q.pos + 1 - 2 * (q.pos % 2)
  WHERE q.level < (SELECT max(level) FROM t))
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(q.beside) AS proof_sha256, q.f AS folded_root, q.f = t.h AS verified, r.lang
FROM r JOIN s ON r.g = s.g JOIN q ON q.id = r.id AND q.level = (SELECT max(level) FROM t) CROSS JOIN (SELECT h FROM t WHERE total = 1) t
""",
}
