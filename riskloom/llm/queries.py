"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (decision_list, decontam, id_store, near_dup, packing, plane_hash, prefix_trie, quotes, shallot, site_quality, toxicity,
                          unigram, url_rules)
from riskloom.llm.tables import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [
    url_rules.Rule("allow", "org/"),
    url_rules.Rule("block", "example.org/es/"),
    url_rules.Rule("block", "example.org/en/1"),
    url_rules.Rule("allow", "com/fr/"),
    url_rules.Rule("block", "com/de/"),
]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decision_list.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    s = F.col(site_quality.OWN)
    return out.select("doc_id", s["host"].alias("host"), s["path"].alias("path"), s["evidence"].alias("evidence"),
                      s["site_rate"].alias("site_rate"), s["quality"].alias("quality"), (s["quality"] >= 0.5).alias("kept"))


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = id_store.write_ids(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return id_store.read_ids(spark, manifest)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, sf_dir, "pages"), RULES)


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_threads(read(spark, sf_dir, "conversations"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.clusters(read(spark, sf_dir, "embeddings"), k=8, dims=64, rounds=10, scale=1024, seed="3")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_hash.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_unigram_counts": op2_unigram_counts,
    "op3_decision_list": op3_decision_list,
    "op4_site_quality": op4_site_quality,
    "op5_id_store": op5_id_store,
    "op6_toxicity": op6_toxicity,
    "op7_url_rules": op7_url_rules,
    "op8_quotation_threads": op8_quotation_threads,
    "op9_near_dup": op9_near_dup,
    "op10_decontaminate": op10_decontaminate,
    "op11_centroids": op11_centroids,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_near_dup": op13_vector_near_dup,
}


def _centroids_sql(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """Plain k-means, one pair of tables a round."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(kept.v) AS v,
         min({{'d': list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS m
  FROM kept, c{r} GROUP BY vec_id
)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
  SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY 1, 2
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(f.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c) f ON f.c = c{r}.c
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, m.c::INT AS cluster, m.d AS distance,
       (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = m.c
"""

ORACLE_SQL: dict[str, str] = {
    "op7_url_rules": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(rule, verdict, rhost, rpath) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
  ('com/de/', 'block', 'com', '/de/')
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f USING (page_id)
""",
    "op11_centroids": _centroids_sql(),
    "op12_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         (list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) & 3) AS low
  FROM (SELECT DISTINCT conv_id FROM own)
), parts AS (  -- the register is inverted at the end, so its last two bits are 3 - low
  SELECT convs.conv_id, 0 AS side, own.pos, role, text FROM convs JOIN own ON own.conv_id = base WHERE pos < 3 - low
  UNION ALL
  SELECT convs.conv_id, 1, own.pos, role, text FROM convs JOIN own USING (conv_id) WHERE pos >= 3 - low
), turns AS (
  SELECT conv_id, {'r': role, 't': text} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS pos FROM parts
), whole AS (
  SELECT conv_id, coalesce(list(turn ORDER BY pos) FILTER (turn IS NOT NULL), []) AS seq FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id
), member AS (
  SELECT conv_id, d AS depth, seq[:d] AS node, d = len(seq) AS ends FROM whole, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)
), node AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(node[depth].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM member GROUP BY node, depth
), kids AS (
  SELECT node[:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2
), known AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (node, depth)
), below AS (
  SELECT node[:d] AS node, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM known, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) GROUP BY 1, 2
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN below b ON b.node = k.node AND b.depth = k.depth
LEFT JOIN node p ON p.depth = k.depth - 1 AND p.node = k.node[:k.depth - 1]
""",
    "op13_vector_near_dup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
), n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT r.x AS vec_id, coalesce(any_value(n_links), 0) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM reach r LEFT JOIN n ON n.x = r.x GROUP BY r.x
""",
}
