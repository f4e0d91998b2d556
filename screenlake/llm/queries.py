"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm import bpe, exact_dedup, html_text, language_id, mixing, near_dedup, passages, prefix_trie, quality, repeats, token_counts, topk, whitening
from screenlake.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("exact")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5, scale=256)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("keep_len")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.QualityModel.fit(docs).transform(docs)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    return mixing.mix(table(spark, sf_dir, "documents"), power=0.5, keep_share=0.5, tokens=lambda texts: count(texts)[1])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.Passages(table(spark, sf_dir, "documents")).report()


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.Repeats(table(spark, sf_dir, "documents"), least=200).removed()


def shared_heads(conv_id: Column) -> tuple[Column, Column]:
    """crc32(id) % 4 first turns come from the conversation whose id is the next lower multiple of 20."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4, conv_id - conv_id % 20


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), shared_heads, most=3)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000, components=16)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_collinear_passages": op9_collinear_passages,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_html_text": op13_html_text,
}

SQL = {
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op4_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM words
), rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * common >= 75 * (na + nb - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
""",
    "op5_exact_dedup": r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), best AS (
  SELECT text_sha256, first(doc_id ORDER BY len DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM norm GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM norm JOIN best USING (text_sha256)
""",
    "op11_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT *, (4294967295 - list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))) % 4 AS h
  FROM own
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s
  FROM headed c LEFT JOIN headed b ON b.conv_id = c.conv_id - c.conv_id % 20
), members AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built),
keyed AS (SELECT conv_id, d, len(s) AS size, s[1:d] AS k, CASE WHEN d > 0 THEN s[1:d - 1] END AS pk FROM members),
nodes AS (
  SELECT k, any_value(pk) AS pk, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM keyed GROUP BY k
), children AS (SELECT pk AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY pk),
own_part AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d > 0 THEN (n - 1) * len(regexp_extract_all(nodes.k[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saving
  FROM nodes LEFT JOIN children USING (k)
), sums AS (
  SELECT a.k, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(u.saving)::BIGINT AS saved_tokens
  FROM own_part u JOIN keyed a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY a.k
)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM own_part v JOIN sums USING (k) LEFT JOIN nodes p ON p.k = v.pk
""",
}
