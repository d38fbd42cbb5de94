"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import bpe, cap_filters, edit_fingerprints, hard_negatives, html_text, manifest, mixing, passages, rules, secret_scan, sharding, simhash, warc

VOCABULARY = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, directory: str) -> DataFrame:
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), full=False)


def op2_main_text(spark: SparkSession, directory: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{directory}/pages.parquet"))


def op3_warc(spark: SparkSession, directory: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{directory}/pages.parquet"))


def op4_passages(spark: SparkSession, directory: str) -> DataFrame:
    return passages.passage_classes(spark.read.parquet(f"{directory}/documents.parquet"))


def op5_shards(spark: SparkSession, directory: str) -> DataFrame:
    placed = sharding.balanced_shards(spark.read.parquet(f"{directory}/documents.parquet"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_secrets(spark: SparkSession, directory: str) -> DataFrame:
    return secret_scan.scan(spark.read.parquet(f"{directory}/documents.parquet"))


def op7_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mixed(spark.read.parquet(f"{directory}/documents.parquet")).drop("h")


def op8_cap_filters(spark: SparkSession, directory: str) -> DataFrame:
    return cap_filters.near_duplicates(spark.read.parquet(f"{directory}/embeddings.parquet"), 0.98)


def op9_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{directory}/documents.parquet"), words=3, distance=3)


def op10_quality(spark: SparkSession, directory: str) -> DataFrame:
    return rules.judged(spark.read.parquet(f"{directory}/documents.parquet"))


def op11_edit_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return edit_fingerprints.edit_report(spark.read.parquet(f"{directory}/documents.parquet"))


def op12_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Columns as leaves in the order doc_id, source, lang, n_chars, text; every third key is tampered with."""
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    every_third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest.verified_manifest(docs, columns, "doc_id", "lang", every_third, {"text": lower})


def op13_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Anchors are the keys divisible by 50; keys divisible by 7 first get the next label of ten."""
    vectors = spark.read.parquet(f"{directory}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_bpe, op2_main_text, op3_warc, op4_passages, op5_shards, op6_secrets, op7_mix, op8_cap_filters, op9_simhash, op10_quality, op11_edit_fingerprints, op12_manifest, op13_hard_negatives)
    return {f.__name__: f for f in every}


OP3 = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, CASE WHEN octet_length(body) >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS head FROM p
)
SELECT page_id, regexp_replace(url, '[\\r\\n]', ' ', 'g') AS url, CAST(octet_length(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM page_id THEN head END AS refers_to
FROM f
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN l ON r.other = l.a
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id
"""

OP10 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, words[i:i + 7] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
            OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM c
"""

def _tree_sql(name: str, levels: int) -> str:
    """Levels name0 (g, idx, h, c nodes in the group) to name{levels}, and the siblings of each node below."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}{k + 1} AS MATERIALIZED (
  SELECT g, idx // 8 AS idx, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h, (max(c) + 7) // 8 AS c
  FROM {name}{k} GROUP BY g, idx // 8),
{name}s{k} AS MATERIALIZED (
  SELECT a.g, a.idx, any_value(a.c) AS c, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.idx // 8 = b.idx // 8 GROUP BY a.g, a.idx)""")
    return ",".join(out)


def _op12_sql(levels: int = 7, above: int = 4) -> str:
    """The manifest by whole levels, for up to 8^7 documents of a language and 8^4 languages."""
    field = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"
    # bit by bit over the digits: a byte enters with the first of its eight steps
    bytes_ = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), {step}), 4294967295)"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = [("l", k, f"a.g AND s.idx = a.idx // {8**k}") for k in range(levels)] + [("t", k, f"'' AND s.idx = r.idx // {8**k}") for k in range(above)]
    joins = "\n".join(f"JOIN {n}s{k} AS {n}x{k} ON {n}x{k}.g = {on.replace('s.idx', f'{n}x{k}.idx')}" for n, k, on in steps)
    folds, at = [], "start"
    for n, k, _ in steps:
        folds.append(f"CASE WHEN {n}x{k}.c = 1 THEN {at} ELSE sha256({n}x{k}.before || {at} || {n}x{k}.after) END AS f_{n}{k}")
        at = f"f_{n}{k}"
    proof = " || ".join(f"{n}x{k}.before || {n}x{k}.after" for n, k, _ in steps)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf("text")} AS h,
         CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} END AS other
  FROM documents
), l0 AS MATERIALIZED (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, other NULLS FIRST) - 1 AS idx, h, count(*) OVER (PARTITION BY g) AS c, doc_id, other FROM d
),{_tree_sql("l", levels)},
t0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, h, count(*) OVER () AS c, g AS name FROM l{levels}),{_tree_sql("t", above)},
p AS (
  SELECT a.doc_id, a.h AS leaf, r.h AS subroot, (SELECT h FROM t{above}) AS root, coalesce(a.other, a.h) AS start, sha256({proof}) AS proof_sha256,
         {", ".join(folds)}
  FROM l0 a JOIN t0 r ON r.name = a.g
  {joins}
)
SELECT doc_id, leaf, subroot, root, proof_sha256, {at} AS folded_root, {at} = root AS verified FROM p
"""


OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND len(a.e) = len(b.e)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op_sql() -> dict[str, str]:
    return {"op3_warc": OP3, "op8_cap_filters": OP8, "op10_quality": OP10, "op12_manifest": _op12_sql(), "op13_hard_negatives": OP13}
