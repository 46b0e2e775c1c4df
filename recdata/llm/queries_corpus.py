"""Queries on tokenizer alignment, license scans and dataset manifests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, licenses, merkle


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = align.align(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return licenses.scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", "labels")).alias("labels"),
        "score",
        F.size("starts").cast("long").alias("n_detections"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    found = merkle.manifest(docs, changed={"text": merkle.tampered_text(F.col("doc_id"), F.col("text"))})
    told = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("leaf_now"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + "))"


#: CRC-32 by bits: the polynomial of zlib over the bytes of the decimal id.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP13_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, 0 AS b, 4294967295 AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, CASE WHEN b = 8 THEN i + 1 ELSE i END, CASE WHEN b = 8 THEN 0 ELSE b + 1 END,
    CASE WHEN b = 0 THEN xor(c, ascii(substr(s, i, 1))) ELSE {_STEP} END
  FROM bits WHERE i <= length(s)),
crcs AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM bits WHERE i > length(s)),
leaves AS (
  SELECT d.doc_id, d.source, {_leaf("text")} AS leaf,
    CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS leaf_now
  FROM documents AS d LEFT JOIN crcs USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
nodes AS (
  SELECT 0 AS level, source, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, source, i // 3, n),
subroots AS (
  SELECT source, level, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n),
steps AS (
  SELECT a.source, 0 AS tree, a.level, a.i, string_agg(CASE WHEN b.i < a.i THEN b.h ELSE '' END, '' ORDER BY b.i) AS l, string_agg(CASE WHEN b.i > a.i THEN b.h ELSE '' END, '' ORDER BY b.i) AS r
  FROM nodes AS a JOIN nodes AS b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.source, a.level, a.i
  UNION ALL
  SELECT NULL, 1, a.level, a.i, string_agg(CASE WHEN b.i < a.i THEN b.h ELSE '' END, '' ORDER BY b.i), string_agg(CASE WHEN b.i > a.i THEN b.h ELSE '' END, '' ORDER BY b.i)
  FROM tops AS a JOIN tops AS b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.i),
lower_walk AS (
  SELECT doc_id, source, leaf, n, 0 AS level, CAST(i AS BIGINT) AS i, leaf_now AS h, '' AS proof, CAST(n AS BIGINT) AS left_n FROM placed
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.n, w.level + 1, w.i // 3, sha256(s.l || w.h || s.r), w.proof || s.l || s.r, (w.left_n + 2) // 3
  FROM lower_walk AS w JOIN steps AS s ON s.tree = 0 AND s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.i = w.i WHERE w.left_n > 1),
upper_walk AS (
  SELECT w.doc_id, w.leaf, s.h AS subroot, 0 AS level, CAST(s.i AS BIGINT) AS i, w.h, w.proof, CAST(s.n AS BIGINT) AS left_n
  FROM lower_walk AS w JOIN subroots AS s ON s.source IS NOT DISTINCT FROM w.source WHERE w.left_n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.i // 3, sha256(s.l || w.h || s.r), w.proof || s.l || s.r, (w.left_n + 2) // 3
  FROM upper_walk AS w JOIN steps AS s ON s.tree = 1 AND s.level = w.level AND s.i = w.i WHERE w.left_n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM upper_walk WHERE left_n = 1
"""

QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment, "op12_license_scans": op12_license_scans, "op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": OP13_SQL}
