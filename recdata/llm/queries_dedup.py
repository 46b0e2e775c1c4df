"""Queries on near-duplicates and substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash, substrings
from .common import words


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = substrings.remove_repeats(docs, size=50)
    kept = F.sha2(F.array_join(words(F.col("text")), " "), 256)
    return left.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) AS u(i)),
least AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least USING (h), range(0, 50) AS r(k) WHERE least < doc_id),
flags AS (
  SELECT w.doc_id, u.p, w.w[u.p] AS word, gone.p IS NOT NULL AS removed
  FROM w, unnest(range(1, len(w.w) + 1)) AS u(p) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = u.p)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(f.n, 0) AS n_removed, sha256(coalesce(f.kept, '')) AS kept_sha256
FROM w LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS kept
  FROM flags GROUP BY doc_id) AS f USING (doc_id)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup, "op7_simhash": op7_simhash}
ORACLES = {"op4_substring_dedup": OP4_SQL}
