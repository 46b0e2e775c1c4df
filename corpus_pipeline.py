"""Cleans, filters, deduplicates and packs `documents` in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recdata.llm import gam, packing, rules, simhash, substrings
from recdata.llm.common import fresh, id_crc, materialize, possible
from recdata.llm.queries_text import SPECIALS


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns in one, so that no name of theirs meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))


def _unwrapped(found: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of `docs` again, with the text from another column if one is named; n_chars follows it."""
    new = {} if text is None else {"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return found.select(*(new.get(c, F.col("document")[c]).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line-first rules reject; of the others, drops the lines that fail. n_chars follows.

    Null and empty texts have no words and go. Rows are judged one by one, so
    repeated rows share a verdict and null ids make no difference; an empty
    table stays empty.
    """
    return _unwrapped(rules.clean_lines(_wrapped(docs)).where("kept"), docs, "cleaned")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted to be of low quality. Learns from the labelled rows of the documents as they came in, held-out ids excepted.

    Null texts count as empty and are scored like any other; repeated rows share
    a verdict; an empty table stays empty. Without labels of both kinds every
    document scores 1/2 or more and stays.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = gam.train(raw, labels, id_crc(F.col("doc_id"), 3) != 1, most=20_000)
    return _unwrapped(gam.score(_wrapped(docs), model).where("predicted = 1"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Every pair of documents that reaches it is linked, see `simhash.similar_documents`.
    Rows that repeat an id are one document, of which the row with the least
    text stays. Rows without an id stay. Null and empty texts are one group. An
    empty table stays empty.
    """
    gone, first, n, turn = fresh(docs, "gone", "first", "n", "turn")
    groups = materialize(simhash.similar_documents(docs.select("doc_id", "text")), "groups")
    told = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(n), F.min("component_id").alias(first))
    told = materialize(told.where((F.col(n) > 1) | (F.col(first) != F.col("doc_id"))).select("doc_id", (F.col(first) != F.col("doc_id")).alias(gone)), "told")
    some, rest = possible(docs, "doc_id", told.select("doc_id"))
    order = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    left = some.join(told, "doc_id", "left").where(~F.coalesce(F.col(gone), F.lit(False))).withColumn(turn, F.row_number().over(order)).where((F.col(turn) == 1) | F.col(gone).isNull())
    return left.select(*docs.columns).unionByName(rest)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that also stand in a document with a smaller id. Every document stays; n_chars follows.

    Null texts stay null; from a row without an id nothing is removed; rows with
    one id are not compared with each other; an empty table stays empty.
    """
    return _unwrapped(substrings.remove_repeats(_wrapped(docs), size=50), docs, "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens: where each piece of a document goes.

    A null or empty text is one piece of the end token alone; repeated rows and
    ids are packed as often as they come; an empty table gives no rows.
    """
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, size=1024, end_id=0, instead={"ids_crc32": F.crc32("ids")}, specials=SPECIALS)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
