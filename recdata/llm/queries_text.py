"""Queries on packing, chat formatting, quality rules and BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, packing, rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Fixed value: the one string that the tokenizers library reads as a special token of this vocabulary.
SPECIALS = {"<|endoftext|>": 50256}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN, size=1024, end_id=0, instead={"ids_crc32": F.crc32("ids")}, specials=SPECIALS)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    rows = rows.unionByName(spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)"))
    chats = chat.format_chats(rows.withColumn("parts", chat.parts_of(F.coalesce("text", F.lit("")))))
    read = chats.withColumns({"turns": chat.read_turns(F.col("formatted"), F.col("by_turn")), "loss": chat.read_loss(F.col("formatted"), F.col("mask"), F.col("by_turn"))})
    reference = lambda a: F.concat(a["kind"], F.lit(" "), a["uri"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda n, x: n + x["n_chars"]).alias("mask_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.sha2(F.array_join(F.transform("attachments", reference), ""), 256).alias("attachments_sha256"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("attachment_tokens"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rules.clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed", "lost_chars")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_ESCAPED = "replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;')"
_LEAST_TOKENS = f"CASE k WHEN 'image' THEN {chat.IMAGE_LEAST} WHEN 'audio' THEN 1 ELSE {chat.PAGE_TOKENS} END"

OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
found AS (SELECT *, regexp_extract_all(text, '{chat.EMBEDDED}', 1) AS kinds, regexp_extract_all(text, '{chat.EMBEDDED}', 2) AS uris FROM rows),
made AS (
  SELECT *, '<turn>' || {_ESCAPED.format("role")} || '<content>' || regexp_replace({_ESCAPED.format("text")}, '{chat.EMBEDDED}', '<\\1>', 'g') || '</turn>' AS f,
    array_to_string(list_transform(kinds, lambda k, i: k || ' ' || uris[i] || chr(10)), '') AS refs, list_sum(list_transform(kinds, lambda k: {_LEAST_TOKENS})) AS tokens
  FROM found)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(f)) AS BIGINT) AS formatted_chars, CAST(sum(length(f)) AS BIGINT) AS mask_chars,
  CAST(sum(len(kinds)) AS BIGINT) AS n_attachments, sha256(string_agg(refs, '' ORDER BY turn, role, text)) AS attachments_sha256, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS attachment_tokens
FROM made GROUP BY conv_id
"""

_N_WORDS, _DEBRIS, _SEPARATORS = (f"len(regexp_extract_all(l, '{pattern}'))" for pattern in (rules.WORD, rules.DEBRIS, rules.SEPARATOR))
_FAILS = (
    f"({_N_WORDS} > 0 AND (({_DEBRIS} >= 2 AND 2 * {_DEBRIS} >= {_N_WORDS})"
    f" OR ({_SEPARATORS} >= 3 AND {rules.NAVIGATION_WORDS} * {_SEPARATORS} >= {_N_WORDS} AND NOT contains(l, '{rules.QUOTE}'))"
    f" OR ({_N_WORDS} >= {rules.SENTENCE_WORDS} AND NOT regexp_matches(l, '{rules.SENTENCE_MARK}'))"
    f" OR ({_N_WORDS} <= {rules.BOILERPLATE_WORDS} AND regexp_matches(l, '{rules.BOILERPLATE.replace(chr(39), chr(39) * 2)}'))))"
)

OP6_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{rules.WORD}') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM base, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, i, lines[i] AS l FROM base, unnest(range(1, len(lines) + 1)) AS u(i)),
marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS rn, count(*) OVER (PARTITION BY doc_id, l) AS c FROM lines),
judged AS (SELECT doc_id, i, l, {_FAILS} OR ({_N_WORDS} > 0 AND c >= {rules.REPEATS} AND rn > 1) AS fails FROM marked),
left_over AS (
  SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT fails), '') AS cleaned, count(*) FILTER (WHERE fails) AS n_lines_failed
  FROM judged GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '{rules.SYMBOL}')) AS n_symbols,
    len(list_filter(lines, lambda l: regexp_matches(l, '{rules.WORD}'))) - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '{rules.WORD}')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, n_lines_failed,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) - length(regexp_replace(cleaned, '[\\x20\\x09-\\x0D]+', '', 'g')) AS lost_chars
  FROM base JOIN left_over USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {rules.MOST_LOST} * word_chars AS kept, n_lines_failed, lost_chars
FROM counts
"""

QUERIES = {"op1_packing": op1_packing, "op2_chat_formatting": op2_chat_formatting, "op6_quality_rules": op6_quality_rules, "op9_byte_bpe": op9_byte_bpe}
ORACLES = {"op2_chat_formatting": OP2_SQL, "op6_quality_rules": OP6_SQL}
