"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_corpus, queries_dedup, queries_models, queries_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_text.QUERIES, **queries_dedup.QUERIES, **queries_models.QUERIES, **queries_corpus.QUERIES}
ORACLES: dict[str, str] = {**queries_text.ORACLES, **queries_dedup.ORACLES, **queries_models.ORACLES, **queries_corpus.ORACLES}
