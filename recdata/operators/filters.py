"""Filters on interactions, items and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recdata.functions.scalar import parse_count
from recdata.functions.text import tokenize


def filter_rating(inter: DataFrame, least: int) -> DataFrame:
    """Rows rated `least` or better."""
    return inter.where(F.col("rating") >= least)


def rated(inter: DataFrame) -> DataFrame:
    """Rows with a rating (-1 stands for none)."""
    return inter.where(F.coalesce(F.col("rating"), F.lit(-1)) != -1)


def with_known_items(inter: DataFrame, items: DataFrame, require_author: bool = False) -> DataFrame:
    """Rows whose item has metadata, optionally with an author."""
    known = items.where(F.coalesce(F.trim("author"), F.lit("")) != "") if require_author else items
    return inter.join(known.select("item_id"), "item_id", "left_semi")


def limit_pairs(inter: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose user and item are listed, all others); the others still count as used."""
    listed = pairs.select("user_id", "item_id").distinct()
    return inter.join(listed, ["user_id", "item_id"], "left_semi"), inter.join(listed, ["user_id", "item_id"], "left_anti")


def users_with_min_authors(inter: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """Rows of users with at least `least` distinct authors."""
    enough = inter.join(items.select("item_id", "author"), "item_id").groupBy("user_id").agg(F.countDistinct("author").alias("n")).where(F.col("n") >= least)
    return inter.join(enough.select("user_id"), "user_id", "left_semi")


def users_with_min_tokens(inter: DataFrame, field: str, least: int, texts: DataFrame | None = None, ref: str = "doc_id") -> DataFrame:
    """(user_id) of users whose texts have at least `least` tokens in all.

    With `texts` (ref, field) the rows of `inter` name their text by `ref`: each
    text is then tokenised once, and rows are joined with its number of tokens.
    """
    count = F.size(tokenize(F.col(field))).alias("n")
    rows = inter.select("user_id", count) if texts is None else inter.select("user_id", ref).join(texts.select(ref, count), ref)
    return rows.groupBy("user_id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("user_id")


def sound_items(items: DataFrame) -> DataFrame:
    """Items whose title is not page debris."""
    return items.where(~F.coalesce(F.col("title").contains("getTime"), F.lit(False)))


def well_rated_items(items: DataFrame, least: int = 5) -> DataFrame:
    """Items with over `least` ratings; num_rating may be written with commas."""
    return items.where(parse_count(F.col("num_rating").cast("string")) > least)


def filter_runs(runs: DataFrame, learning_rate: float | None = None, batch_size: int | None = None) -> DataFrame:
    out = runs if learning_rate is None else runs.where(F.col("lr") == learning_rate)
    return out if batch_size is None else out.where(F.col("batch_size") == batch_size)
