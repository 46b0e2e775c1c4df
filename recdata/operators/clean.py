"""Deduplication and cleaning of interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recdata.sources.scratch import materialize

from .graph import connected_components

#: First characters of a text that tell, with its length, which task puts it in order.
PREFIX = 32


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (keep-last by time, keep-first by position)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def text_places(texts: DataFrame, ref: str = "doc_id", text: str = "review") -> DataFrame:
    """(ref, place): numbers that order texts by their length, then as texts; equal ones share a number, null and empty ones do not.

    Texts are range-partitioned and sorted once; rows that name them can then be
    ordered without holding them.
    """
    length, start = F.length(F.coalesce(text, F.lit(""))), F.substring(text, 1, PREFIX)
    ranged = texts.select(ref, text, length.alias("__n"), start.alias("__start")).repartitionByRange("__n", "__start").sortWithinPartitions("__n", "__start", text)
    numbered = materialize(ranged.select(ref, F.coalesce(F.sha2(text, 256), F.lit("")).alias("__same"), F.monotonically_increasing_id().alias("__at")), "places")
    return numbered.join(numbered.groupBy("__same").agg(F.min("__at").alias("place")), "__same").select(ref, "place")


def text_classes(texts: DataFrame, ref: str = "doc_id", text: str = "review") -> DataFrame:
    """(ref, same, blank): a number that equal texts share, told by their SHA-256, and whether there is nothing but spaces."""
    told = texts.select(ref, F.coalesce(F.sha2(text, 256), F.lit("")).alias("__same"), (F.coalesce(F.trim(text), F.lit("")) == "").alias("blank"))
    return told.join(told.groupBy("__same").agg(F.min(ref).alias("same")), "__same").select(ref, "same", "blank")


def longest_review(inter: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id"), place: str | None = None) -> DataFrame:
    """Of several reviews of one item by one user the longest; ties go to the later text in order.

    With `place` the column of that name orders the reviews, see `text_places`.
    """
    if place is not None:
        return latest(inter, list(keys), [F.desc(place), F.desc("rating")])
    return latest(inter, list(keys), [F.desc(F.length(F.coalesce("review", F.lit("")))), F.desc("review"), F.desc("rating")])


def clean_same_review(inter: DataFrame, items: DataFrame, texts: DataFrame | None = None, ref: str = "doc_id") -> DataFrame:
    """Drops copies of a review that a user has put on several editions.

    Among a user's rows with the same rating and the same review (not blank),
    the item with most interactions wins, then the smaller id; the others go if
    their item has the winner's author and average rating. With `texts` (ref,
    review) the rows of `inter` name their review by `ref`, and no text is
    joined with them.
    """
    if texts is None:
        told = inter.withColumns({"__same": F.col("review"), "__blank": F.coalesce(F.trim("review"), F.lit("")) == ""})
    else:
        told = inter.join(text_classes(texts, ref).select(ref, F.col("same").alias("__same"), F.col("blank").alias("__blank")), ref)
    counts = inter.groupBy("item_id").agg(F.count("*").alias("__uses"))
    rows = told.join(counts, "item_id").join(items.select("item_id", "author", "avg_rating"), "item_id", "left")
    window = Window.partitionBy("user_id", "rating", "__same").orderBy(F.desc("__uses"), "item_id")
    rows = rows.withColumns({"__n": F.row_number().over(window), "__author": F.first("author").over(window), "__avg": F.first("avg_rating").over(window)})
    same = (F.col("__n") > 1) & F.col("author").eqNullSafe(F.col("__author")) & F.col("avg_rating").eqNullSafe(F.col("__avg"))
    return rows.where(F.col("__blank") | ~same).select(*inter.columns)


def merge_editions(items: DataFrame, inter: DataFrame, min_ratings: int = 5) -> DataFrame:
    """(item_id, canonical): items with the same author, average rating and number of ratings are one.

    Only items with over `min_ratings` ratings count; the most used one stands
    for all, then the smaller id. Only items that are replaced have a row.
    """
    uses = inter.groupBy("item_id").agg(F.count("*").alias("uses"))
    known = items.where((F.col("num_rating") > min_ratings) & F.col("author").isNotNull() & F.col("avg_rating").isNotNull()).join(uses, "item_id", "left")
    best = known.groupBy("author", "avg_rating", "num_rating").agg(F.max(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), (-F.col("item_id")).alias("id"))).alias("best"))
    named = known.join(best, ["author", "avg_rating", "num_rating"]).withColumn("canonical", -F.col("best.id"))
    return named.where("item_id <> canonical").select("item_id", "canonical")


def canonical_items(edges: DataFrame, inter: DataFrame) -> DataFrame:
    """(item_id, canonical) of replacements that chain: the most used item of each connected component, then the smallest id."""
    groups = connected_components(edges)
    uses = inter.groupBy(F.col("item_id").alias("node")).agg(F.count("*").alias("uses"))
    counted = groups.join(uses, "node", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    best = counted.groupBy("component").agg(F.max(F.struct("uses", (-F.col("node")).alias("id"))).alias("best"))
    return counted.join(best, "component").select(F.col("node").alias("item_id"), (-F.col("best.id")).alias("canonical")).where("item_id <> canonical")


def apply_mapping(inter: DataFrame, mapping: DataFrame, place: str | None = None) -> DataFrame:
    """Interactions with replaced items; of several of a user with one item the longest review stays, or that with the largest `place`."""
    moved = inter.join(mapping, "item_id", "left").withColumn("item_id", F.coalesce("canonical", "item_id")).drop("canonical")
    return longest_review(moved.select(*inter.columns), place=place)


def refresh_items(items: DataFrame, newer: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrites some columns of items from a newer table; where it has no value the old one stays."""
    new = newer.select("item_id", *(F.col(c).alias(f"__{c}") for c in columns))
    return items.join(new, "item_id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*items.columns)


def one_per_author(inter: DataFrame, items: DataFrame, tie: list[Column]) -> DataFrame:
    """The best-rated item of each author for each user; `tie` orders items with equal ratings, then the smaller id."""
    known = items.where(F.coalesce(F.trim("author"), F.lit("")) != "")
    rows = inter.join(known.select("item_id", "author", *[c for c in items.columns if c not in ("item_id", "author", *inter.columns)]), "item_id")
    return latest(rows, ["user_id", "author"], [F.desc("rating"), *tie, F.col("item_id")])
