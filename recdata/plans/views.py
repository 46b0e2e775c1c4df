"""The tables that the queries run on, derived from the driver's, and the same views as SQL for the oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recdata.operators.clean import latest


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def raw_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    rating = (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int")
    return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), rating.alias("rating"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating 1..5, ts: the latest row of each user and item, dealt by user, so that splits by user move no row again."""
    rows = raw_interactions(spark, sf_dir).repartition("user_id")
    order = [F.desc(c) for c in ("ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return latest(rows, ["user_id", "item_id"], order).select("user_id", "item_id", "rating", "ts")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title, author, genres: array of the type and the words of the name."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    genres = F.array_distinct(F.concat(F.array("p_type"), F.split("p_name", " ")))
    return part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), genres.alias("genres"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, vec: the embedding whose vec_id is the item's id modulo their number."""
    return _vectors(spark, sf_dir, "part", "p_partkey", "item_id", 1)


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, "customer", "c_custkey", "user_id", 7)


def _vectors(spark: SparkSession, sf_dir: str, name: str, key: str, alias: str, factor: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("n"))
    ids = table(spark, sf_dir, name, key).join(F.broadcast(n)).select(F.col(key).alias(alias), ((F.col(key) * factor) % F.col("n")).alias("vec_id"))
    return ids.join(vectors, "vec_id").select(alias, F.col("embedding").alias("vec"))


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text: the document whose doc_id is the item's id modulo their number."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))
    ids = table(spark, sf_dir, "part", "p_partkey").join(F.broadcast(n)).select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % F.col("n")).alias("doc_id"))
    return ids.join(docs, "doc_id").select("item_id", "text")


def reviews(spark: SparkSession, sf_dir: str, inter: DataFrame) -> DataFrame:
    """`inter` with the text of a review: the document whose doc_id is chosen by user and item."""
    return _chosen(spark, sf_dir, inter, _review()).join(review_texts(spark, sf_dir), "doc_id").drop("doc_id")


def review_refs(spark: SparkSession, sf_dir: str, inter: DataFrame, by_item: bool = False) -> DataFrame:
    """`inter` with the doc_id of its review instead of the text, see `review_texts`; all reviews of an item share one with `by_item`."""
    return _chosen(spark, sf_dir, inter, F.col("item_id") if by_item else _review())


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, review): the texts that reviews refer to."""
    return table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("text", "review")


def _review() -> Column:
    """The number that chooses the review of a user and an item."""
    return F.col("user_id") * 31 + F.col("item_id")


def _chosen(spark: SparkSession, sf_dir: str, inter: DataFrame, number: Column) -> DataFrame:
    n = table(spark, sf_dir, "documents", "doc_id").agg(F.count("*").alias("n"))
    return inter.join(F.broadcast(n)).withColumn("doc_id", number % F.col("n")).drop("n")


#: Widths of the two layers of a tower; its weights follow from a rule, see `tower`.
HIDDEN, OUT = 16, 8


def tower(spark: SparkSession, sf_dir: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of two layers for vectors as wide as those of `embeddings`: ((i * seed + j * 13) % 11 - 5) / 8, and j % 3 / 4."""
    width = len(table(spark, sf_dir, "embeddings", "embedding").first()[0])
    weight = lambda n, m: ((np.arange(n)[:, None] * seed + np.arange(m)[None, :] * 13) % 11 - 5) / 8.0
    return [(weight(width, HIDDEN), np.arange(HIDDEN) % 3 / 4.0), (weight(HIDDEN, OUT), np.arange(OUT) % 3 / 4.0)]


def tower_sql(vec: str, seed: int) -> str:
    """SQL of `tower` applied to a list."""
    layer = lambda x, m: f"list_transform(range(0, {m}), lambda j: list_sum(list_transform({x}, lambda a, i: a * ((((i - 1) * {seed} + j * 13) % 11 - 5) / 8.0::DOUBLE))) + j % 3 / 4.0::DOUBLE)"
    hidden = f"list_transform({layer(vec, HIDDEN)}, lambda h: greatest(h, 0))"
    return layer(hidden, OUT)


INTERACTIONS = """inter AS (
  SELECT user_id, item_id, rating, ts FROM (
    SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS INTEGER) AS rating, l_shipdate AS ts,
      row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)"""
ITEMS = """items AS (SELECT p_partkey AS item_id, p_name AS title, p_brand AS author, [p_type] || string_split(p_name, ' ') AS genres FROM part)"""
USERS = """users AS (SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment FROM customer)"""
ITEM_VECTORS = """item_vecs AS (SELECT p_partkey AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""
USER_VECTORS = """user_vecs AS (SELECT c_custkey AS user_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM customer JOIN embeddings ON vec_id = (c_custkey * 7) % (SELECT count(*) FROM embeddings))"""
ITEM_TEXTS = """item_texts AS (SELECT p_partkey AS item_id, text FROM part JOIN documents ON doc_id = p_partkey % (SELECT count(*) FROM documents))"""
REVIEWS = """reviews AS (SELECT i.*, d.text AS review FROM inter AS i JOIN documents AS d ON d.doc_id = (i.user_id * 31 + i.item_id) % (SELECT count(*) FROM documents))"""


def key(seed: int, *columns: str) -> str:
    """SQL of `hash_key`."""
    return f"md5('{seed}'" + "".join(f" || '|' || coalesce(CAST({c} AS VARCHAR), '')" for c in columns) + ")"


def key_int(seed: int, *columns: str) -> str:
    return f"CAST('0x' || substr({key(seed, *columns)}, 1, 8) AS BIGINT)"


def half_up(value: str, digits: int) -> str:
    """SQL of `round_half_up`."""
    scale = float(10**digits)
    return f"CAST(floor(CAST({value} AS DOUBLE) * {scale:.1f}::DOUBLE + 0.5::DOUBLE) AS DOUBLE) / {scale:.1f}::DOUBLE"


def split_sql(source: str = "inter", name: str = "split", by: str = "user_id", seed: int = 42, r_val: float = 0.2, r_test: float = 0.2, min_count: int = 4) -> str:
    """SQL of `split_ratio` that keeps users with few rows in train."""
    return f"""{name}_ranked AS (
  SELECT *, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY {key(seed, "user_id", "item_id")}, user_id, item_id) AS rn FROM {source}),
{name}_cuts AS (SELECT *, CAST(ceil({r_test}::DOUBLE * n) AS BIGINT) AS n_test FROM {name}_ranked),
{name} AS (
  SELECT user_id, item_id, rating, ts, CASE WHEN n <= {min_count} THEN 'train' WHEN rn <= n_test THEN 'test'
    WHEN rn <= n_test + CAST(ceil({r_val}::DOUBLE / (1.0::DOUBLE - {r_test}::DOUBLE) * (n - n_test)) AS BIGINT) THEN 'validation' ELSE 'train' END AS split
  FROM {name}_cuts)"""
