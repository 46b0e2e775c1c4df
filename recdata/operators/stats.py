"""Statistics of interactions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recdata.functions.scalar import BINS, bucket, group_label


def counts(inter: DataFrame, key: str) -> DataFrame:
    return inter.groupBy(key).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """n, min, max, mean, sample variance and deviation, biased skewness and excess kurtosis."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))


def histogram(df: DataFrame, column: str, bins: tuple = BINS) -> DataFrame:
    """(bin, n) of a column of counts."""
    return df.groupBy(bucket(F.col(column), bins).alias("bin")).agg(F.count("*").alias("n"))


def sparsity(inter: DataFrame) -> DataFrame:
    """1 - rows / (users * items)."""
    n, u, i = F.count("*"), F.countDistinct("user_id"), F.countDistinct("item_id")
    return inter.agg(n.alias("n"), u.alias("n_users"), i.alias("n_items"), (1 - n / (u * i)).alias("sparsity"))


def density(inter: DataFrame) -> DataFrame:
    """Distinct edges of the user-item graph over the possible ones."""
    edges = inter.select("user_id", "item_id").distinct()
    return edges.agg(F.count("*").alias("n_edges"), (F.count("*") / (F.countDistinct("user_id") * F.countDistinct("item_id"))).alias("density"))


def author_stats(splits: DataFrame, items: DataFrame) -> DataFrame:
    """(split, n_authors, authors_per_user, users_per_author), and a row TOTAL over all rows with, in sum_of_splits, the per-split distinct authors added up (a split's own count elsewhere)."""
    rows = splits.join(items.select("item_id", "author"), "item_id", "left")
    both = rows.withColumn("part", F.explode(F.array(F.col("split"), F.lit("TOTAL"))))
    pairs = both.where(F.col("author").isNotNull()).groupBy("part").agg(F.countDistinct("author").alias("n_authors"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("user_id", "author").alias("n_pairs"))
    summed = pairs.where("part <> 'TOTAL'").agg(F.sum("n_authors").alias("s"))
    out = pairs.join(F.broadcast(summed))
    return out.select(F.col("part").alias("split"), "n_authors", (F.col("n_pairs") / F.col("n_users")).alias("authors_per_user"), (F.col("n_pairs") / F.col("n_authors")).alias("users_per_author"), F.when(F.col("part") == "TOTAL", F.col("s")).otherwise(F.col("n_authors")).alias("sum_of_splits"))


def group_stats(splits: DataFrame, thresholds: tuple[int, ...] = (5, 50), key: str = "user_id") -> DataFrame:
    """(split, group, n_keys, n_rows) by how often a user or item occurs in train; group 0: unseen in train."""
    train = splits.where("split = 'train'").groupBy(key).agg(F.count("*").alias("n_train"))
    rows = splits.join(train, key, "left").withColumn("group", group_label(F.col("n_train"), thresholds))
    return rows.groupBy("split", "group").agg(F.countDistinct(key).alias("n_keys"), F.count("*").alias("n_rows"))


def split_shares(splits: DataFrame) -> DataFrame:
    """(split, n, share), with the grand total as split ALL."""
    sums = splits.rollup("split").agg(F.count("*").alias("n"))
    total = splits.agg(F.count("*").alias("total"))
    return sums.join(F.broadcast(total)).select(F.coalesce("split", F.lit("ALL")).alias("split"), "n", (F.col("n") / F.col("total")).alias("share"))


def train_only_users(splits: DataFrame) -> DataFrame:
    """(n_users, n_rows) of users without validation and test rows."""
    rest = splits.where("split <> 'train'").select("user_id")
    only = splits.join(rest, "user_id", "left_anti")
    return only.agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n_rows"))


def rating_counts(inter: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """One row: rows in all and for each rating."""
    return inter.agg(F.count("*").alias("n"), *(F.sum((F.col("rating") == r).cast("long")).alias(f"n_{r}") for r in levels))


def label_counts(cand: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, n_pos, n_neg) of candidates by user group."""
    return cand.join(groups, "user_id").groupBy("group").agg(F.sum((F.col("label") >= 1).cast("long")).alias("n_pos"), F.sum((F.col("label") < 1).cast("long")).alias("n_neg"))


def is_connected(components: DataFrame) -> DataFrame:
    """(n_components, connected) of the result of `connected_components`."""
    n = F.countDistinct("component")
    return components.agg(n.alias("n_components"), (n == 1).alias("connected"))


def check_splits(splits: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(check, bad): repeated ids, rows without metadata, pairs in more than one split. All are 0 for sound data."""
    tests = {
        "repeated_users": users.groupBy("user_id").count().where("count > 1"),
        "repeated_items": items.groupBy("item_id").count().where("count > 1"),
        "unknown_users": splits.join(users.select("user_id"), "user_id", "left_anti"),
        "unknown_items": splits.join(items.select("item_id"), "item_id", "left_anti"),
        "pairs_in_two_splits": splits.groupBy("user_id", "item_id").agg(F.countDistinct("split").alias("n")).where("n > 1"),
    }
    parts = [df.agg(F.lit(name).alias("check"), F.count("*").alias("bad")) for name, df in tests.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
