"""Splits of interactions into train, validation and test, without random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recdata.functions.scalar import hash_key

from .sample import number_in_groups


def _order(seed: int, columns: tuple[str, ...]) -> list[Column]:
    return [hash_key(seed, *columns), *map(F.col, columns)]


def _cut(rank: Column, n: Column, r_val: float, r_test: float) -> Column:
    """test, validation or train by rank: sizes are rounded up, test first, then validation of the rest."""
    n_test = F.ceil(F.lit(r_test) * n)
    n_val = F.ceil(F.lit(r_val) / (F.lit(1.0) - F.lit(r_test)) * (n - n_test))
    return F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "validation").otherwise("train")


def split_ratio(inter: DataFrame, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), min_count: int = 4, keep_tail: bool = True, seed: int = 42, by: str = "user_id") -> DataFrame:
    """Adds split, by user or by item. Keys with `min_count` rows or fewer go to train, or are dropped.

    A user's rows are ranked in one task; an item may have a large share of all
    rows, so rows of items (or any other key) are numbered over many tasks.
    """
    if by == "user_id":
        group = Window.partitionBy(by)
        ranked = inter.withColumns({"__n": F.count("*").over(group), "__rn": F.row_number().over(group.orderBy(*_order(seed, ("user_id", "item_id"))))})
    else:
        drawn = inter.where(F.col(by).isNotNull()).withColumn("__draw", hash_key(seed, "user_id", "item_id"))
        numbered = number_in_groups(drawn, by, ["__draw", "user_id", "item_id"], "__rn", "__n").withColumn("__rn", F.col("__rn") + 1).drop("__draw")
        ranked = numbered.select(*inter.columns, "__n", "__rn")
    split = F.when(F.col("__n") <= min_count, "train").otherwise(_cut(F.col("__rn"), F.col("__n"), ratios[1], ratios[2]))
    out = ranked.withColumn("split", split)
    return (out if keep_tail else out.where(F.col("__n") > min_count)).drop("__n", "__rn")


def k_core(split: DataFrame, k: int = 3) -> DataFrame:
    """Rows of users who have validation and test rows and at least `k` in all."""
    group = Window.partitionBy("user_id")
    has = lambda s: F.max((F.col("split") == s).cast("int")).over(group) == 1
    marked = split.withColumn("__keep", has("validation") & has("test") & (F.count("*").over(group) >= k))
    return marked.where("__keep").drop("__keep")


def split_author_disjoint(inter: DataFrame, items: DataFrame, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), min_authors: int = 3, k: int = 3, seed: int = 42) -> DataFrame:
    """Splits each user's authors, so that no author of theirs is in two splits, then keeps the k-core.

    Items without an author, and users with under `min_authors` authors, are dropped.
    """
    rows = inter.join(items.where(F.coalesce("author", F.lit("")) != "").select("item_id", "author"), "item_id")
    authors = rows.select("user_id", "author").distinct()
    group = Window.partitionBy("user_id")
    authors = authors.withColumns({"n": F.count("*").over(group), "rn": F.row_number().over(group.orderBy(*_order(seed, ("user_id", "author"))))})
    authors = authors.where(F.col("n") >= min_authors).withColumn("split", _cut(F.col("rn"), F.col("n"), ratios[1], ratios[2]))
    return k_core(rows.join(authors.select("user_id", "author", "split"), ["user_id", "author"]).drop("author"), k)


def split_longtail(inter: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows of users with `k` rows or fewer, all others)."""
    counted = inter.withColumn("__n", F.count("*").over(Window.partitionBy("user_id")))
    return counted.where(F.col("__n") <= k).drop("__n"), counted.where(F.col("__n") > k).drop("__n")


def folds(inter: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0 to n - 1: as even as can be within each user, larger folds first."""
    window = Window.partitionBy("user_id").orderBy(*_order(seed, ("user_id", "item_id")))
    return inter.withColumn("fold", F.ntile(n).over(window) - 1)


def rotate_folds(folded: DataFrame, n: int, tail: DataFrame | None = None) -> DataFrame:
    """n splits of folded rows: number s tests fold s, validates fold s + 1 (modulo n) and trains on the rest and on `tail`."""
    splits = folded.withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    name = F.when(F.col("fold") == F.col("split_no"), "test").when(F.col("fold") == (F.col("split_no") + 1) % n, "validation").otherwise("train")
    out = splits.withColumn("split", name).drop("fold")
    if tail is None:
        return out
    more = tail.withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("split", F.lit("train"))
    return out.unionByName(more)


def restrict(dim: DataFrame, inter: DataFrame, key: str) -> DataFrame:
    """Rows of users or items that occur in the interactions."""
    return dim.join(inter.select(key), key, "left_semi")


def limit_per_user(inter: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """`most` rows of each user, chosen by hash."""
    window = Window.partitionBy("user_id").orderBy(*_order(seed, ("user_id", "item_id")))
    return inter.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= most).drop("__rn")
