"""Merkle trees of a dataset: a tree for each source, and one over the sources' roots.

Nodes of a level are put together by threes. Nodes that share an aligned block
(3^DEPTH leaves, and all nodes above them) are one row, in which each level is
one string of hexadecimal digests. A digest has a fixed width, so the parents
of a level are hashes of fixed-width substrings of it, and the siblings of a
node are the two substrings that flank it in its run. The roots of blocks are
the leaves of the next round, until one block is left. Nothing but the number
of rounds reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, materialize, release

#: Nodes of a run, levels of a block, and leaves of a block.
ARITY, DEPTH = 3, 5
BLOCK = ARITY**DEPTH
#: Hexadecimal digits of a digest.
WIDTH = 64


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def places(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds place (from 0 on in each group, in `order`) and total (rows of the group); `group` has no null.

    Rows are range-partitioned by group and order, so a large group spreads over
    many tasks; each range counts on from the ranges before it. Rows that are
    equal in all these columns take their places in any order.
    """
    keys = [group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranges")
    counted = stored.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return stored.join(starts, [group, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _parents(level: Column) -> Column:
    """The level above one, both as one string of digests in binary form."""
    run = ARITY * WIDTH
    hashes = F.transform(F.sequence(F.lit(0), F.ceil(F.length(level) / run).cast("int") - 1), lambda i: F.sha2(F.substr(level, i * run + 1, F.lit(run)), 256))
    return F.array_join(hashes, "").cast("binary")


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(group, block, total, members, levels, top): nodes (group, place, total, hash and `carried`) by aligned blocks.

    levels[0] has the hashes of the members, levels[k] those of the nodes k
    levels above, as long as the level below has more than one node in its whole
    group; top is the block's last node.
    """
    member = F.struct("place", "hash", *carried)
    found = nodes.groupBy("group", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.first("total").alias("total"))
    lowest = F.array_join(F.transform("members", lambda m: m["hash"]), "").cast("binary")
    more = lambda k: F.pow(F.lit(float(ARITY)), k - 1) < F.col("total")
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(lowest), lambda all_, k: F.when(more(k), F.concat(all_, F.array(_parents(F.element_at(all_, -1))))).otherwise(all_))
    return found.withColumn("levels", levels).withColumn("top", F.element_at("levels", -1).cast("string"))


def _segments(levels: Column, index: Column) -> Column:
    """For the index-th member of a block, level by level: its siblings to the left and to the right, each as one string."""

    def sides(level: Column, k: Column) -> Column:
        at = F.floor(index / F.pow(F.lit(float(ARITY)), k)).cast("int")
        left = at % ARITY
        cut = lambda first, n: F.substr(level, first * WIDTH + 1, n * WIDTH).cast("string")
        return F.struct(cut(at - left, left).alias("left"), cut(at + 1, ARITY - 1 - left).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), sides)


def climb(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The tables of blocks, from the nodes up, of which the last has one block for each group."""
    tables = [materialize(blocks(nodes, carried), "blocks")]
    most = tables[0].agg(F.max("total")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        above = tables[-1].select("group", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("hash"))
        tables.append(materialize(blocks(above, []), "blocks"))
    return tables


def descend(tables: list[DataFrame], roots: DataFrame, carried: list[str]) -> DataFrame:
    """(group, place, hash, path, columns of `roots`, carried) of every node that `climb` began with.

    `roots` has one row for each group: group, path (the siblings above the
    group's root) and columns to hand down. No key of a join has more rows than
    a block has members.
    """
    handed = [c for c in roots.columns if c not in ("group", "path")]
    above = roots.withColumn("block", F.lit(0).cast("long"))
    for depth in reversed(range(len(tables))):
        names = carried if depth == 0 else []
        met = tables[depth].join(above, ["group", "block"]).select("group", "levels", "path", *handed, F.posexplode("members").alias("index", "m"))
        path = F.concat(_segments(F.col("levels"), F.col("index")), F.col("path"))
        above = met.select("group", F.col("m.place").alias("place"), F.col("m.hash").alias("hash"), path.alias("path"), *handed, *(F.col(f"m.{c}").alias(c) for c in names))
        above = above.withColumnRenamed("place", "block") if depth else above
    return above


def folded(node: Column, path: Column) -> Column:
    """The root that a node has with the siblings of `path`."""
    return F.aggregate(path, node, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings of `path`, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of `df`: id, leaf, subroot, root, path, and leaf_now, by which `folded` verifies it.

    A leaf is the hash of `columns`, in which null differs from the empty
    string. In each group leaves ascend by id (nulls first) and then by leaf;
    groups ascend by their bytes, the null group first. `path` has the siblings
    from the leaf to the root. `changed`: columns as they are at the time of
    verification; leaf_now is the leaf made of them, the same as leaf without
    them. Rows that are equal in all columns have the same leaf and places next
    to each other. A table of one row is its own root, an empty one gives an
    empty result. Texts are hashed where they are read, and never shuffled; of
    columns other than those named none is read.
    """
    now = leaf(*((changed or {}).get(c, F.col(f"`{c}`")) for c in columns))
    named = F.when(F.col(f"`{group_col}`").isNull(), "-").otherwise(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")))
    hashed = df.select(named.alias("group"), F.col(f"`{id_col}`").alias("key"), leaf(*(F.col(f"`{c}`") for c in columns)).alias("hash"), now.alias("now"))
    # equal digests are kept once
    leaves = materialize(hashed.withColumn("now", F.when(F.col("now") != F.col("hash"), F.col("now"))), "leaves")
    carried = ["key", "now"]
    trees = climb(places(leaves, "group", ["key", "hash"]), carried)
    release(leaves)
    subroots = trees[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("top").alias("hash"))
    over = climb(places(subroots, "group", ["name"]), ["name"])
    root = over[-1].select("group", F.col("top").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    roots = descend(over, root, ["name"]).select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    found = descend(trees, materialize(roots, "roots"), carried)
    return found.select(F.col("key").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", F.coalesce("now", "hash").alias("leaf_now"))


def tampered_text(id_col: Column, text: Column) -> Column:
    """The text without its newlines where 2 divides the CRC-32 of the decimal id; a null id is left alone."""
    return F.when(id_col.isNotNull() & (id_crc(id_col, 2) == 0), F.regexp_replace(text, "\n", "")).otherwise(text)
