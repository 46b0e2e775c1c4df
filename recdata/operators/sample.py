"""Samples of interactions: by hash, by weight, and by hops over the user-item graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recdata.functions.scalar import hash_key, hash_uniform
from recdata.sources.scratch import materialize


#: Rows that may be sorted in one task, and parts of a histogram of draws.
FEW, PARTS = 4096, 1024


def smallest(df: DataFrame, n: int, draw: Column, *ties: str | Column) -> DataFrame:
    """The `n` rows of `df` with the smallest `draw` (a number, not null), ties by `ties`; the same rows as a sort and a limit give.

    A histogram of the draws tells in which of PARTS ranges the n-th lies; that
    range is divided again until it holds few rows. Only those are sorted, all
    before it pass a filter, so no task holds `n` rows. A pass over stored draws
    for each division; the driver gets PARTS counts. Rows of one single draw are
    sorted together, however many they are.
    """
    if n <= 0:
        return df.limit(0)
    rows = materialize(df.withColumn("__draw", draw.cast("double")), "draws")
    inside, taken, need = rows, F.lit(False), n
    here = F.lit(True)
    while True:
        told = inside.agg(F.min("__draw").alias("low"), F.max("__draw").alias("high"), F.count("*").alias("n")).first()
        if told["n"] <= need:
            return rows.where(taken | here).drop("__draw")
        if told["n"] <= FEW or told["low"] == told["high"]:
            break
        part = F.least(F.floor((F.col("__draw") - F.lit(told["low"])) / F.lit(told["high"] - told["low"]) * PARTS), F.lit(PARTS - 1))
        before, cut = 0, 0
        for row in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
            if before + row["n"] >= need:
                cut = row["part"]
                break
            before += row["n"]
        taken, here, need = taken | (here & (part < cut)), here & (part == cut), need - before
        inside = rows.where(here)
    last = inside.orderBy("__draw", *ties).limit(need)
    return rows.where(taken).unionByName(last).drop("__draw")


def hash_draw(key: Column) -> Column:
    """The first 48 bits of a `hash_key` as a number; keys in their order have draws that do not descend."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double")


def sample_users(df: DataFrame, n: int, seed: int = 42, key: str = "user_id") -> DataFrame:
    """`n` distinct keys, chosen by hash. A seed for each round gives another set each round."""
    drawn = hash_key(seed, key)
    return smallest(df.select(key).where(F.col(key).isNotNull()).distinct(), n, hash_draw(drawn), drawn, key)


def keep_users(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    return df.join(users.select(key), key, "left_semi")


def weighted_sample(df: DataFrame, n: int, weight: Column, seed: int = 42, key: str = "user_id") -> DataFrame:
    """`n` keys without replacement, by weight (Efraimidis and Spirakis, 2006): the smallest -ln(u) / weight, u from a hash.

    `df` has one row for each key; weights that are null or not over zero are never drawn.
    """
    draw = F.round(-F.log(hash_uniform(hash_key(seed, key))) / weight, 12)
    return smallest(df.where(F.coalesce(weight > 0, F.lit(False))), n, draw, key).select(key)


def degrees(inter: DataFrame, key: str) -> DataFrame:
    return inter.groupBy(key).agg(F.count("*").alias("degree"))


def user_item_degrees(inter: DataFrame) -> DataFrame:
    """(user_id, degree): the sum over a user's rows of how often their items occur."""
    return inter.join(degrees(inter, "item_id"), "item_id").groupBy("user_id").agg(F.sum("degree").alias("degree"))


OBJECTIVES = {"random": lambda d: F.lit(1.0), "dense": lambda d: d.cast("double"), "sparse": lambda d: 1.0 / d}


def two_hop(inter: DataFrame, n_start: int, n_tail: int, n_items: int, n_users: int, objective: str = "random", tail: int = 5, seed: int = 42) -> DataFrame:
    """Interactions of a sample: start users and long-tail users, then items of theirs, then users of those items.

    Items and users are drawn by weight: 1, their degree, or its inverse. `inter`
    should be stored, as it is read for each hop.
    """
    by_user = degrees(inter, "user_id")
    weight = OBJECTIVES[objective](F.col("degree"))
    start = sample_users(by_user.where(F.col("degree") > tail), n_start, seed)
    more = sample_users(by_user.where(F.col("degree") <= tail), n_tail, seed)
    first = materialize(start.union(more), "start")
    reached = inter.join(first, "user_id", "left_semi").select("item_id").distinct()
    items = materialize(weighted_sample(degrees(inter, "item_id").join(reached, "item_id", "left_semi"), n_items, weight, seed + 1, "item_id"), "items")
    others = inter.join(items, "item_id", "left_semi").select("user_id").distinct().join(first, "user_id", "left_anti")
    second = weighted_sample(by_user.join(others, "user_id", "left_semi"), n_users, weight, seed + 2, "user_id")
    return inter.join(first.union(second), "user_id", "left_semi").join(items, "item_id", "left_semi")


def frontier(inter: DataFrame, start: DataFrame, per_item: int, per_user: int, total: int, objective: str = "random", max_rounds: int = 20, seed: int = 42, start_key: str = "user_id") -> tuple[DataFrame, DataFrame, int]:
    """(users, items, rounds used): walks users, items, users until `total` users are reached.

    In each round the frontier's neighbours that are new are drawn, `per_user`
    times the size of the frontier of items and `per_item` times of users, by
    weight. Starts from users or, with start_key item_id, from items. Each round
    is written to the shared folder; only counts reach the driver. Ends when no
    round adds a user. `inter` should be stored, as each round reads it.
    """
    weight = OBJECTIVES[objective](F.col("degree"))
    degree = {k: materialize(degrees(inter, k), f"degree-{k}") for k in ("user_id", "item_id")}
    other = {"user_id": "item_id", "item_id": "user_id"}
    seen = {start_key: materialize(start.select(start_key).distinct(), "seen")}
    seen[other[start_key]] = inter.select(other[start_key]).limit(0)
    front, key, rounds, idle = seen[start_key], start_key, 0, 0
    n_users = front.count() if start_key == "user_id" else 0
    size = front.count()
    while n_users < total and rounds < max_rounds and idle < 2 and size:
        rounds += 1
        target = other[key]
        reached = inter.join(front, key, "left_semi").select(target).distinct().join(seen[target], target, "left_anti")
        quota = size * (per_user if target == "item_id" else per_item)
        if target == "user_id":
            quota = min(quota, total - n_users)
        front = materialize(weighted_sample(degree[target].join(reached, target, "left_semi"), quota, weight, seed + rounds, target), "front")
        seen[target] = materialize(seen[target].union(front), "seen")
        added = front.count()
        n_users += added if target == "user_id" else 0
        idle = idle + 1 if not added else 0
        size, key = max(added, 0), target
    return seen["user_id"], seen["item_id"], rounds


def dense_index(df: DataFrame, key: str | list[str], name: str = "idx") -> DataFrame:
    """(key columns, index): distinct keys numbered from 0 in their order; keys with a null are left out.

    Keys are range-partitioned and stored; each range counts on from the ranges
    before it, so no task sees all of them.
    """
    keys = [key] if isinstance(key, str) else key
    found = df.select(*keys).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).distinct()
    parts = materialize(found.repartitionByRange(*map(F.col, keys)).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return parts.withColumn("__rn", rank).join(F.broadcast(before), "__part").select(*keys, (F.col("__rn") + F.col("__before")).cast("long").alias(name))


def number_in_groups(df: DataFrame, group: str, order: list[str], place: str = "place", total: str = "total") -> DataFrame:
    """Adds `place` (from 0 on in each group, in `order`) and `total` (rows of the group); `group` has no null.

    Rows are range-partitioned by group and order, so a large group spreads over
    many tasks; each range counts on from the ranges before it. Rows that are
    equal in all these columns take their places in any order.
    """
    keys = [group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    counted = stored.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(group, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias(total))
    return stored.join(starts, [group, "__part"]).withColumn(place, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def most_frequent(table: DataFrame, most: int, count: str) -> tuple[DataFrame, DataFrame]:
    """(the rows with the largest counts, `most` at most; all others).

    Cuts at a quarter of a power of two, so that only the number of rows for
    each of these levels, 256 at most, reaches the driver.
    """
    level, kept, cut = F.floor(F.log2(F.col(count)) * 4), 0, None
    for row in table.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
        if kept + row["k"] > most:
            break
        kept, cut = kept + row["k"], row["level"]
    inside = F.coalesce(level >= cut, F.lit(False)) if cut is not None else F.lit(False)
    return table.where(inside), table.where(~inside)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that `df` does not have, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any((mark + name).lower() in taken for name in names):
        mark += "_"
    return [mark + name for name in names]


def grown(df: DataFrame) -> DataFrame:
    """`df`, which a join never sends to all tasks: Spark takes the rows of an explode for as few as there were before it.

    Both sides are sorted, unless the other one is marked with `F.broadcast`.
    """
    return df.hint("merge")


#: Bits of the table of `possible`; its rows take 16 MB at most.
FILTER_BITS = 1 << 26


def possible(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose `column` may be among `keys`, the others), by a broadcast bit table of bounded size.

    Keeps rows that have no partner out of a shuffle. Every row is in one of
    the two, and those with a partner are in the first.
    """

    slot, bit, bits = fresh(df, "slot", "bit", "bits")

    def place(frame: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
        return frame.withColumns({slot: F.shiftright(at, 6), bit: at.bitwiseAND(F.lit(63).cast("long")).cast("int")})

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))
    table = place(keys.select(column)).groupBy(slot).agg(F.bit_or(one).alias(bits))
    marked = place(df).join(F.broadcast(table), slot, "left")
    found = F.coalesce(F.getbit(bits, bit) == 1, F.lit(False))
    return marked.where(found).select(*df.columns), marked.where(~found).select(*df.columns)
