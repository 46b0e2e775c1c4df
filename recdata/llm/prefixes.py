"""Set similarity by prefixes of shingles, without a lost pair.

If two sets have a Jaccard similarity of t or more, then in any order of all
shingles the first n - ceil(t n) + 1 of each (n: its size) have one in common.
Any order is right; one that puts frequent shingles last keeps groups small
(Chaudhuri, Ganti and Kaushik, "A Primitive Operator for Similarity Joins in
Data Cleaning", 2006). Frequencies come from a sketch of fixed size over all
documents: shingles are counted by a part of their hash, and only those whose
counter stands out count as frequent. The sketch changes the work, never the
result.

A pair's first common shingle also tells how many more there can be: as many as
each set has after it. Where that is too few for t, the pair is passed over
(Xiao et al., "Efficient Similarity Joins for Near-Duplicate Detection", 2011).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, possible, release, slices
from .ctw import lower_bytes
from .substrings import Hashed

#: Counters of the sketch, and of a block of it.
SKETCH, BLOCK = 1 << 20, 1 << 12
#: Rounds in which groups meet by pivots before all pairs between components are formed.
TURNS = 6
#: Pairs for each posting up to which all are formed at once.
MANY = 4


def unique_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the shingles of some texts, each once, one text after the other, and how many each has; fewer words than `size` make one."""
    hashed = Hashed([lower_bytes(t).split() for t in texts], 64)
    n = np.maximum(hashed.counts - size + 1, np.minimum(hashed.counts, 1))
    offset = np.cumsum(hashed.counts) - hashed.counts
    first = np.cumsum(n) - n
    start = np.repeat(offset - first, n) + np.arange(n.sum())
    hashes = hashed.of(start, np.minimum(start + size, np.repeat(offset + hashed.counts, n)))
    parts = [np.unique(hashes[s : s + k]) for s, k in zip(first.tolist(), n.tolist(), strict=True)]
    return np.concatenate(parts) if parts else hashes, np.array([len(p) for p in parts], np.int64)


def sketch_rows(counted: np.ndarray) -> Iterator[dict]:
    """The counters of one task, in blocks that have any."""
    part = TaskContext.get().partitionId()
    blocks = np.flatnonzero(counted.reshape(-1, BLOCK).any(axis=1))
    for some in np.array_split(blocks, max(1, -(-len(blocks) // 32))):
        if len(some):
            yield {"block": some.astype(np.int32), "part": np.full(len(some), part, np.int32), "counts": [counted[b * BLOCK : (b + 1) * BLOCK].astype("<i8").tobytes() for b in some.tolist()]}


def merged_sketch(sketch: DataFrame) -> np.ndarray:
    """For each counter the level of the shingles in it: 0 where it does not stand out from all, more the more frequent they are.

    Blocks are added up twice, first for some tasks and then for all, so no
    group has more rows than about the root of the number of tasks. The driver
    gets 8 bytes a counter, 8 MB in all, and sends one byte a counter to the tasks.
    """

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in frame["counts"])
        return pd.DataFrame([{"block": int(frame["block"].iloc[0]), "counts": total.tobytes()}])

    salts = max(1, int((sketch.agg(F.max("part")).first()[0] or 0) ** 0.5))
    once = sketch.withColumn("salt", F.col("part") % salts).groupBy("block", "salt").applyInPandas(added, "block int, counts binary")
    total = np.zeros(SKETCH, np.int64)
    for row in once.groupBy("block").applyInPandas(added, "block int, counts binary").toLocalIterator():
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], "<i8")
    mean = total.sum() / SKETCH
    over = (total - mean) / (4 * np.sqrt(mean) + 4)
    return np.where(over > 1, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def shared_postings(docs: DataFrame, prints: DataFrame, distinct: DataFrame, sketch: DataFrame, size: int, least: float) -> DataFrame:
    """(key, id, n, at): the prefix of each distinct set, each shingle with its place in it, without those that one set alone has there; stored.

    `docs` has id and text, `prints` id and set, and `distinct` least (the id
    that stands for a set). Of texts, only those that may be copies are
    shuffled, to leave out the copies.
    """
    levels = merged_sketch(sketch)

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, texts in batches:
            for part in slices([t or "" for t in texts], 1 << 19):
                hashes, n = unique_shingles([t or "" for t in texts[part]], size)
                ends = np.cumsum(n)
                level = levels[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]
                taken = []
                for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True):
                    most = e - s - int(np.ceil(least * (e - s) - 1e-9)) + 1
                    order = np.argsort(level[s:e], kind="stable") if level[s:e].any() else slice(None)  # hashes ascend already
                    taken.append(hashes[s:e][order][:most] if e > s else hashes[:0])
                sizes = np.array([len(x) for x in taken], np.int64)
                yield {"key": np.concatenate(taken).view(np.int64), "id": np.repeat(np.array(ids[part], np.int64), sizes), "n": np.repeat(n, sizes).astype(np.int32), "at": (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)}

    copies = prints.where("id IS NOT NULL").join(distinct.select(F.col("least").alias("id")), "id", "left_anti").select("id").distinct()
    maybe, rest = possible(docs.where("id IS NOT NULL"), "id", copies)
    texts = rest.unionByName(maybe.join(copies, "id", "left_anti"))
    stored = materialize(map_rows(texts, ["id", "text"], rows, {"key": "long", "id": "long", "n": "int", "at": "int"}), "prefixes")
    shared = materialize(stored.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key"), "shared")
    found = materialize(possible(stored, "key", shared)[0].join(shared, "key").groupBy("key", "id").agg(F.min("n").alias("n"), F.min("at").alias("at")), "postings")
    release(stored, shared)
    return found


def crossing(postings: DataFrame, found: DataFrame, least: float, turn: int) -> tuple[DataFrame, bool]:
    """(pairs a, b of sets of different components that share a shingle of their prefixes and may be similar, whether these are all; stored).

    They are all where there are at most some times as many as postings. If they
    are more, large groups have not come together yet: for the first TURNS turns
    each set then meets one other, a pivot of one of its shingles that changes
    from turn to turn, which brings groups together without all their pairs.
    """
    names = found.select(F.col("node").alias("id"), F.col("component"))
    placed = materialize(postings.join(names, "id", "left").select("key", "id", "n", "at", F.coalesce("component", "id").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rows = materialize(placed.join(mixed, "key"), "crossing")
    release(placed)
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    counted = rows.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("k"), square("c").alias("within"))
    told = counted.agg((square("k") - F.sum("within")) / 2, F.sum("k")).first()
    whole = turn >= TURNS or (told[0] or 0) <= MANY * (told[1] or 0)
    # no more can be common than stand from this shingle on, and so many must be
    fit = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) >= F.ceil(F.lit(least / (1 + least)) * (F.col("an") + F.col("bn")) - 1e-9)
    fit = fit & (F.least("an", "bn") >= F.greatest("an", "bn") * least - 1e-9)
    left = rows.select("key", F.col("id").alias("x"), F.col("n").alias("an"), F.col("at").alias("aat"), F.col("component").alias("ac"))
    if whole:
        right = rows.select("key", F.col("id").alias("y"), F.col("n").alias("bn"), F.col("at").alias("bat"), F.col("component").alias("bc"))
        met = left.join(right, "key").where((F.col("ac") < F.col("bc")) & fit)
    else:
        draw = F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n", "at", "component")
        pivots = rows.groupBy("key").agg(F.min(draw).alias("p")).select("key", "p.draw", F.col("p.id").alias("y"), F.col("p.n").alias("bn"), F.col("p.at").alias("bat"), F.col("p.component").alias("bc"))
        met = left.join(pivots, "key").where((F.col("ac") != F.col("bc")) & fit).groupBy("x").agg(F.min_by("y", F.struct("draw", "y")).alias("y"))
    pairs = materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    release(rows)
    return pairs, whole
