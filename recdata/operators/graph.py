"""Connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recdata.sources.scratch import materialize, release

#: Edges that a task holds at once while it looks for a forest.
HELD = 1 << 20
#: Edges of a node from which on they are dealt out over SPREAD tasks; of all edges, one node in HUBS has as many at most.
HUB, HUBS, SPREAD = 10_000, 5_000, 32


def forest_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) with the same components as the edges (u, v): each node that is not the least of its component with the least one."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(codes[: len(u)].tolist(), codes[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = np.array([root(x) for x in range(len(parent))], np.int64)
    moved = np.flatnonzero(found != np.arange(len(found)))
    return names[moved], names[found[moved]]


def spanning_forests(edges: DataFrame) -> DataFrame:
    """(u, v) with the components of `edges` (u, v): a forest for each HELD edges of a task, found before anything is shuffled.

    It has an edge for each node but one of a component, however many edges the
    component has.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= HELD:
                yield found(held)
                held = []
        if held:
            yield found(held)

    def found(held: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(held)
        return pd.DataFrame(dict(zip(("u", "v"), forest_of(whole["u"].to_numpy(), whole["v"].to_numpy()), strict=True)))

    return edges.mapInPandas(rows, edges.schema)


def _met(rows: DataFrame, told: DataFrame, n_edges: int) -> DataFrame:
    """`rows` (u, v) joined with `told` (u, m, n: rows of u). The rows of hubs are dealt out over SPREAD keys each."""
    hub = F.col("n") > max(HUB, n_edges // HUBS)
    hubs = told.where(hub).select("u", F.lit(True).alias("hub"))  # 2 * HUBS nodes at most
    dealt = rows.join(F.broadcast(hubs), "u", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))).drop("hub")
    salts = F.when(hub, F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(told.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node of an edge.

    Each task first sends a spanning forest of its edges. Then the two star
    steps of Kiveris et al., "Connected Components in MapReduce and Beyond"
    (2014), alternate: the large-star step links each larger neighbour, the
    small-star step each smaller one, to the smallest neighbour. The number of
    rounds grows with the logarithm of the size of the largest component, each
    round is two shuffles of at most as many edges as there were, in which the
    edges of hubs are dealt out, and each is written to the shared folder. Only
    counts reach the driver. Null ends and self-loops are dropped (a node that
    has only a self-loop is not in the result). An error is raised if
    `max_rounds` do not suffice.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = keep(spanning_forests(edges).distinct(), "edges")
    for _ in range(max_rounds):
        n_edges = edges.count()
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.unionByName(back)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _met(back, least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _met(large, root, n_edges).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = keep(small, "edges")
        # a star forest of unchanged edges: nothing more to do
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        release(edges)  # each round is read by the next one alone
        edges = after
        if not changed:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
