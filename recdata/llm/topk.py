"""Exact top-k by inner product with a dual-tree search over cover trees.

Queries and data are indexed alike: the nodes of an upper level, chosen
farthest first from a bounded sample, are dealt out over blocks, and every
block has a cover tree. A pair of nodes is dropped, with all its vectors, if no
inner product between them can reach the worst k-th score of the queries below
the query node: first pairs of upper nodes, then, descending both trees of two
blocks together, pairs of ever smaller nodes. A task takes a query block and a
few data blocks, best bound first, and carries the k-th scores of its queries
from one data block to the next.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .covertree import Search, bounds, cover_tree, farthest_first

#: Vectors of the sample; upper nodes at most; vectors of a data block and of a query block, about; data blocks of a task.
SAMPLE, UPPER, BLOCK, ASKED, CHUNK = 2048, 256, 4096, 1024, 4


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    norms = (centres * centres).sum(1)
    return np.concatenate([np.zeros(0, int), *(np.argmin(norms - 2 * (x[i : i + 4096] @ centres.T), axis=1) for i in range(0, len(x), 4096))])


def scaled(df: DataFrame, is_query: Column, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id long, asks, v array<double>: floor(scale * x)) of the vectors that take part."""
    v = F.col(vector_col)
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _assigned(vectors: DataFrame, centres: np.ndarray, n_asked: int, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """Each vector with its upper node, for queries among the first `n_asked`, in rows of their own; for queries also the k-th best score in the sample, which no k-th best score in all rows is below."""
    width = sample.shape[1]

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, vectors, queries in batches:
            x, asks = _matrix(vectors, width), np.array(queries, bool)
            least = np.full(len(x), -np.inf)
            own = np.array(ids, np.int64)
            if asks.any() and len(sample) > k:
                scores = x[asks] @ sample.T
                scores[own[asks][:, None] == sample_ids[None, :]] = -np.inf
                least[asks] = np.partition(scores, -k, axis=1)[:, -k]
            packed = [r.tobytes() for r in x]
            for some, known, asking in ((np.arange(len(x)), centres, False), (np.flatnonzero(asks), centres[:n_asked], True)):
                if len(some):
                    at = nearest(x[some], known)
                    far = np.sqrt(((x[some] - known[at]) ** 2).sum(1))
                    yield {"id": own[some], "v": [packed[i] for i in some.tolist()], "leaf": at.astype(np.int32), "far": far, "asks": [asking] * len(some), "least": least[some]}

    fields = {"id": "long", "v": "binary", "leaf": "int", "far": "double", "asks": "boolean", "least": "double"}
    return map_rows(vectors, ["id", "v", "asks"], rows, fields)


class Upper:
    """What is known of the upper nodes of one side: which have vectors, how many blocks, radius, smallest lower bound."""

    def __init__(self, placed: DataFrame, block: int) -> None:
        found = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("least").alias("least")).orderBy("leaf").collect()
        self.leaves = np.array([r["leaf"] for r in found], int)
        self.blocks = np.array([-(-r["n"] // block) for r in found], int)
        self.radii = np.array([r["far"] for r in found], float) * (1 + 1e-9) + 1e-9
        self.least = np.array([r["least"] for r in found], float)


def _frame(df: DataFrame, frame: pd.DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(list(frame.itertuples(index=False, name=None)), schema)


def _blocks(rows: DataFrame, upper: Upper, width: int, name: str) -> DataFrame:
    """One row for each block of an upper node: its cover tree, and the lower bounds of its rows."""
    salts = _frame(rows, pd.DataFrame({"leaf": upper.leaves, "salts": upper.blocks}), "leaf int, salts int")
    salted = rows.join(F.broadcast(salts), "leaf").withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.col("salts").cast("long")).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["id", "v"])
        x = np.frombuffer(b"".join(frame["v"]), "<f8").reshape(-1, width)
        tree = cover_tree(frame["id"].to_numpy(np.int64), x)
        packed = pickle.dumps((tree, frame["least"].to_numpy(float)[tree.order]))
        return pd.DataFrame([{"leaf": int(frame["leaf"].iloc[0]), "salt": int(frame["salt"].iloc[0]), "tree": packed}])

    return materialize(salted.groupBy("leaf", "salt").applyInPandas(build, "leaf int, salt int, tree binary"), name)


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows with the largest inner product, itself excepted.

    Components are floor(scale * x) first, so scores are integers (exact below
    2^53). Ties go to the smaller id, and a query with fewer than k candidates
    gets all. Vectors that are null, or hold a null or a component that is not
    finite, take no part, nor do rows with a null id. Shorter vectors count as
    filled up with zeros. Rows that repeat an id and its vector count once; of
    vectors with one id the larger score counts. An empty table gives an empty
    result; other columns are not read.

    At most SAMPLE vectors and the sizes of UPPER nodes reach the driver, and at
    most UPPER squared pairs of nodes are sent to all tasks. Nodes with many
    vectors, copies among them, are dealt out over blocks of bounded size, and a
    task holds one query block and CHUNK data blocks. Work on pairs of blocks
    grows with their number, as exact search must where nothing can be pruned.
    """
    vectors = scaled(df, is_query, scale, id_col, vector_col)
    total = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sum(F.col("asks").cast("long")).alias("asked")).first()
    n, width = total["n"], max(1, total["width"] or 1)
    some = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("id", "v").toPandas().drop_duplicates("id")
    sample, sample_ids = _matrix(some["v"].tolist(), width), some["id"].to_numpy(np.int64)
    centres = sample[farthest_first(sample, min(UPPER, -(-n // BLOCK)))] if n else np.zeros((1, width))
    placed = materialize(_assigned(vectors, centres, max(1, -(-(total["asked"] or 0) // ASKED)), sample_ids, sample, k), "vectors")
    data, asked = Upper(placed.where("NOT asks"), BLOCK), Upper(placed.where("asks"), ASKED)
    most = bounds(centres[asked.leaves], asked.radii, centres[data.leaves], data.radii)
    met = []
    for q, leaf in enumerate(asked.leaves.tolist()):
        first = 0
        for d in np.argsort(-most[q], kind="stable").tolist():
            if most[q, d] >= asked.least[q]:
                met.append((leaf, int(data.leaves[d]), int(data.blocks[d]), first))
                first += int(data.blocks[d])
    pairs = df.sparkSession.createDataFrame(met, "q_leaf int, leaf int, salts int, first int")
    left = _blocks(placed.where("asks"), asked, width, "queries").select(F.col("leaf").alias("q_leaf"), F.col("salt").alias("q_salt"), F.col("tree").alias("q_tree"))
    right = _blocks(placed.where("NOT asks"), data, width, "data")
    joined = left.join(F.broadcast(pairs), "q_leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(right, ["leaf", "salt"])
    turns = joined.withColumn("turn", F.col("first") + F.col("salt")).withColumn("chunk", F.floor(F.col("turn") / CHUNK))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        queries, least = pickle.loads(frame["q_tree"].iloc[0])  # noqa: S301  written by _blocks
        found = Search(queries, k, least)
        for tree in frame.sort_values("turn")["tree"]:
            found.run(pickle.loads(tree)[0])  # noqa: S301
        ids, vec_ids, scores = found.found()
        return pd.DataFrame({"query_id": ids, "vec_id": vec_ids, "score": scores})

    best = turns.select("q_leaf", "q_salt", "chunk", "turn", "q_tree", "tree").groupBy("q_leaf", "q_salt", "chunk").applyInPandas(search, "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
