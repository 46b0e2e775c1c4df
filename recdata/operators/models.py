"""Recommenders: scoring, full-catalogue ranking, and Spark ML models behind DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recdata.functions.scalar import dot, hash_key, hash_uniform
from recdata.sources.scratch import materialize

from .sample import dense_index
from .similarity import numbered_vectors, suffices

#: Distinct vectors of one block of the catalogue at most, users that a copy of it meets, about, and users and scores made at once.
BLOCK, USERS, STRIPE, CELLS = 1 << 19, 1 << 17, 256, 1 << 22
#: Rows that the users of a copy of a block give, about: a task holds them until it ends.
ROWS = 1 << 22


#: Pairs of a task that meets two blocks of vectors: so many at least, and so many for each vector of a block; pairs multiplied at once.
PAIRS, EACH, CHUNK = 1 << 16, 32, 1 << 15


def dealt_pairs(pairs: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, more: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> tuple[DataFrame, DataFrame, list[str]]:
    """(pairs with the numbers of their vectors in __u and __i, distinct vectors, columns by which both are dealt to tasks).

    Distinct vectors are numbered and stand in blocks; a pair moves as two
    numbers to the blocks of its vectors, which go to a task for every PAIRS
    pairs or EACH times as many as a block has vectors. No vector is joined to a
    pair. Pairs with an id that has no row among the vectors are left out.
    `more` has other columns of users and of items, by their ids, which come
    along. `pairs` is how many pairs a task has, about.
    """
    (users, mine, n_mine), (items, theirs, n_theirs) = (numbered_vectors(t.select(F.col(k).alias("item_id"), "vec")) for t, k in ((user_vectors, "user_id"), (item_vectors, "item_id")))
    rows = pairs
    for key, table, num, block, extra in (("user_id", users, "__u", "__a", more[0]), ("item_id", items, "__i", "__b", more[1])):
        told = table.select(F.col("item_id").alias(key), F.col("num").alias(num), F.col("block").alias(block))
        rows = rows.join(told if extra is None else told.join(extra, key), key)
    rows = materialize(rows, "numbered-pairs")
    share = max(PAIRS, EACH * max(n_mine, n_theirs))
    counted = rows.groupBy("__a", "__b").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / share))
    copies = materialize(counted.select("__a", "__b", "copies", (F.col("n") / F.col("copies")).alias("pairs")), "copies")  # one row for a pair of blocks
    asked = rows.join(F.broadcast(copies), ["__a", "__b"]).withColumn("__copy", F.pmod(F.xxhash64("user_id", "item_id"), F.col("copies"))).drop("copies")
    cells = copies.select("__a", "__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("__copy"))
    cell = ["__a", "__b", "__copy"]
    held = [table.withColumn(at, F.col("block")).join(F.broadcast(cells), at).select(*cell, F.lit(side).alias("side"), "num", "vec") for side, table, at in ((0, mine, "__a"), (1, theirs, "__b"))]
    return asked, held[0].unionByName(held[1]), cell


def vectors_of(held: pa.Table, side: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of one side by ascending number, the last row for those without one, their widths, and the row of each number asked for."""
    rows = held.filter(pa.compute.equal(held["side"], side)).sort_by("num")
    vecs, nums = rows["vec"].combine_chunks(), rows["num"].to_numpy()
    sizes = pa.compute.list_value_length(vecs).to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(nums) + 1, max(sizes, default=0)))
    at = np.repeat(np.arange(len(nums)), sizes)
    if len(at):
        out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vecs.flatten().to_numpy(zero_copy_only=False)
    return out, np.append(sizes, -1), np.where(asked < 0, len(nums), np.searchsorted(nums, asked))


def met_pairs(pairs: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, tell: Callable[..., dict[str, pa.Array]], fields: dict[str, str], more: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """The columns of `pairs` (user_id, item_id and others) and `more` with those that `tell` makes of the vectors of both ids, see `dealt_pairs`.

    `tell` gets the two matrices of a task, the rows of each pair in them,
    and which of the pairs have two vectors of one width without a null.
    """
    asked, held, cell = dealt_pairs(pairs, user_vectors, item_vectors, more)
    asked = asked.drop("pairs")
    names = [c for c in asked.columns if c not in ("__u", "__i", *cell)]

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        (a, a_sizes, u), (b, b_sizes, i) = (vectors_of(held, k, asked[c].to_numpy()) for k, c in ((0, "__u"), (1, "__i")))
        told = tell(a, b, u, i, (a_sizes[u] == b_sizes[i]) & (a_sizes[u] >= 0))
        return pa.table({**{c: asked[c] for c in names}, **told})

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*names).schema] + [f"`{n}` {k}" for n, k in fields.items()])
    return asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(work, kinds)


def _products(a: np.ndarray, b: np.ndarray, u: np.ndarray, i: np.ndarray, known: np.ndarray) -> dict[str, pa.Array]:
    """Inner products, summed in the order of the components as `dot` does; null where a vector is not known."""
    out = np.zeros(len(u))
    for first in range(0, len(u), CHUNK):
        some = slice(first, first + CHUNK)
        for x, y in zip(a[u[some]].T, b[i[some]].T, strict=False):
            out[some] += x * y
    return {"product": pa.array(out, mask=~known)}


def score_pairs(cand: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, user_bias: DataFrame | None = None, item_bias: DataFrame | None = None, bias: float = 0.0, behind: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(user_id, item_id, score): inner product of the two vectors, plus biases; a missing bias counts 0.

    Vectors that many users or items share meet the pairs in blocks, see
    `met_pairs`. `behind` has (user_id, vec) and (item_id, vec) that are put
    behind the others: short ones that each id has for itself, such as
    `normalised_ids`. They move with the pairs.
    """
    score, more = F.col("product"), []
    if behind is not None:
        products = F.zip_with("v_user_id", "v_item_id", lambda x, y: x.cast("double") * y.cast("double"))
        score = F.aggregate(products, score, lambda acc, x: acc + x)
    score = score + F.lit(bias)
    for key, vectors, last, offset in zip(("user_id", "item_id"), (user_vectors, item_vectors), behind or (None, None), (user_bias, item_bias), strict=True):
        table = None if last is None else last.select(key, F.col("vec").alias(f"v_{key}"))
        if offset is not None:
            table = (vectors.select(key).distinct() if table is None else table).join(offset.select(key, F.col("bias").alias(f"b_{key}")), key, "left")
            score = score + F.coalesce(f"b_{key}", F.lit(0.0))
        more.append(table)
    found = met_pairs(cand.select("user_id", "item_id"), user_vectors, item_vectors, _products, {"product": "double"}, tuple(more))
    return found.select("user_id", "item_id", score.alias("score"))


def joined_scores(cand: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """`cand` with score: inner product of the two vectors plus both biases (vec and bias are columns of both tables); vectors are joined to the pairs, so they should be short."""
    sides = [t.select(k, F.col("vec").alias(v), F.col("bias").alias(f"{v}b")) for t, k, v in ((user_vectors, "user_id", "__uv"), (item_vectors, "item_id", "__iv"))]
    rows = cand.join(sides[0], "user_id").join(sides[1], "item_id")
    return rows.withColumn("score", dot(F.col("__uv"), F.col("__iv")) + F.coalesce("__uvb", F.lit(0.0)) + F.coalesce("__ivb", F.lit(0.0))).drop("__uv", "__iv", "__uvb", "__ivb")


def concat_vectors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, vec): the two vectors of a key put together."""
    return a.select(key, F.col("vec").alias("va")).join(b.select(key, F.col("vec").alias("vb")), key).select(key, F.concat("va", "vb").alias("vec"))


def normalised_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, vec): one component, the place of the key among all, from 1 on, over their number."""
    index = materialize(dense_index(df, key), "ids")
    total = index.agg(F.count("*").alias("n"))
    return index.join(F.broadcast(total)).select(key, F.array((F.col("idx") + 1) / F.col("n")).alias("vec"))


@dataclass
class Ranking:
    """The rows of `top_n`, and the pairs of users and blocks that it multiplied."""

    rows: DataFrame
    met: list[DataFrame]
    n_blocks: int
    n_users: int

    def share_met(self) -> float:
        return sum(pairs.count() for pairs in self.met) / max(1, self.n_blocks * self.n_users)


def top_n(user_vectors: DataFrame, item_vectors: DataFrame, used: DataFrame, n: int = 1000, cover: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank) of the n best items that a user has not used; ties go to the smaller id.

    With `cover` (user_id, item_id) a user's list is extended until it holds all
    of these, which costs the full scores of those users' items above their
    lowest one. See `top_n_ranking` for how it is found.
    """
    return top_n_ranking(user_vectors, item_vectors, used, n, cover).rows


def top_n_ranking(user_vectors: DataFrame, item_vectors: DataFrame, used: DataFrame, n: int = 1000, cover: DataFrame | None = None) -> Ranking:
    """`top_n` with the pairs of distinct users and blocks that were multiplied.

    Users with one vector are one, and items with one vector are one. A single
    user's used items are left out where scores are made; users that share a
    vector look for as many more items as any of them has used, and leave their
    own out afterwards. The distinct vectors of items stand in blocks (BLOCK at
    most, and BYTES) in order of their lengths, the longest first. No vector of
    a block scores more for a user than the user's length times the largest
    length in the block. So users begin with the first block and go on, a few
    more blocks in each round, only as long as the next block's bound reaches
    the last score they need; later blocks are never read for them. Users of a
    block are dealt over copies of it, USERS to a copy at most about.
    """
    spark = item_vectors.sparkSession
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    numbers, table, each = numbered_vectors(item_vectors)
    mine, people, _ = numbered_vectors(user_vectors.select(F.col("user_id").alias("item_id"), "vec"))
    mine = materialize(mine.where("num >= 0").select(F.col("item_id").alias("user_id"), F.col("num").alias("who")), "users")
    lengths = materialize(table.select("num", F.sqrt(dot(F.col("vec"), F.col("vec"))).alias("length")), "lengths")
    placed = dense_index(lengths.withColumn("order", -F.col("length")), ["order", "num"]).select("num", (F.col("idx") / min(BLOCK, each)).cast("int").alias("at"))
    listed = numbers.where("num >= 0").groupBy("num").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    stored = materialize(table.select("num", "vec").join(placed, "num").join(listed, "num").join(lengths, "num"), "blocks")
    tops = materialize(stored.groupBy("at").agg(F.max("length").alias("top"), F.sum(F.size("ids")).alias("items")), "tops")
    n_blocks = tops.count()
    gone = used.select("user_id", "item_id").distinct().join(mine, "user_id")
    sizes = mine.groupBy("who").agg(F.count("*").alias("users"))
    most = gone.groupBy("user_id", "who").agg(F.count("*").alias("c")).groupBy("who").agg(F.max("c").alias("most"))
    sized = materialize(sizes.join(most, "who", "left").select("who", "users", F.when(F.col("users") > 1, F.coalesce("most", F.lit(0))).otherwise(F.lit(0)).alias("more")), "sized")
    at_items = stored.select("at", F.explode("ids").alias("item_id"))
    alone = gone.join(sized.where("users = 1").select("who"), "who").join(at_items, "item_id")
    taken = materialize(alone.groupBy("who", "at").agg(F.collect_list("item_id").alias("used")), "used")
    known = people.select(F.col("num").alias("who"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).join(sized.select("who", (F.col("more") + n).alias("need")), "who")
    known = known.withColumn("length", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    if cover is not None:
        floors = score_pairs(cover, user_vectors, item_vectors).join(mine, "user_id").groupBy("who").agg(F.min("score").alias("floor"))
        known = known.join(floors, "who", "left").withColumn("floor", F.coalesce("floor", high))
    else:
        known = known.withColumn("floor", high)
    known = materialize(known.withColumn("seed", low), "known")
    n_users = known.count()

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(held):
            sizes = pa.compute.list_value_length(held["ids"]).to_numpy().astype(np.int64)
            ids, ends = held["ids"].combine_chunks().flatten().to_numpy(), np.cumsum(sizes)
            matrix = _stacked(held["vec"])
            asked = asked.sort_by("need")
            whos, needs, seeds, floors = (asked[c].to_numpy() for c in ("who", "need", "seed", "floor"))
            # a user with a floor may get every item of a vector, others as many as they need
            vectors, step = _stacked(asked["vec"]), max(1, min(STRIPE, CELLS // (len(matrix) if np.isinf(floors).all() else len(ids))))
            for first in range(0, len(whos), step):
                some = slice(first, first + step)
                scores = vectors[some] @ matrix.T
                left = [np.asarray(x or [], np.int64) for x in asked["used"][some].to_pylist()]
                wanted = needs[some] + np.array([len(x) for x in left])
                k = min(int(wanted.max()), len(matrix))
                last = np.partition(scores, len(matrix) - k, axis=1)[:, len(matrix) - k]
                # what may be among the best, and whatever lies over the floor
                least = np.minimum(np.maximum(np.where(k < wanted, -np.inf, last), seeds[some]), floors[some]) - 1e-9
                u, i = np.nonzero(scores >= least[:, None])
                count = np.where(np.isinf(floors[some][u]), np.minimum(sizes[i], wanted[u]), sizes[i])  # equal scores: smaller ids first
                enough = suffices(u, scores[u, i], count, wanted)
                kept = scores[u, i] >= np.minimum(enough, floors[some])[u] - 1e-9
                u, i, count = u[kept], i[kept], count[kept]
                at = np.repeat(ends[i] - sizes[i] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                rows = {"who": whos[some][np.repeat(u, count)], "item_id": ids[at], "score": scores[np.repeat(u, count), np.repeat(i, count)]}
                if any(map(len, left)):
                    kept = np.ones(len(at), bool)
                    bounds = np.searchsorted(np.repeat(u, count), np.arange(len(left) + 1))
                    for one, x in enumerate(left):
                        part = slice(bounds[one], bounds[one + 1])
                        kept[part] = ~np.isin(rows["item_id"][part], x)
                    rows = {c: x[kept] for c, x in rows.items()}
                out.append(rows)
        return pa.table({c: pa.array(np.concatenate([x[c] for x in out]) if out else [], kind) for c, kind in (("who", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()))})

    first, last, found, met = 0, 1, None, []
    while first < n_blocks:
        steps = F.explode(F.sequence(F.lit(first), F.lit(min(last, n_blocks) - 1))).alias("at")
        reach = known.select("who", "length", "need", "floor", F.least("seed", "floor").alias("least"), steps).join(F.broadcast(tops), "at")
        rows = F.when(F.col("floor") < high, F.col("items")).otherwise(F.least("need", "items"))
        pairs = materialize(reach.where(F.col("length") * F.col("top") * (1 + 1e-12) + 1e-8 >= F.col("least")).select("who", "at", rows.alias("rows")), "pairs")
        met.append(pairs)
        copies = materialize(pairs.groupBy("at").agg(F.ceil(F.greatest(F.count("*") / USERS, F.sum("rows") / ROWS)).alias("copies")), "copies")
        asked = pairs.drop("rows").join(F.broadcast(copies), "at").withColumn("copy", F.pmod(F.xxhash64("who"), F.col("copies"))).drop("copies").join(taken, ["who", "at"], "left").join(known.drop("length"), "who")
        cells = copies.select("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        dealt = stored.select("at", "vec", "ids").join(F.broadcast(cells), "at")
        scored = materialize(asked.groupBy("at", "copy").cogroup(dealt.groupBy("at", "copy")).applyInArrow(best, "who long, item_id long, score double"), "scored")
        found = scored if found is None else found.unionByName(scored)
        first, last = last, last * 4
        if first < n_blocks:
            seeds = found.join(known.select("who", "need"), "who").withColumn("__rn", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score")))).where("__rn = need").select("who", F.col("score").alias("nth"))
            known = materialize(known.join(seeds, "who", "left").withColumn("seed", F.coalesce("nth", low)).drop("nth"), "known")
    if found is None:
        found = spark.createDataFrame([], "who long, item_id long, score double")
    found = found.withColumn("score", F.round("score", 9))
    if cover is None:
        place = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score"), "item_id"))
        found = found.withColumn("__rn", place).join(sized.select("who", F.col("more").alias("__more")), "who").where(F.col("__rn") <= F.col("__more") + n).select("who", "item_id", "score")
    rows = found.join(mine, "who").select("user_id", "item_id", "score")
    own = gone.join(sized.where("users > 1").select("who"), "who", "left_semi").select("user_id", "item_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")).alias("rank")
    if cover is None:
        ranked = rows.join(own, ["user_id", "item_id"], "left_anti").select("user_id", "item_id", "score", rank)
        return Ranking(ranked.where(F.col("rank") <= n), met, n_blocks, n_users)
    # what a list must hold (1) and what it must not (2) go along with it to its user, so that the lists are made and moved once
    wanted = cover.select("user_id", "item_id").where("user_id IS NOT NULL AND item_id IS NOT NULL").distinct()
    marks = wanted.withColumn("__mark", F.lit(1)).unionByName(own.withColumn("__mark", F.lit(2)))
    both, same = rows.unionByName(marks, allowMissingColumns=True).repartition("user_id"), Window.partitionBy("user_id", "item_id")
    marked = both.withColumns({"__held": F.max(F.col("__mark") == 1).over(same), "__gone": F.max(F.col("__mark") == 2).over(same)})
    marked = marked.where("__mark IS NULL AND NOT coalesce(__gone, false)")
    ranked = marked.select("user_id", "item_id", "score", rank, "__held")
    last = F.max(F.when(F.col("__held"), F.col("rank"))).over(Window.partitionBy("user_id"))
    rows = ranked.withColumn("__last", last).where(F.col("rank") <= F.greatest(F.lit(n), F.coalesce("__last", F.lit(0)))).drop("__held", "__last")
    return Ranking(rows, met, n_blocks, n_users)


def _stacked(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows of a matrix, in double precision."""
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def fit_als(inter: DataFrame, rank: int = 100, iterations: int = 10, reg: float = 0.1, alpha: float = 1.0, seed: int = 42) -> ALSModel:
    """Implicit matrix factorisation by weighted least squares; ids must fit an int."""
    rows = inter.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"), F.col("rating").cast("float").alias("rating"))
    return ALS(rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="rating", seed=seed, coldStartStrategy="drop").fit(rows)


def als_vectors(model: ALSModel) -> tuple[DataFrame, DataFrame]:
    """(user vectors, item vectors) of a fitted model."""
    users = model.userFactors.select(F.col("id").cast("long").alias("user_id"), F.col("features").alias("vec"))
    return users, model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.col("features").alias("vec"))


def pair_features(cand: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """`cand` with features: user and item vector put together, for a factorisation machine or a multilayer perceptron."""
    joined = cand.join(user_vectors.select("user_id", F.col("vec").alias("uv")), "user_id").join(item_vectors.select("item_id", F.col("vec").alias("iv")), "item_id")
    return joined.withColumn("features", array_to_vector(F.concat("uv", "iv"))).drop("uv", "iv")


def fit_fm(features: DataFrame, factors: int = 8, iterations: int = 20, seed: int = 42):  # noqa: ANN201
    return FMClassifier(featuresCol="features", labelCol="label", factorSize=factors, maxIter=iterations, stepSize=0.05, seed=seed).fit(features)


def fit_mlp(features: DataFrame, width: int, hidden: int = 32, iterations: int = 30, seed: int = 42):  # noqa: ANN201
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[width, hidden, 2], maxIter=iterations, seed=seed).fit(features)


def predict(model, features: DataFrame) -> DataFrame:  # noqa: ANN001
    """(user_id, item_id, score): the probability of label 1; also for items that training has not seen."""
    return model.transform(features).select("user_id", "item_id", vector_to_array("probability")[1].alias("score"))


#: Tokens that one task of Word2Vec learns from, about, and tasks at most.
LEARNED, TASKS = 1_000_000, 256


def text_vectors(chunks: DataFrame, size: int = 32, least: int = 2, seed: int = 42, tokens: str = "tokens") -> DataFrame:
    """`chunks` with vec: the mean Word2Vec vector of its tokens, learned from the chunks themselves.

    Spark learns in one task unless told otherwise; here as many tasks learn
    side by side as there are LEARNED tokens, and their vectors are brought
    together. All chunks are learned from.
    """
    n = chunks.agg(F.sum(F.size(tokens))).first()[0] or 0
    tasks = min(TASKS, max(1, math.ceil(n / LEARNED)))
    model = Word2Vec(vectorSize=size, minCount=least, inputCol=tokens, outputCol="__v", seed=seed, maxIter=1, numPartitions=tasks).fit(chunks)
    return model.transform(chunks).withColumn("vec", vector_to_array("__v")).drop("__v")


def apply_tower(vectors: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]], column: str = "vec") -> DataFrame:
    """Vectors after fully connected layers (matrix, bias) with ReLU between them."""

    @F.pandas_udf("array<double>")
    def forward(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), float).reshape(len(rows), -1)
        for k, (matrix, bias) in enumerate(weights):
            x = x @ matrix + bias
            if k + 1 < len(weights):
                x = np.maximum(x, 0)
        return pd.Series(list(x))

    return vectors.withColumn(column, forward(column))


def select_model(grid: list[dict], fit: Callable[[dict], DataFrame], score: Callable[[DataFrame], float]) -> tuple[dict, list[tuple[dict, float]]]:
    """(best parameters, all with their metric): `fit` gives predictions on validation data, `score` a metric of them, higher is better."""
    tried = [(params, score(fit(params))) for params in grid]
    return max(tried, key=lambda t: t[1])[0], tried


def select_by_halving(grid: list[dict], fit: Callable[[list[dict], DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], users: DataFrame, first: float = 0.25, keep: float = 0.5, seed: int = 42) -> tuple[dict, list[dict]]:
    """(best parameters, what each round told: round, users, and the metric by the candidate's place in `grid`).

    Successive halving (Jamieson and Talwalkar, 2016): a round judges all
    candidates left on a share of the users, drawn by hash, in one job; the
    better ones, `keep` of them, go on to twice the share, until all users are
    judged or one candidate is left. `fit` gives the predictions of some
    candidates for some users (user_id) in one table with the column candidate,
    `score` one row (candidate, metric) for each, higher is better. Ties go to
    the earlier candidate. Only one number for each candidate reaches the driver.
    """
    left, share, told = list(range(len(grid))), first, []
    while True:
        share = 1.0 if len(left) == 1 else min(share, 1.0)
        some = users.select("user_id").distinct().where(hash_uniform(hash_key(seed, "user_id")) < share)
        found = {row["candidate"]: row["metric"] for row in score(fit([{**grid[k], "candidate": k} for k in left], some)).collect()}
        order = sorted(left, key=lambda k: (-(found[k] if found.get(k) is not None else float("-inf")), k))
        told.append({"share": share, "metrics": {k: found.get(k) for k in left}})
        if share >= 1.0:
            return grid[order[0]], told
        left, share = sorted(order[: max(1, math.ceil(len(order) * keep))]), share * 2
