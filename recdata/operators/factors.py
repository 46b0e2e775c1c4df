"""Matrix factorisation with log loss, biases and sampled negatives, by stratified gradient descent.

Gemulla et al., "Large-Scale Matrix Factorization with Distributed Stochastic
Gradient Descent" (2011): users and items are dealt into as many blocks. A
stratum takes one block of items for each block of users, no two the same, so
its cells share no factor and are worked on side by side. A round over all
strata sees every pair once. Factors are a table that is written after each
stratum; a lost task repeats its cell from there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recdata.functions.scalar import sigmoid
from recdata.sources.scratch import materialize, release

from .models import joined_scores

#: Pairs of a cell, and bytes of the factors of a block, that a task should hold at most.
CELL, BYTES = 1 << 18, 1 << 27


@dataclass
class Factors:
    """A fitted model: (user_id, vec, bias), (item_id, vec, bias), and the log loss on validation pairs after each round."""

    users: DataFrame
    items: DataFrame
    losses: list[float]


def descend(users: np.ndarray, items: np.ndarray, user_bias: np.ndarray, item_bias: np.ndarray, u: np.ndarray, i: np.ndarray, y: np.ndarray, rate: float, reg: float, batch: int, use: tuple[bool, bool]) -> None:
    """One pass over some pairs (numbers of user and item, label) in their order, in place: each batch steps against the gradient of its log loss."""
    for first in range(0, len(y), batch):
        a, b = u[first : first + batch], i[first : first + batch]
        va, vb = users[a], items[b]
        off = 1 / (1 + np.exp(-((va * vb).sum(axis=1) + user_bias[a] + item_bias[b]))) - y[first : first + batch]
        np.add.at(users, a, -rate * (off[:, None] * vb + reg * va))
        np.add.at(items, b, -rate * (off[:, None] * va + reg * vb))
        if use[0]:
            np.add.at(user_bias, a, -rate * off)
        if use[1]:
            np.add.at(item_bias, b, -rate * off)


def initial(ids: DataFrame, kind: int, rank: int, seed: int, blocks: int) -> DataFrame:
    """(kind, id, block, vec, bias) for distinct ids: vectors drawn by hash, within 1 / sqrt(rank) of zero; biases zero."""
    draw = lambda j: F.xxhash64(F.lit(kind), F.lit(seed), "id", j).cast("double") / F.lit(2.0**63) / F.lit(rank**0.5)
    vec = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), draw)
    return ids.select(F.lit(kind).alias("kind"), "id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), vec.alias("vec"), F.lit(0.0).alias("bias"))


def log_loss(pairs: DataFrame, users: DataFrame, items: DataFrame) -> float:
    """Mean log loss over pairs (user_id, item_id, label) whose user and item are known."""
    scores = joined_scores(pairs.select("user_id", "item_id", "label"), users, items)
    p = F.least(F.greatest(sigmoid(F.col("score")), F.lit(1e-12)), F.lit(1 - 1e-12))
    return scores.agg(F.avg(-F.when(F.col("label") >= 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def fit_factors(
    pairs: DataFrame, rank: int = 100, rounds: int = 10, rate: float = 0.05, reg: float = 0.0, user_bias: bool = False, item_bias: bool = False, validation: DataFrame | None = None, patience: int | None = None, blocks: int | None = None, batch: int = 64, seed: int = 42
) -> Factors:
    """Fits users' and items' vectors to labelled pairs (user_id, item_id, label 0 or 1); a pair's chance is the sigmoid of the inner product plus biases.

    Ids are integers. The order of the pairs is drawn by hash anew in each round,
    so the result depends on `blocks` alone. With `validation` pairs the factors
    of the round with the smallest log loss on them are kept, and with
    `patience` fitting ends after so many rounds without a smaller one.
    """
    n = pairs.agg(F.count("*").alias("pairs"), F.approx_count_distinct("user_id").alias("users"), F.approx_count_distinct("item_id").alias("items")).first()
    fitting = max((n["pairs"] / CELL) ** 0.5, max(n["users"], n["items"]) * rank * 8 / BYTES, 4)
    d = blocks or int(np.ceil(fitting))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(d)).cast("int")
    cells = pairs.select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id"), F.col("label").cast("double").alias("label")).where("user_id IS NOT NULL AND item_id IS NOT NULL")
    cells = cells.withColumns({"key": block("user_id"), "stratum": F.pmod(block("item_id") - block("user_id"), F.lit(d))})
    # sorted by stratum, so that a stratum's scan skips the row groups of all others
    cells = materialize(cells.repartitionByRange("stratum", "key").sortWithinPartitions("stratum", "key"), "cells")
    ids = {0: cells.select(F.col("user_id").alias("id")).distinct(), 1: cells.select(F.col("item_id").alias("id")).distinct()}
    factors = materialize(initial(ids[0], 0, rank, seed, d).unionByName(initial(ids[1], 1, rank, seed, d)), "factors")

    def step(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["kind", "id"], ignore_index=True)
        if not len(asked) or not len(held):
            return held[["kind", "id", "block", "vec", "bias"]]
        split = int((held["kind"] == 0).sum())
        vectors, biases, names = np.stack(held["vec"].to_list()), held["bias"].to_numpy(float).copy(), held["id"].to_numpy()
        asked = asked.sort_values(["draw", "user_id", "item_id", "label"])
        u, i = np.searchsorted(names[:split], asked["user_id"].to_numpy()), np.searchsorted(names[split:], asked["item_id"].to_numpy())
        descend(vectors[:split], vectors[split:], biases[:split], biases[split:], u, i, asked["label"].to_numpy(float), rate, reg, batch, (user_bias, item_bias))
        return held.assign(vec=list(vectors), bias=biases)[["kind", "id", "block", "vec", "bias"]]

    def sides(table: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(table.where(F.col("kind") == k).select(F.col("id").alias(name), "vec", "bias") for k, name in ((0, "user_id"), (1, "item_id")))

    best, losses = None, []
    for turn in range(rounds):
        for s in range(d):
            draw = F.xxhash64(F.lit(seed), F.lit(turn), "user_id", "item_id").alias("draw")
            asked = cells.where(F.col("stratum") == s).select("key", "user_id", "item_id", "label", draw)
            held = factors.withColumn("key", F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - F.lit(s), F.lit(d))))
            after = materialize(asked.groupBy("key").cogroup(held.groupBy("key")).applyInPandas(step, "kind int, id long, block int, vec array<double>, bias double"), "factors")
            if factors is not best:
                release(factors)
            factors = after
        if validation is not None:
            losses.append(log_loss(validation, *sides(factors)))
            if losses[-1] == min(losses):
                if best is not None:
                    release(best)
                best = factors
            if patience is not None and len(losses) - 1 - int(np.argmin(losses)) >= patience:
                break
    release(cells)
    users, items = sides(best if best is not None else factors)
    return Factors(users, items, losses)


def predict_pairs(model: Factors, cand: DataFrame) -> DataFrame:
    """(user_id, item_id, score): the chance of each pair whose user and item were fitted."""
    return joined_scores(cand.select("user_id", "item_id"), model.users, model.items).withColumn("score", sigmoid(F.col("score"))).select("user_id", "item_id", "score")
