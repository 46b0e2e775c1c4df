"""A factorisation machine and a perceptron on pairs of vectors, learned and scored without features for each pair.

The methods are those of Spark ML's FMClassifier (AdamW) and
MultilayerPerceptronClassifier (L-BFGS), from whose weights they start. A
pair's features would be its user's and its item's vector put together, a
kilobyte a pair, which Spark ML keeps as well. Here pairs are two numbers and a
label, stored once by blocks of distinct vectors; for each step they meet their
blocks, and only sums of gradients, as long as the weights, leave the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recdata.sources.scratch import materialize

from .models import CHUNK, dealt_pairs, met_pairs, vectors_of

#: Pairs in a stored row.
PACK = 1024


@dataclass
class Learned:
    """Weights, and the raw score of pairs that follows from them: (user vectors, item vectors, rows of the pairs in them, weights) to scores."""

    weights: np.ndarray
    raw: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    def predict(self, cand: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame) -> DataFrame:
        """(user_id, item_id, score): the probability of label 1; null where a vector is null or holds a null."""
        raw, weights = self.raw, self.weights

        def tell(a: np.ndarray, b: np.ndarray, u: np.ndarray, i: np.ndarray, known: np.ndarray) -> dict[str, pa.Array]:
            parts = [raw(a, b, u[s : s + CHUNK], i[s : s + CHUNK], weights) for s in range(0, len(u), CHUNK)]
            with np.errstate(over="ignore"):
                return {"score": pa.array(1 / (1 + np.exp(-np.concatenate(parts))) if parts else [], pa.float64(), mask=~known)}

        return met_pairs(cand.select("user_id", "item_id"), user_vectors, item_vectors, tell, {"score": "double"})


def gradients(pairs: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, gradient: Callable[..., tuple[float, np.ndarray]]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """A function from weights to the mean loss over `pairs` (user_id, item_id, label) and its gradient; the pairs are stored once."""
    asked, held, cell = dealt_pairs(pairs.select("user_id", "item_id", F.col("label").cast("double").alias("label")), user_vectors, item_vectors)
    chunk = F.pmod(F.xxhash64("item_id", "user_id"), F.ceil(F.col("pairs") / PACK))
    rows = F.collect_list(F.struct(F.col("__u").cast("int").alias("u"), F.col("__i").cast("int").alias("i"), F.col("label").cast("float").alias("y")))
    lists = asked.where("__u >= 0 AND __i >= 0").groupBy(*cell, chunk.alias("chunk")).agg(rows.alias("x"))
    field = lambda f: F.transform("x", lambda x: x[f]).alias(f)
    packed = materialize(lists.select(*cell, field("u"), field("i"), field("y")), "pairs")

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def work(some: pa.Table, held: pa.Table) -> pa.Table:
            u, i, y = (some[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("u", "i", "y"))
            (a, _, u), (b, _, i) = vectors_of(held, 0, u), vectors_of(held, 1, i)
            loss, total = 0.0, np.zeros(len(weights))
            for first in range(0, len(u), CHUNK):
                s = slice(first, first + CHUNK)
                more, change = gradient(a, b, u[s], i[s], y[s].astype(float), weights)
                loss, total = loss + more, total + change
            return pa.table({"loss": pa.array([loss], pa.float64()), "n": pa.array([len(u)], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

        found = packed.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(work, "loss double, n long, total binary")
        loss, n, total = 0.0, 0, np.zeros(len(weights))
        for row in found.collect():  # as long as the weights, one for each PAIRS pairs or more
            loss, n, total = loss + row["loss"], n + row["n"], total + np.frombuffer(row["total"])
        return loss / max(n, 1), total / max(n, 1)

    return at


def _two_rows(pairs: DataFrame, width: int) -> DataFrame:
    """Made rows, from which Spark ML tells the weights that it starts from."""
    return pairs.sparkSession.createDataFrame([(Vectors.dense([float(k)] * width), float(k)) for k in (0, 1)], ["features", "label"])


def _width(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vec"))).first()[0] or 0


def _fm_parts(weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(factors, linear weights, intercept)."""
    k = (len(weights) - 1) // width - 1
    return weights[: k * width].reshape(width, k), weights[k * width : -1], weights[-1]


def _fm_raw(a: np.ndarray, b: np.ndarray, u: np.ndarray, i: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v, w, c = _fm_parts(weights, a.shape[1] + b.shape[1])
    n, squares = a.shape[1], (v * v).sum(axis=1)
    one, two = ((x @ f, x @ l - (x * x) @ q / 2) for x, f, l, q in ((a, v[:n], w[:n], squares[:n]), (b, v[n:], w[n:], squares[n:])))
    return c + one[1][u] + two[1][i] + ((one[0][u] + two[0][i]) ** 2).sum(axis=1) / 2


def _fm_gradient(a: np.ndarray, b: np.ndarray, u: np.ndarray, i: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    v, _, _ = _fm_parts(weights, a.shape[1] + b.shape[1])
    n, raw = a.shape[1], _fm_raw(a, b, u, i, weights)
    off = 1 / (1 + np.exp(-raw)) - y
    both = (a @ v[:n])[u] + (b @ v[n:])[i]
    out = []
    for x, at, f in ((a, u, v[:n]), (b, i, v[n:])):
        m = np.bincount(at, off, len(x))
        s = np.stack([np.bincount(at, off * both[:, k], len(x)) for k in range(v.shape[1])], axis=1)
        out.append((x.T @ s - ((x * x).T @ m)[:, None] * f, x.T @ m))
    loss = np.logaddexp(0, np.where(y > 0, -raw, raw)).sum()
    return loss, np.concatenate([np.concatenate([g for g, _ in out]).ravel(), *(m for _, m in out), [off.sum()]])


def fit_fm(pairs: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, factors: int = 8, iterations: int = 20, seed: int = 42, rate: float = 0.05) -> Learned:
    """A factorisation machine on log loss by AdamW, as `models.fit_fm` on `models.pair_features`."""
    width = _width(user_vectors) + _width(item_vectors)
    start = FMClassifier(factorSize=factors, maxIter=0, seed=seed).fit(_two_rows(pairs, width))
    w = np.concatenate([start.factors.toArray().ravel(), start.linear.toArray(), [start.intercept]])
    at, m, s = gradients(pairs, user_vectors, item_vectors, _fm_gradient), np.zeros(len(w)), np.zeros(len(w))
    for turn in range(1, iterations + 1):
        _, g = at(w)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        after = w - rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)
        done = np.linalg.norm(after - w) < 1e-6 * max(np.linalg.norm(after), 1)
        w = after
        if done:
            break
    return Learned(w, _fm_raw)


def _mlp_parts(weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrices and offsets of both layers, inputs by outputs."""
    h = (len(weights) - 2) // (width + 3)
    cut = width * h
    return weights[:cut].reshape(width, h), weights[cut : cut + h], weights[cut + h : cut + 3 * h].reshape(h, 2), weights[cut + 3 * h :]


def _hidden(a: np.ndarray, b: np.ndarray, u: np.ndarray, i: np.ndarray, first: np.ndarray, offset: np.ndarray) -> np.ndarray:
    n = a.shape[1]
    return 1 / (1 + np.exp(-((a @ first[:n])[u] + (b @ first[n:])[i] + offset)))


def _mlp_raw(a: np.ndarray, b: np.ndarray, u: np.ndarray, i: np.ndarray, weights: np.ndarray) -> np.ndarray:
    first, offset, second, last = _mlp_parts(weights, a.shape[1] + b.shape[1])
    z = _hidden(a, b, u, i, first, offset) @ second + last
    return z[:, 1] - z[:, 0]


def _mlp_gradient(a: np.ndarray, b: np.ndarray, u: np.ndarray, i: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    first, offset, second, last = _mlp_parts(weights, a.shape[1] + b.shape[1])
    h = _hidden(a, b, u, i, first, offset)
    z = h @ second + last
    raw = z[:, 1] - z[:, 0]
    off = 1 / (1 + np.exp(-raw)) - y
    delta = np.stack([-off, off], axis=1)
    back = (delta @ second.T) * h * (1 - h)
    sums = [x.T @ np.stack([np.bincount(at, back[:, k], len(x)) for k in range(h.shape[1])], axis=1) for x, at in ((a, u), (b, i))]
    loss = np.logaddexp(0, np.where(y > 0, -raw, raw)).sum()
    return loss, np.concatenate([np.concatenate(sums).ravel(), back.sum(axis=0), (h.T @ delta).ravel(), delta.sum(axis=0)])


def fit_mlp(pairs: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, hidden: int = 32, iterations: int = 30, seed: int = 42) -> Learned:
    """A perceptron with one hidden layer, by L-BFGS, as `models.fit_mlp` on `models.pair_features`."""
    width = _width(user_vectors) + _width(item_vectors)
    start = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=0, seed=seed).fit(_two_rows(pairs, width))
    at = gradients(pairs, user_vectors, item_vectors, _mlp_gradient)
    return Learned(smallest_loss(at, np.array(start.weights.toArray()), iterations), _mlp_raw)


def smallest_loss(at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, iterations: int, kept: int = 10, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS (Nocedal and Wright, 2006): directions from the last `kept` changes, steps that meet the strong Wolfe conditions."""
    loss, g = at(w)
    changes: list[tuple[np.ndarray, np.ndarray]] = []
    for turn in range(iterations):
        if np.linalg.norm(g) <= tol * max(1.0, abs(loss)):
            break
        q, told = g.copy(), []
        for s, d in reversed(changes):
            told.append(s @ q / (s @ d))
            q -= told[-1] * d
        if changes:
            q *= changes[-1][0] @ changes[-1][1] / (changes[-1][1] @ changes[-1][1])
        for (s, d), x in zip(changes, reversed(told), strict=True):
            q += (x - d @ q / (s @ d)) * s
        found = _step(at, w, -q, loss, g, 1.0 if turn else 1 / np.linalg.norm(q))
        if found is None:
            break
        after, lower, g_after = found
        changes = [*changes, (after - w, g_after - g)][-kept:]
        done = abs(loss - lower) <= tol * max(abs(loss), abs(lower), 1e-6)
        w, loss, g = after, lower, g_after
        if done:
            break
    return w


def _step(at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, way: np.ndarray, loss: float, g: np.ndarray, size: float) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(weights, loss, gradient) after a step along `way` that meets the strong Wolfe conditions; None if none is found."""
    slope = g @ way
    low, high, best = (0.0, loss, slope), None, None
    for _ in range(20):
        x = w + size * way
        value, change = at(x)
        here = (size, value, change @ way)
        if not np.isfinite(value) or value > loss + 1e-4 * size * slope or value >= low[1]:
            high = here
        else:
            best = (x, value, change)
            if abs(here[2]) <= -0.9 * slope:
                return best
            if high is not None and here[2] * (high[0] - low[0]) >= 0 or high is None and here[2] >= 0:
                high = low
            low = here
        if high is None:
            size *= 1.5
            continue
        # the smallest of the cubic through both ends, well inside
        (p, fp, dp), (r, fr, dr) = low, high
        d = dp + dr - 3 * (fp - fr) / (p - r)
        root = d * d - dp * dr
        size = r - (r - p) * (dr + np.sqrt(root) - d) / (dr - dp + 2 * np.sqrt(root)) if np.isfinite(root) and root > 0 else (p + r) / 2
        if not np.isfinite(size) or not min(p, r) + 0.1 * abs(r - p) <= size <= max(p, r) - 0.1 * abs(r - p):
            size = (p + r) / 2
    return best
