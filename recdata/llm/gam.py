"""Text quality by a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees are boosted cyclically,
one feature after the other, each round with a small step, and all trees of a
feature add up to one lookup table over its bins; pairs of features that say
most about what is left get tables of their own in the same way (Lou et al.,
"Accurate Intelligible Models with Pairwise Interactions", 2013). A score is a
sum of table entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, kind_of, map_rows

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "exclaim", "separator", "comma", "stop", "distinct", "repeat_lines", "log_line", "end_marks", "repeat_windows", "doubled")
_find = re.compile(WORD).findall
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def text_features(text: str) -> list[float]:
    """Numbers that describe the form of a text, none of its language or subject."""
    words = _find(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars = max(1, raw.sum() - raw[9:14].sum() - raw[32])
    share = lambda symbols: sum(int(raw[ord(c)]) for c in symbols) / chars
    lines = [line for line in text.split("\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    return [
        float(np.log1p(n)),
        chars / n,
        len(_UPPER.findall(text)) / chars,
        raw[48:58].sum() / chars,
        share("#*$%&<>~^=_+@"),
        share("!?"),
        share("|/\\"),
        share(",;:"),
        share("."),
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        sum(line.rstrip()[-1] in ".!?:" for line in lines) / max(1, len(lines)),
        1 - len(set(windows)) / max(1, len(windows)),
        (text.count("!!") + text.count("$$") + text.count("##") + text.count("%%") + text.count("**") + text.count("&&")) / n,
    ]


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of every whole text; a null text counts as empty. Nothing is shuffled."""

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        for keys, texts in batches:
            yield {id_col: keys, "features": [text_features(t or "") for t in texts]}

    return map_rows(df, [id_col, text_col], rows, {id_col: kind_of(df, id_col), "features": "array<double>"})


@dataclass
class Gam:
    """edges: inner bin bounds of each feature; tables: a value for each bin; pairs: features and a value for each pair of coarse bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        bins = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for pair in self.pairs for k in pair[:2]}
        for i, j, table in self.pairs:
            total += table[bins[i], bins[j]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _step(gradient: np.ndarray, hessian: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: the best splits one at a time; a Newton step for each leaf."""
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(hessian))
    bounds = [0, len(gradient)]
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = (g[cut] - g[a]) ** 2 / (h[cut] - h[a] + 1.0) + (g[b] - g[cut]) ** 2 / (h[b] - h[cut] + 1.0) - value(a, b)
                gain[(h[cut] - h[a] < least) | (h[b] - h[cut] < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), int(cut[gain.argmax()]))
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_step(gradient: np.ndarray, hessian: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """A tree of one split on each axis: the best of all four-leaf tables, and how much it gains."""
    g = np.pad(gradient, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    h = np.pad(hessian, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    a, b = np.arange(1, len(gradient))[:, None], np.arange(1, gradient.shape[1])[None, :]
    if not a.size or not b.size:
        return np.zeros_like(gradient), 0.0
    quarter = lambda t: (t[a, b], t[a, -1] - t[a, b], t[-1, b] - t[a, b], t[-1, -1] - t[a, -1] - t[-1, b] + t[a, b])
    gs, hs = quarter(g), quarter(h)
    gain = sum(x**2 / (y + 1.0) for x, y in zip(gs, hs, strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + 1.0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [x[i, j] / (y[i, j] + 1.0) if y[i, j] >= least else 0.0 for x, y in zip(gs, hs, strict=True)]
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, leaves: int = 4, least: float = 1.0) -> Gam:
    """Fits the tables. Without both labels the score is the share of label 1, or 1/2 without rows."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    cut = lambda k, n: np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) if len(x) else np.zeros(0)
    n_features = x.shape[1]
    edges, coarse = [cut(k, bins) for k in range(n_features)], [cut(k, coarse_bins) for k in range(n_features)]
    model = Gam(base, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if not 0 < y.sum() < len(y):
        return model
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    logit = np.full(len(y), base)
    for _ in range(rounds):
        for k in range(n_features):
            p = 1 / (1 + np.exp(-logit))
            size = len(edges[k]) + 1
            step = rate * _step(np.bincount(at[k], y - p, size), np.bincount(at[k], p * (1 - p), size), leaves, least)
            model.tables[k] += step
            logit += step[at[k]]
    p = 1 / (1 + np.exp(-logit))
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def sums(i: int, j: int, values: np.ndarray) -> np.ndarray:
        wide = len(coarse[j]) + 1
        return np.bincount(rough[i] * wide + rough[j], values, (len(coarse[i]) + 1) * wide).reshape(-1, wide)

    gains = sorted(((_pair_step(sums(i, j, y - p), sums(i, j, p * (1 - p)), least)[1], i, j) for i in range(n_features) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-logit))
            step = rate * _pair_step(sums(i, j, y - p), sums(i, j, p * (1 - p)), least)[0]
            table += step
            logit += step[rough[i], rough[j]]
    return model


def train(df: DataFrame, labels: DataFrame, training: Column, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fits a model on labelled rows of `df`: those of the `most` labelled ids with the least md5.

    `labels` has the id and the label (0 or 1), and `training` is an expression
    of the id. Null labels and ids are not used; of several labels of one id
    the least counts. Only the features of the sample reach the driver; of
    rows that repeat an id, `most` in all.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(training, F.lit(False)))
    wanted = known.groupBy(id_col).agg(F.min(label_col).alias("y")).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(most)
    found = df.select(id_col, text_col).join(F.broadcast(wanted.select(id_col)), id_col, "left_semi")
    sample = extract(found, id_col, text_col).join(F.broadcast(wanted), id_col)
    sample = sample.orderBy(F.md5(F.col(id_col).cast("string")), id_col, "features").limit(most).select("features", "y").toPandas()
    x = np.array(sample["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, sample["y"].to_numpy(float))


def score(df: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: label 1 is likelier) and predicted (1 from 0.5 on) of every whole text.

    Null texts count as empty and get the score of an empty text. Existing
    columns of those names are replaced, all others stay. Nothing is shuffled.
    """

    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t or "") for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.scores(x))

    return df.withColumn("score", apply(text_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(df: DataFrame, labels: DataFrame, training: Column, most: int = 20_000) -> DataFrame:
    """`df` (doc_id, text) with score and predicted, learned from its labelled rows where `training` holds.

    Only the text makes the features. Repeated rows come back as often as they
    came, and an empty table gives an empty result.
    """
    return score(df, train(df, labels, training, most))
