"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the
preceding bytes (Willems, Shtarkov and Tjalkens, 1995; byte decomposition as in
Volf's thesis). Every node holds a Krichevsky-Trofimov estimate; a node's
weighted probability mixes its own estimate with the product of its children.
Trained once, the mixture at a context is the sum over depths of the estimate
at that depth times the posterior weight that the tree ends there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices

#: Stands before and after a text; no UTF-8 text holds this byte.
MARK = 0xFF
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_bytes(text: str) -> bytes:
    """The UTF-8 of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def byte_grams(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end mark: the byte after its `depth` predecessors, 4 at most, as one number.

    Returns the numbers, the latest byte lowest, and how many each text has.
    """
    raw = [lower_bytes(t) for t in texts]
    pad = bytes([MARK]) * depth
    joined = np.frombuffer(b"".join(pad + r + b"\xff" for r in raw), np.uint8)
    counts = np.array([len(r) + 1 for r in raw], np.int64)
    grams = np.zeros(max(0, len(joined) - depth), np.uint64)
    for k in range(depth + 1):
        grams = (grams << np.uint64(8)) | joined[k : len(joined) - depth + k]
    keep = np.ones(len(grams), bool)
    ends = np.cumsum(counts + depth)[:-1]  # where the pads of the later texts begin
    for k in range(1, depth + 1):
        keep[ends - k] = False
    return grams[keep], counts


def gram_counts(df: DataFrame, depth: int, text_col: str = "text", learn_col: str | None = None) -> DataFrame:
    """(gram long, n long, seen long): how often each byte with its `depth` predecessors occurs in the texts to learn from, and in all.

    Without `learn_col` all texts are learned from. Grams of other texts alone have n = 0.
    """

    def totals(held: list[tuple]) -> tuple:
        """Sorted grams, each once, with the sums of their counts."""
        grams, n, seen = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        return grams[first], np.add.reduceat(n[order], first), np.add.reduceat(seen[order], first)

    def columns(total: tuple) -> dict:
        return {"gram": total[0].view(np.int64), "n": total[1], "seen": total[2]}

    def rows(batches: Iterator[tuple]) -> Iterator[dict]:
        held, size = [], 0
        for texts, *learn in batches:
            texts = [t or "" for t in texts]
            weights = np.array(learn[0], bool) if learn else np.ones(len(texts), bool)
            for part in slices(texts, 1 << 21):
                grams, n_bytes = byte_grams(texts[part], depth)
                marked = np.sort((grams << np.uint64(1)) | np.repeat(weights[part], n_bytes))
                first = np.flatnonzero(np.append(True, marked[1:] != marked[:-1]))
                seen = np.diff(np.append(first, len(marked)))
                held.append((marked[first] >> np.uint64(1), np.where(marked[first] & np.uint64(1), seen, 0), seen))
                size += len(seen)
                if size > 1 << 21:
                    held = [totals(held)]
                    if len(held[0][0]) > 1 << 20:
                        yield columns(held[0])
                        held = []
                    size = sum(len(x[0]) for x in held)
        if held:
            yield columns(totals(held))

    found = map_rows(df, [text_col, learn_col] if learn_col else [text_col], rows, {"gram": "long", "n": "long", "seen": "long"})
    return found.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


_SMALL = 1 << 12
_LOG_GAMMA = {half: np.array([lgamma(k + half) for k in range(_SMALL)]) for half in (0.5, 1.0)}


def _log_gamma(counts: np.ndarray, half: float) -> np.ndarray:
    """log gamma of counts + half; from a table where the counts are small."""
    small = counts < _SMALL
    out = np.empty(len(counts))
    out[small] = _LOG_GAMMA[half][counts[small].astype(np.int64)]
    out[~small] = [lgamma(c + half) for c in counts[~small].tolist()]
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - 2 * lgamma(0.5)


def _nodes(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of one depth, sorted: key (context bytes, decisions so far) and how often 0 and 1 were decided there."""
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    symbol, context = grams & np.uint64(0xFF), grams >> np.uint64(8)
    found = []
    for bit in range(8):  # in the order of grams, equal keys of one bit are neighbours
        key = (context << np.uint64(8)) | (np.uint64(1) << np.uint64(bit)) | (symbol >> np.uint64(8 - bit))
        one = np.where(symbol >> np.uint64(7 - bit) & np.uint64(1), counts, 0)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x, first) if len(first) else x for x in (one, counts)]
        found.append((key[first], *sums))
    key, one, total = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(key)
    return key[order], (total - one)[order].astype(np.float64), one[order].astype(np.float64)


#: Depths up to this one are weighed on the driver: 2^24 nodes at most, however much text there is.
TOP = 2


def _shorter(keys: np.ndarray, d: int) -> np.ndarray:
    """The keys of the nodes at depth d under which these stand."""
    context, before = keys >> np.uint64(8), keys & np.uint64(0xFF)
    return ((context & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | before


@dataclass
class Level:
    """The nodes of one depth: counts, own estimate and weighted probability (natural logarithms)."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray
    weighted: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Level:
        """`below`: the product of the children's weighted probabilities; None at full depth."""
        own = _log_kt(zeros, ones)
        return cls(keys, zeros, ones, own, own if below is None else np.logaddexp(own, below) + np.log(0.5))

    def above(self, d: int) -> tuple[np.ndarray, ...]:
        """Keys at depth d, and what the nodes here give to each: zeros, ones, product of the weighted probabilities."""
        parents, at = np.unique(_shorter(self.keys, d), return_inverse=True)
        return parents, *(np.bincount(at, x, len(parents)) for x in (self.zeros, self.ones, self.weighted))


@dataclass
class State:
    """What a longer context has to know of the nodes of one depth: the mixture so far, the weight left, the probability of 1 if no longer context was seen."""

    keys: np.ndarray
    chance: np.ndarray
    left: np.ndarray
    ends: np.ndarray


def _descend(level: Level, d: int, last: bool, above: State | None) -> State:
    """The state of the nodes at depth d, from that of the depth before."""
    n = len(level.keys)
    if above is None:
        chance, left, ends = np.zeros(n), np.ones(n), np.full(n, 0.5)
    else:
        at = np.searchsorted(above.keys, _shorter(level.keys, d - 1))
        chance, left, ends = above.chance[at], above.left[at], above.ends[at]
    stop = np.ones(n) if last else np.minimum(1.0, 0.5 * np.exp(level.own - level.weighted))
    total = level.zeros + level.ones
    p = (level.ones + 0.5) / (total + 1)
    chance = chance + left * stop * p
    left = left * (1 - stop)
    # a context that training has not seen predicts as the deepest one seen
    return State(level.keys, chance, left, np.where(total > 0, chance + left * p, ends))


def _subtree(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """The levels from `depth` up to top + 1, deepest first; all grams of a context of top + 1 bytes are here or none is."""
    levels: list[Level] = []
    for d in range(depth, top, -1):
        if levels:
            levels.append(Level.of(*levels[-1].above(d)))
        else:
            levels.append(Level.of(*_nodes(grams, counts), None))
    return levels


def gram_bits(grams: DataFrame, depth: int, size: int = 1 << 17) -> DataFrame:
    """(gram, seen, bits): the code length of each gram of `gram_counts` under the tree of all of them.

    Nothing is left out. All grams that share a context of TOP + 1 bytes, which
    number 65,536 at most for depth 4, go to one task; of about `size` grams it
    takes the depths beyond TOP together, once from the longest context up and
    once down again. In between the driver weighs the depths up to TOP. Grams
    with n = 0 have nodes that weigh nothing and predict as the one above.
    """
    top = min(TOP, depth)
    context = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * (top + 1))) - 1).cast("long"))
    dealt = grams.repartition(max(1, -(-grams.count() // size)), context)

    def gather(batches: Iterator[tuple]) -> list[np.ndarray]:
        parts = [tuple(np.array(column, np.int64) for column in batch) for batch in batches]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def up(batches: Iterator[tuple]) -> Iterator[dict]:
        if found := gather(batches):
            given, n = found[0].view(np.uint64), found[1]
            if levels := _subtree(given, n, depth, top):
                keys, zeros, ones, below = levels[-1].above(top)
            else:
                keys, zeros, ones = _nodes(given, n)
                below = np.zeros(len(keys))
            yield {"key": keys.view(np.int64), "zeros": zeros, "ones": ones, "below": below}

    sums = map_rows(dealt, ["gram", "n"], up, {"key": "long", "zeros": "double", "ones": "double", "below": "double"})
    sums = sums.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).orderBy("key").toArrow()
    keys, zeros, ones, below = (sums[c].to_numpy() for c in ("key", "zeros", "ones", "below"))
    levels = [Level.of(keys.view(np.uint64), zeros, ones, below if top < depth else None)]
    for d in range(top - 1, -1, -1):
        levels.append(Level.of(*levels[-1].above(d)))
    state = None
    for d, level in enumerate(reversed(levels)):
        state = _descend(level, d, d == depth, state)
    sent = grams.sparkSession.sparkContext.broadcast(state)

    def down(batches: Iterator[tuple]) -> Iterator[dict]:
        if found := gather(batches):
            given, n, seen = found[0].view(np.uint64), found[1], found[2]
            state = sent.value
            for d, level in enumerate(reversed(_subtree(given, n, depth, top)), top + 1):
                state = _descend(level, d, d == depth, state)
            bits = np.zeros(len(given))
            symbol, contexts = given & np.uint64(0xFF), given >> np.uint64(8)
            for bit in range(8):
                key = (contexts << np.uint64(8)) | (np.uint64(1) << np.uint64(bit)) | (symbol >> np.uint64(8 - bit))
                p = state.ends[np.searchsorted(state.keys, key)]
                bits -= np.log2(np.where(symbol >> np.uint64(7 - bit) & np.uint64(1), p, 1 - p))
            yield {"gram": found[0], "seen": seen, "bits": bits}

    return map_rows(dealt, ["gram", "n", "seen"], down, {"gram": "long", "seen": "long", "bits": "double"})
