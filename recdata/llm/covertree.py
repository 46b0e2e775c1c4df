"""Cover trees over vectors, and a dual-tree search for the largest inner products."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Covering radii of neighbouring levels are powers of this.
BASE = 1.3
#: A level with more nodes than one for so many vectors is not worth having: its parents are leaves.
LEAF = 8


@dataclass
class Tree:
    """A cover tree (Beygelzimer, Kakade and Langford, 2006) over the rows of `x`, which stand in its order; `order` tells where they were.

    Level l has the vectors rows[l], each of which also is a node of every
    deeper level; any two are farther apart than reach[l], and every vector of
    the next level has one parent among them, at most reach[l] away. starts[l]
    bounds the rows below each node, radii[l] is the distance of the farthest of
    them, and norms[l] the largest of their lengths.
    """

    ids: np.ndarray
    x: np.ndarray
    order: np.ndarray
    rows: list[np.ndarray]
    starts: list[np.ndarray]
    radii: list[np.ndarray]
    norms: list[np.ndarray]
    reach: list[float]

    def children(self, level: int, node: int) -> np.ndarray:
        low, high = np.searchsorted(self.starts[level + 1], self.starts[level][node : node + 2])
        return np.arange(low, high)


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(1))


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of `most` vectors or fewer, each the farthest from those before; none repeats another."""
    chosen = [int(np.argmax((x * x).sum(1)))] if len(x) else []
    distance = _distances(x, x[chosen[0]]) if chosen else np.zeros(0)
    while chosen and len(chosen) < most and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        np.minimum(distance, _distances(x, x[chosen[-1]]), out=distance)
    return np.array(chosen, int)


def cover_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of some vectors. Vectors join a level farthest first, until all lie within its reach; so levels are nested and separated."""
    chosen = [int(np.argmax((x * x).sum(1)))]
    distance, near = _distances(x, x[chosen[0]]), np.zeros(len(x), int)
    farthest = max(distance.max(), 1e-300)
    power = int(np.ceil(np.log(farthest) / np.log(BASE)))
    sizes, parents, reach = [1], [np.zeros(1, int)], [BASE**power]
    while distance.max() > 0:
        power -= 1
        above, known, last = near.copy(), len(chosen), (distance.copy(), near.copy())
        while distance.max() > BASE**power and len(chosen) <= len(x) // leaf:
            chosen.append(int(distance.argmax()))
            d = _distances(x, x[chosen[-1]])
            near[d < distance] = len(chosen) - 1
            np.minimum(distance, d, out=distance)
        if distance.max() > BASE**power:  # too many nodes: the level before is the last
            del chosen[known:]
            distance, near = last
            break
        if len(chosen) > known:
            sizes.append(len(chosen))
            parents.append(np.concatenate([np.arange(known), above[chosen[known:]]]))
            reach.append(BASE**power)
    path = [near]
    for parent in reversed(parents[1:]):
        path.append(parent[path[-1]])
    path.reverse()
    order = np.lexsort(path[::-1])
    rows, starts, radii, norms = [], [], [], []
    lengths = np.sqrt((x[order] ** 2).sum(1))
    for at in path:
        nodes = at[order]
        first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        centres = np.array(chosen)[nodes[first]]
        far = np.sqrt(((x[order] - np.repeat(x[centres], np.diff(np.append(first, len(x))), axis=0)) ** 2).sum(1))
        place = np.empty(len(x), int)
        place[order] = np.arange(len(x))
        rows.append(place[centres])
        starts.append(np.append(first, len(x)))
        radii.append(np.maximum.reduceat(far, first) * (1 + 1e-9) + 1e-9)
        norms.append(np.maximum.reduceat(lengths, first))
    return Tree(ids[order], x[order], order, rows, starts, radii, norms, reach)


def bounds(cq: np.ndarray, rq: np.ndarray, cd: np.ndarray, rd: np.ndarray) -> np.ndarray:
    """What no inner product between vectors of the query nodes and of the data nodes exceeds (Curtin and Ram, 2014)."""
    nq, nd = np.sqrt((cq * cq).sum(1)), np.sqrt((cd * cd).sum(1))
    most = cq @ cd.T + np.outer(rq, nd) + np.outer(nq, rd) + np.outer(rq, rd)
    return most + 1e-9 * (1 + np.outer(nq + rq, nd + rd))


def closer_bounds(cq: np.ndarray, rq: np.ndarray, mq: np.ndarray, cd: np.ndarray, rd: np.ndarray, md: np.ndarray) -> np.ndarray:
    """The same, or less where the largest lengths say more: twice an inner product is the squares of both lengths less that of the distance."""
    apart = (cq * cq).sum(1)[:, None] + (cd * cd).sum(1)[None, :] - 2 * (cq @ cd.T)
    gap = np.maximum(0, np.sqrt(np.maximum(apart, 0)) - rq[:, None] - rd[None, :])
    squares = (mq**2)[:, None] + (md**2)[None, :]
    return np.minimum(bounds(cq, rq, cd, rd), (squares - gap**2) / 2 + 1e-9 * (1 + squares))


class Search:
    """The k best of each query so far; data trees are searched one after the other, each with what is known from those before."""

    def __init__(self, queries: Tree, k: int, least: np.ndarray) -> None:
        """`least`: a score that the k-th best of each query is not below."""
        n = len(queries.x)
        self.queries, self.k, self.worst = queries, k, least.astype(float).copy()
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.visited = self.pruned = self.scored = 0

    def run(self, data: Tree) -> None:
        """Descends both trees from their roots, the pair with the largest bound first; a pair goes if its bound is below the worst k-th score of its queries."""
        q, tick = self.queries, 0
        cut = lambda tree, level, nodes: (tree.x[tree.rows[level][nodes]], tree.radii[level][nodes], tree.norms[level][nodes])
        heap = [(-float(closer_bounds(*cut(q, 0, [0]), *cut(data, 0, [0]))[0, 0]), 0, 0, 0, 0, 0)]
        while heap:
            most, _, ql, qn, dl, dn = heapq.heappop(heap)
            self.visited += 1
            if -most < self._worst(ql, qn):
                self.pruned += 1
                continue
            q_leaf, d_leaf = ql + 1 == len(q.rows), dl + 1 == len(data.rows)
            if q_leaf and d_leaf:
                self._score(data, qn, dn)
                continue
            if d_leaf or (not q_leaf and q.radii[ql][qn] > data.radii[dl][dn]):
                ql, q_nodes, d_nodes = ql + 1, q.children(ql, qn).tolist(), [dn]
            else:
                dl, q_nodes, d_nodes = dl + 1, [qn], data.children(dl, dn).tolist()
            below = closer_bounds(*cut(q, ql, q_nodes), *cut(data, dl, d_nodes))
            for i, a in enumerate(q_nodes):
                good = below[i] >= self._worst(ql, a)
                self.visited += int((~good).sum())
                self.pruned += int((~good).sum())
                for j in np.flatnonzero(good).tolist():
                    tick += 1
                    heapq.heappush(heap, (-float(below[i, j]), tick, ql, a, dl, d_nodes[j]))

    def _worst(self, level: int, node: int) -> float:
        starts = self.queries.starts[level]
        return self.worst[starts[node] : starts[node + 1]].min()

    def _score(self, data: Tree, qn: int, dn: int) -> None:
        """Compares all queries of a node with all vectors of another; those with the query's own id do not count, and each id counts once."""
        q = self.queries
        first, end = q.starts[-1][qn : qn + 2]
        low, high = data.starts[-1][dn : dn + 2]
        for at in range(first, end, 256):
            some = slice(at, min(at + 256, end))
            scores = q.x[some] @ data.x[low:high].T
            self.scored += scores.size
            scores[q.ids[some][:, None] == data.ids[low:high][None, :]] = -np.inf
            who, what = np.nonzero(scores >= np.maximum(self.worst[some], -1e300)[:, None])
            if not len(who):
                continue
            touched = np.unique(who)
            owner = np.concatenate([who, np.repeat(touched, self.k)])
            ids = np.concatenate([data.ids[low:high][what], self.ids[some][touched].ravel()])
            values = np.concatenate([scores[who, what], self.scores[some][touched].ravel()])
            order = np.lexsort((-values, ids, owner))
            owner, ids, values = owner[order], ids[order], values[order]
            once = np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]) | (ids[1:] == np.iinfo(np.int64).max))
            owner, ids, values = owner[once], ids[once], values[once]
            order = np.lexsort((ids, -values, owner))
            owner, ids, values = owner[order], ids[order], values[order]
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            pick = begins[:, None] + np.arange(self.k)
            self.scores[touched + at], self.ids[touched + at] = values[pick], ids[pick]
            self.worst[touched + at] = np.maximum(self.worst[touched + at], values[pick[:, -1]])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, vector ids, scores) of what may be among the k best."""
        keep = np.isfinite(self.scores)
        return np.broadcast_to(self.queries.ids[:, None], keep.shape)[keep], self.ids[keep], np.rint(self.scores[keep]).astype(np.int64)
