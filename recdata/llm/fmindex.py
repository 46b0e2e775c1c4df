"""A compressed FM-index over numbers: a wavelet matrix of the transformed sequence, a byte of LCP for each place, backward search."""

from __future__ import annotations

import numpy as np


_MASKS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Wavelet:
    """A wavelet matrix: one packed bit vector with running counts for each bit of a symbol."""

    def __init__(self, values: np.ndarray, n_symbols: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        current = values.astype(np.int32)
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            ones = (current >> bit & 1).astype(bool)
            packed = np.zeros(len(ones) // 64 + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.levels.append((bit, packed, before, len(ones) - int(before[-1])))
            current = np.concatenate([current[~ones], current[ones]])
        self.base = self._walk(np.arange(n_symbols, dtype=np.int32), np.zeros(n_symbols, np.int32))

    def _walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            word = places >> 6
            ones = before.take(word) + np.bitwise_count(packed.take(word) & _MASKS.take(places & 63))
            places = np.where((symbols & (1 << bit)).astype(bool), ones + zeros, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbols, places) - self.base[symbols]


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    """Rank of the suffix `by` places later; 0 beyond the end."""
    out = np.zeros_like(rank)
    if by < len(rank):
        out[: len(rank) - by] = rank[by:] + 1
    return out


class FMIndex:
    """Index of a sequence of numbers 0 to n_symbols - 1, for patterns of up to `depth` (255 at most) numbers.

    Suffixes are sorted by at least their first `depth` symbols, which is all that
    backward search for such patterns depends on. Kept are the wavelet matrix,
    lcp (how many symbols, `depth` at most, a suffix shares with the one before
    it) with its minima over powers of two of blocks, and for each interval of
    `depth` equal symbols the least of the `labels` of its places. The suffix
    array goes once these are built.
    """

    BLOCK = 16

    def __init__(self, sequence: np.ndarray, n_symbols: int, depth: int, labels: np.ndarray) -> None:
        n = len(sequence)
        rank, width, by_width = sequence.astype(np.int64), 1, {}
        while True:
            by_width[width] = rank
            key = rank * (n + n_symbols + 1) + _shifted(rank, width)
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            new = np.ones(n, np.int64)
            new[1:] = ordered[1:] != ordered[:-1]
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(new)
            width *= 2
            if width >= depth:
                break
        by_width[width] = rank
        self.n, self.depth = n, depth
        self.wavelet = Wavelet(sequence[suffixes - 1], n_symbols)
        self.smaller = np.zeros(n_symbols + 1, np.int32)
        np.cumsum(np.bincount(sequence, minlength=n_symbols), out=self.smaller[1:])
        shared, left, right = np.zeros(max(0, n - 1), np.int64), suffixes[:-1], suffixes[1:]
        for width in sorted(by_width, reverse=True):
            ranks = np.append(by_width[width], np.zeros(depth + width, np.int64))
            a, b = left + shared, right + shared
            inside = np.maximum(a, b) + width <= n
            shared += np.where(inside & (ranks[a] == ranks[b]), width, 0)
        self.lcp = np.zeros(n + self.BLOCK + 1, np.uint8)
        self.lcp[1:n] = np.minimum(shared, depth)
        blocks = self.lcp[: len(self.lcp) // self.BLOCK * self.BLOCK].reshape(-1, self.BLOCK).min(axis=1)
        self.minima = [blocks]
        while len(blocks) > 1:
            step = 1 << (len(self.minima) - 1)
            after = np.zeros_like(blocks)
            after[: len(blocks) - step] = blocks[step:] if step < len(blocks) else 0
            blocks = np.minimum(blocks, after)
            self.minima.append(blocks)
            if 2 * step >= len(blocks):
                break
        self.group = np.cumsum(self.lcp[:n] < depth, dtype=np.int32) - 1
        self.least = np.minimum.reduceat(labels[suffixes], np.flatnonzero(self.lcp[:n] < depth))
        self.shorter, self.starts = np.cumsum(self.lcp[:n] < depth - 1, dtype=np.int32) - 1, np.flatnonzero(self.lcp[: n + 1] < depth - 1).astype(np.int32)

    def _next(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose lcp is below `length`."""
        at = at.copy()

        def scan(some: np.ndarray) -> np.ndarray:
            """To the next start of a block, or to the place looked for; who is at the start of a block."""
            for _ in range(self.BLOCK):
                some = some[self.lcp[at[some]] >= length[some]]
                at[some] += 1
                some = some[at[some] % self.BLOCK != 0]
                if not len(some):
                    break
            return np.flatnonzero((at % self.BLOCK == 0) & (self.lcp[at] >= length))

        some = scan(np.flatnonzero(at % self.BLOCK != 0))
        block, wanted = at[some] // self.BLOCK, length[some]
        for k in reversed(range(len(self.minima))):
            minima = self.minima[k]
            go = (block < len(minima)) & (minima[np.minimum(block, len(minima) - 1)] >= wanted)
            block += go << k
        at[some] = block * self.BLOCK
        some = some[self.lcp[at[some]] >= wanted]
        while len(some):
            at[some] += 1
            some = some[self.lcp[at[some]] >= length[some]]
        return at

    def _previous(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The last place up to `at` whose lcp is below `length`."""
        at = at.copy()
        some = np.flatnonzero(at % self.BLOCK != self.BLOCK - 1)
        while len(some):
            some = some[self.lcp[at[some]] >= length[some]]
            at[some] -= 1
            some = some[at[some] % self.BLOCK != self.BLOCK - 1]
        some = np.flatnonzero(self.lcp[at] >= length)  # at the end of a block each
        block, wanted = at[some] // self.BLOCK, length[some]
        for k in reversed(range(len(self.minima))):
            start = block - (1 << k) + 1
            go = (start >= 0) & (self.minima[k][np.maximum(start, 0)] >= wanted)
            block -= go << k
        at[some] = block * self.BLOCK + self.BLOCK - 1
        some = some[self.lcp[at[some]] >= wanted]
        while len(some):
            at[some] -= 1
            some = some[self.lcp[at[some]] >= length[some]]
        return at

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length) of the longest shorter match with more places: LCP at the ends of the interval tells its length."""
        length = np.maximum(self.lcp[low], self.lcp[high])
        some = np.flatnonzero(length)
        wide, end = np.zeros_like(low), np.full_like(high, self.n)
        wide[some], end[some] = self._previous(low[some], length[some]), self._next(high[some], length[some])
        return wide, end, length.astype(np.int32)

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before each; none for symbols below 0."""
        known = np.maximum(symbols, 0)
        both = self.wavelet.rank(np.concatenate([known, known]), np.concatenate([low, high]))
        start = self.smaller[known]
        return start + both[: len(low)], np.where(symbols < 0, start + both[: len(low)], start + both[len(low) :])


def least_labels(index: FMIndex, sequence: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each window of `index.depth` numbers of the documents sequence[start:end], one document after the other: the least label of its occurrences in the index, -1 if it has none.

    Backward search of all documents at once. The match at a place is as long as
    the matching statistics there, up to the depth; where it can't be extended
    to the left it is shortened from the right to the parent interval until it
    can. A match of full length is an interval above the threshold.
    """
    depth, lengths = index.depth, (ends - starts).astype(np.int64)
    n_windows = np.maximum(0, lengths - depth + 1)
    out = np.full(int(n_windows.sum()), -1, np.int64)
    base = np.cumsum(n_windows) - n_windows - starts
    order = np.argsort(-lengths, kind="stable")
    low, high, matched = np.zeros(len(starts), np.int32), np.full(len(starts), index.n, np.int32), np.zeros(len(starts), np.int32)
    ordered = -lengths[order]
    for step in range(int(lengths.max(initial=0))):
        active = order[: np.searchsorted(ordered, -step, side="left")]
        place = ends[active] - 1 - step
        symbols = sequence[place]
        full = active[matched[active] == depth]
        at = index.shorter[low[full]]  # its last symbol goes
        low[full], high[full], matched[full] = index.starts[at], index.starts[at + 1], depth - 1
        new_low, new_high = index.extend(low[active], high[active], symbols)
        lost = np.flatnonzero(new_low >= new_high)
        while len(lost):
            nothing = lost[(matched[active[lost]] == 0) | (symbols[lost] < 0)]  # the symbol itself does not occur
            new_low[nothing], new_high[nothing], matched[active[nothing]] = 0, index.n, -1
            lost = lost[(matched[active[lost]] > 0) & (symbols[lost] >= 0)]
            who = active[lost]
            low[who], high[who], matched[who] = index.parent(low[who], high[who])
            new_low[lost], new_high[lost] = index.extend(low[who], high[who], symbols[lost])
            lost = lost[new_low[lost] >= new_high[lost]]
        low[active], high[active] = new_low, new_high
        matched[active] += 1
        full = np.flatnonzero(matched[active] == depth)
        out[base[active[full]] + place[full]] = index.least[index.group[new_low[full]]]
    return out
