"""An FM-index over a sequence of small integers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the sequence are kept to locate occurrences.
SAMPLING = 16


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order, by doubling the compared length; only ties are sorted again."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    slots, keys, length = np.arange(n), values[order], 0
    while len(slots):
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[order[slots]] = slots[head]
        alone = fresh & np.append(fresh[1:], True)
        slots = slots[~alone]
        length = 2 * length or 1
        at = order[slots]
        beyond = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        keys = rank[at] * (n + 2) + beyond
        again = np.argsort(keys, kind="stable")
        order[slots], keys = at[again], keys[again]
    return order


class FMIndex:
    """Index of symbols 1..size-1, where 0 separates runs that no phrase spans."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        gaps = symbols == 0
        # Separators differ from each other, so that no comparison goes on behind one.
        values = np.where(gaps, np.cumsum(gaps) - 1, symbols + int(gaps.sum()))
        order = suffix_order(values)
        self.n = n
        self.last = np.where(order > 0, symbols[order - 1], 0)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        # Wavelet matrix: for each bit from the top, ones before each place; then zeros first, ones after.
        self.levels, current = [], self.last
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            ones = (current >> bit & 1).astype(bool)
            before = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, n - int(before[-1]), before))
            current = np.concatenate([current[~ones], current[ones]])
        starts = np.ones(n, dtype=bool)
        starts[1:] = gaps[:-1]
        kept = starts | gaps | (np.arange(n) % SAMPLING == 0)
        self.sampled = kept[order]
        self.position = np.where(self.sampled, order, -1)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the last column."""
        at, base = places.astype(np.int64), np.zeros(len(places), np.int64)
        for bit, zeros, before in self.levels:
            one = (symbols >> bit & 1).astype(bool)
            at = np.where(one, zeros + before[at], at - before[at])
            base = np.where(one, zeros + before[base], base - before[base])
        return at - base

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one suffix row of each phrase (rows of a matrix, filled up on the right); backwards, all at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((lengths > 0) & (high > low))
        for step in range(1, (int(lengths.max()) if len(lengths) else 0) + 1):
            alive = alive[(lengths[alive] >= step) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - step]
            low[alive] = self.less[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.less[symbol] + self.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the sequence of each suffix row: walk back to a sampled one."""
        rows, steps, found = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.sampled[rows]
            found[open_[here]] = self.position[rows[here]] + steps
            open_, rows = open_[~here], rows[~here]
            symbol = self.last[rows]
            rows = self.less[symbol] + self.rank(symbol, rows)
            steps += 1
        return found
