"""An FM-index over a sequence of numbers: backward search by wavelet ranks, occurrences from sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so manieth position is sampled.
SAMPLED = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling. Each 0 is a separator of its own, so no comparison runs past one."""
    n = len(symbols)
    cuts = symbols == 0
    rank = symbols.astype(np.int64) + int(cuts.sum())
    rank[cuts] = np.arange(cuts.sum())
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        pair = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        dense = np.concatenate([np.zeros(1, np.int64), np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = dense
        step *= 2
        if dense[-1] == n - 1 or step >= n:
            return order


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, how many ones stand before a place."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        rest = symbols
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            before = np.zeros(len(rest) + 1, np.int64)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(rest) - int(before[-1])))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places end in the block of the symbol on the lowest level."""
        for bit, before, zeros in self.levels:
            ones = before[at]
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before ``at``."""
        return self.place(symbol, at) - self.place(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            ones = before[at]
            one = before[at + 1] - ones
            symbol |= one << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbol


class FmIndex:
    def __init__(self, symbols: np.ndarray):
        """``symbols``: numbers above 0, with 0 between independent stretches and at the end."""
        n = len(symbols)
        order = suffix_array(symbols)
        self.n, top = n, int(symbols.max()) if n else 0
        last = symbols[(order - 1) % n]
        self.wavelet = Wavelet(last, top)
        counts = np.bincount(symbols, minlength=top + 2)
        self.first = np.cumsum(counts) - counts
        self.top = top
        # stretches' first positions are sampled too: a walk never crosses a separator
        sampled = (order % SAMPLED == 0) | (last == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (a row of ``phrases``, padded behind)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, int(lengths.max()) + 1 if len(lengths) else 0):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, lengths[live] - back]
            known = symbol <= self.top
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows' suffixes: walk back to a sampled one and add the steps."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            symbol = self.wavelet.access(at)
            at = self.first[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out
