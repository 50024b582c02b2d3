"""A compressed FM-index over whole numbers, searched for many patterns at once.

The suffix order comes from prefix doubling, the Burrows-Wheeler transform is
kept as a wavelet matrix of packed bit vectors with a count for every 64 bits.
Every operation takes arrays, so a step of the backward search advances all
patterns together.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (non-negative numbers; equal suffixes can't occur in it)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    k = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:n - k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        step = np.empty(n, dtype=np.int64)
        step[0] = 0
        np.cumsum(key[1:] != key[:-1], out=step[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        if step[-1] == n - 1 or k >= n:
            return order
        k *= 2


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max()).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        x = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=bool)
            padded[:self.n] = bit
            word = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(word)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64)[:-1])))
            self.zeros.append(int(self.n - bit.sum()))
            x = np.concatenate((x[~bit], x[bit]))

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first ``i`` symbols send ``symbol`` after all levels."""
        for level in range(self.levels):
            at = i >> 6
            ones = self.counts[level][at] + np.bitwise_count(self.words[level][at] & ((_U(1) << (i & 63).astype(_U)) - _U(1))).astype(np.int64)
            i = np.where(symbol >> self.levels - 1 - level & 1, self.zeros[level] + ones, i - ones)
        return i


class FMIndex:
    """Index of several sequences of numbers; no match runs across two of them."""

    def __init__(self, values: np.ndarray, ends: np.ndarray):
        """``values``: the sequences, one after another; ``ends``: where each ends."""
        self.alphabet, symbol = np.unique(values, return_inverse=True)
        many = len(ends)
        at = ends + np.arange(many)  # a separator after each sequence
        text = np.empty(len(values) + many, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[at] = False
        text[inside] = symbol + many
        text[at] = np.arange(many)  # separators differ for the order only
        order = suffix_order(text)
        bwt = np.where(text < many, 0, text - many + 1)[order - 1]
        self.size = len(text)
        self.matrix = WaveletMatrix(bwt)
        every = np.arange(len(self.alphabet) + 1)
        before = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=len(every)))))[:-1]
        self.shift = before - self.matrix.place(every, np.zeros(len(every), dtype=np.int64))

    def symbols(self, values: np.ndarray) -> np.ndarray:
        """Symbols of values that the index holds."""
        return np.searchsorted(self.alphabet, values) + 1

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with ``symbol`` put in front."""
        both = self.matrix.place(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return both[:len(lo)] + self.shift[symbol], both[len(lo):] + self.shift[symbol]

    def reach(self, symbol: np.ndarray, last: np.ndarray, first: np.ndarray, least: int = 2) -> np.ndarray:
        """For each pattern end ``last``, the smallest start not under ``first`` from
        which the stretch of ``symbol`` up to it occurs ``least`` times in the index
        (``last + 1`` where even its last symbol does not)."""
        out = last + 1
        live = np.flatnonzero(last >= first)
        at = last[live]
        lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.size, dtype=np.int64)
        while len(live):
            lo, hi = self.step(symbol[at], lo, hi)
            good = hi - lo >= least
            live, at, lo, hi = live[good], at[good], lo[good], hi[good]
            out[live] = at
            more = at > first[live]
            live, at, lo, hi = live[more], at[more] - 1, lo[more], hi[more]
        return out


def repeated_windows(index: FMIndex, symbol: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` in the sequences (by start): does it occur twice in the index?

    The matching statistic of an end, where the longest stretch up to it that
    occurs twice begins, never moves left as the end moves right.  So it is
    searched at a sequence's last end and first window's end, and between two
    ends only where theirs leave it open whether windows repeat.
    """
    out = np.zeros(len(symbol) + 1, dtype=np.int32)  # marks: +1 at first, -1 after the last repeated window

    def mark(first: np.ndarray, stop: np.ndarray) -> None:
        some = first < stop
        np.add.at(out, first[some], 1)
        np.add.at(out, stop[some], -1)

    w = width - 1
    last = ends - 1
    s_hi = index.reach(symbol, last, starts)
    whole = s_hi <= starts
    mark(starts[whole], (last - w)[whole] + 1)
    starts, last, s_hi = starts[~whole], last[~whole], s_hi[~whole]
    mark(np.where(s_hi <= last - w, last - w, 0), np.where(s_hi <= last - w, last - w + 1, 0))
    lo = starts + w
    rest = lo < last
    starts, lo, hi, s_hi = starts[rest], lo[rest], last[rest], s_hi[rest]
    s_lo = index.reach(symbol, lo, starts)
    mark(np.where(s_lo <= lo - w, lo - w, 0), np.where(s_lo <= lo - w, lo - w + 1, 0))
    while len(lo):
        sure = s_hi <= lo + 1 - w  # every end between reaches over its window
        mark(lo[sure] + 1 - w, hi[sure] - w)
        open_ = ~sure & (s_lo <= hi - 1 - w) & (hi - lo > 1)
        lo, hi, s_lo, s_hi = lo[open_], hi[open_], s_lo[open_], s_hi[open_]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        s_mid = index.reach(symbol, mid, s_lo)
        hit = s_mid <= mid - w
        mark(np.where(hit, mid - w, 0), np.where(hit, mid - w + 1, 0))
        lo, hi, s_lo, s_hi = np.concatenate((lo, mid)), np.concatenate((mid, hi)), np.concatenate((s_lo, s_mid)), np.concatenate((s_mid, s_hi))
    return np.cumsum(out[:-1]) > 0
