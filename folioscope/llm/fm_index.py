"""A compressed FM-index over sequences of symbols, searched for many patterns at once.

The Burrows-Wheeler transform is held as a wavelet tree in matrix form: one bit vector
for each bit of a symbol, packed in 64-bit words with a running count for each word.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with ranks. Words of 64 equal bits, which runs of the transform make many of, are told by their counts alone."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words)
        before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        mixed = (ones > 0) & (ones < 64)
        place = np.where(mixed, np.cumsum(mixed) + 1, ones // 64)
        self.at = before[:-1] << 32 | place  # ones before a word, and where its bits are kept
        self.kept = np.concatenate([np.array([0, (1 << 64) - 1], np.uint64), words[mixed]])
        self.zeros = len(bits) - int(before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = self.at[i >> 6]
        mask = (np.uint64(1) << (i & 63).view(np.uint64)) - np.uint64(1)
        return (at >> 32) + np.bitwise_count(self.kept[at & 0xFFFFFFFF] & mask)


class RangeMinimum:
    """Least values of ranges: tables of 1, 2, 4 and 8 values from each place, and of 2^k groups of eight.

    Six times the space of the values, where tables of all lengths from each place take twenty.
    """

    def __init__(self, values: np.ndarray):
        self.fine = self._doubled([values], 4)
        groups = np.full(len(values) // 8 + 1, np.iinfo(np.int32).max, np.int32)
        whole = len(values) // 8
        groups[:whole] = values[: whole * 8].reshape(whole, 8).min(1)
        self.coarse = self._doubled([groups], 64)

    @staticmethod
    def _doubled(tables: list[np.ndarray], most: int) -> list[np.ndarray]:
        while len(tables) < most and len(tables[-1]) > 1 << (len(tables) - 1):
            step, last = 1 << (len(tables) - 1), tables[-1]
            tables.append(np.minimum(last[:-step], last[step:]))
        return tables

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of non-empty ranges [low, high)."""
        span = np.bitwise_count(_fill(high - low)).astype(np.int64) - 1
        fine = np.minimum(span, 3)
        out = np.empty(len(low), np.int32)
        for k in range(int(fine.max()) + 1 if len(fine) else 0):
            pick = np.flatnonzero(fine == k)
            out[pick] = np.minimum(self.fine[k][low[pick]], self.fine[k][high[pick] - (1 << k)])
        long = np.flatnonzero(span > 3)
        first, last = (low[long] + 7) >> 3, high[long] >> 3
        level = np.bitwise_count(_fill(last - first)).astype(np.int64) - 1
        for k in np.unique(level[level >= 0]):
            some = level == k
            table, pick = self.coarse[k], long[some]
            out[pick] = np.minimum(out[pick], np.minimum(table[first[some]], table[last[some] - (1 << int(k))]))
        return out


class FMIndex:
    """Over sequences joined with an end mark after each; symbols are 1 to ``symbols``."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, symbols: int, owner: np.ndarray):
        """text: symbols with 0 at ``ends``; owner: a number for each position, whose least ``least_owner`` gives for suffix ranges."""
        order = self._suffixes(text, ends)
        transform = text[order - 1]
        self.levels = max(1, int(symbols).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.bits = []
        level = transform
        for shift in range(self.levels - 1, -1, -1):
            bit = (level >> shift) & 1
            self.bits.append(BitVector(bit.astype(np.uint8)))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        every = np.arange(symbols + 1)
        self.base = self._descend(every, np.zeros(symbols + 1, np.int64))
        self.size = len(text)
        self.least_owner = RangeMinimum(owner[order].astype(np.int32))

    @staticmethod
    def _suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Order of suffixes up to their end marks, by doubling; marks differ by their place."""
        n = len(text)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[:-step] = rank[step:] + 1
            follow[text == 0] = 0
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            if int(new.max()) == n - 1:
                return order
            rank, step = new, step * 2

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.bits):
            ones = bits.rank(at)
            up = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(up == 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns with a symbol put in front."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.first[symbol] - self.base[symbol]
        m = len(symbol)
        return both[:m] + start, both[m:] + start


def _fill(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return x


def matched_windows(index: FMIndex, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, below: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, from, to): intervals of patterns whose windows all occur under an owner less than ``below``.

    Backward search gives a pattern's matching statistics only where they decide a
    window. Of the window starts that are still open, the last one is searched from its
    end as far left as it matches, which settles all windows inside the match; then the
    first one, whose failure settles all windows that hold the piece that failed. Symbol 0
    in a pattern is one that no sequence has.
    """
    first, last = np.zeros(len(starts), np.int64), lengths - window
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alive = np.flatnonzero(last >= first)
    from_right = np.ones(len(starts), bool)
    end = np.zeros(len(starts), np.int64)
    left = np.zeros(len(starts), np.int64)
    low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)

    def restart(rows: np.ndarray) -> None:
        end[rows] = np.where(from_right[rows], last[rows], first[rows]) + window
        left[rows] = end[rows]
        low[rows], high[rows] = 0, index.size

    restart(alive)
    while len(alive):
        symbol = patterns[starts[alive] + left[alive] - 1]
        lo, hi = index.extend(symbol, low[alive], high[alive])
        ok = (lo < hi) & (symbol > 0)
        ok[ok] = index.least_owner(lo[ok], hi[ok]) < below[alive[ok]]
        go = alive[ok]
        low[go], high[go] = lo[ok], hi[ok]
        left[go] -= 1
        stop = alive[~ok | (left[alive] == first[alive])]
        if not len(stop):
            continue
        long = end[stop] - left[stop] >= window
        hit = stop[long]
        if len(hit):
            found.append((hit, left[hit].copy(), end[hit].copy()))
        right, r_long = stop[from_right[stop]], long[from_right[stop]]
        last[right] = np.where(r_long, left[right] - 1, last[right] - 1)
        other, o_long = stop[~from_right[stop]], long[~from_right[stop]]
        first[other] = np.where(o_long, first[other] + 1, left[other])
        from_right[stop] = ~from_right[stop]
        alive = alive[last[alive] >= first[alive]]
        restart(stop[last[stop] >= first[stop]])
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))
