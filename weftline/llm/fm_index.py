"""An FM-index over integer symbols, in numpy: suffix sorting, wavelet matrix, backward search, locating.

The text is a sequence of segments, each ended by the symbol 0. Every such end counts as a symbol of its
own (earlier ends are smaller), so no match crosses it and equal segments keep a definite order."""

from __future__ import annotations

import numpy as np

MAX_SYMBOLS = 1 << 21
SAMPLE = 8


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes in order. text ends with 0; fewer than MAX_SYMBOLS symbols."""
    n = len(text)
    place = max(1, int(n - 1).bit_length())
    bits = max(1, int(sigma - 1).bit_length())
    depth = max(1, (63 - place) // bits)
    key = np.zeros(n, np.uint64)
    ended = np.zeros(n, bool)  # an end lies within the first depth symbols
    padded = np.concatenate([text.astype(np.uint64), np.zeros(depth, np.uint64)])
    for k in range(depth):
        now = padded[k : k + n]
        key = (key << np.uint64(bits)) | np.where(ended, np.uint64(0), now)
        ended |= now == 0
    key = (key << np.uint64(place)) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << place) - 1)).astype(np.int64)
    key >>= np.uint64(place)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ended[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    last = np.append(new[1:], True)
    open_ = np.flatnonzero(~(new & last))  # places whose suffix isn't told apart yet
    while len(open_):
        at = order[open_]
        key = (rank[at] << 42) | (rank[at + depth] << 21) | at
        key.sort()
        at = key & ((1 << 21) - 1)
        key >>= 21
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class FmIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        order = suffix_array(text, sigma)
        before = text[order - 1]
        before[order == 0] = 0
        self.n, self.last = n, before
        count = np.bincount(text, minlength=sigma)
        self.first = np.cumsum(count) - count
        # Wavelet matrix: for each bit, highest first, the number of zeros before each place.
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, now = [], before.astype(np.int32)
        symbols = np.arange(sigma)
        base = np.zeros(sigma, np.int64)
        for b in range(self.bits - 1, -1, -1):
            zero = (now >> b & 1) == 0
            z = np.zeros(n + 1, np.int32)
            np.cumsum(zero, out=z[1:])
            self.zeros.append(z)
            now = np.concatenate([now[zero], now[~zero]])
            one = (symbols >> b & 1) == 1
            base = np.where(one, z[n] + base - z[base], z[base])
        self.base = base
        # Sampled suffix positions: every SAMPLE-th, and each segment's start, so no walk passes an end.
        start = np.zeros(n, bool)
        start[0] = True
        start[1:] = text[:-1] == 0
        marked = start[order] | (order % SAMPLE == 0)
        self.marked, self.marks_before, self.samples = marked, np.cumsum(marked) - marked, order[marked]

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """first[symbol] + rank of symbol before place."""
        at = place
        for k, z in enumerate(self.zeros):
            zero = z[at]
            at = np.where(symbol >> (self.bits - 1 - k) & 1, z[self.n] + at - zero, zero)
        return self.first[symbol] + at - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of phrases (one symbol a column), those that occur, and their ranges of suffixes."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, k]
            low, high = self.step(symbol, low), self.step(symbol, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            hit = self.marked[rows]
            out[todo[hit]] = self.samples[self.marks_before[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            rows = self.step(self.last[rows], rows)
            steps += 1
        return out
