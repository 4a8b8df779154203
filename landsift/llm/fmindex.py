"""FM-index over a sequence of small numbers: count and locate phrases by backward search.

Number 0 is a break that no phrase crosses. Every break differs from all others, so equal stretches
end there and suffix sorting stays short; suffixes that begin with a break are not indexed.
"""

from __future__ import annotations

import numpy as np

U6, U63 = np.uint64(6), np.uint64(63)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the non-break numbers, in the order of the suffixes that begin there.

    Prefix doubling; after each round only suffixes that are still tied are sorted again.
    """
    n = len(text)
    places = np.flatnonzero(text)
    narrow = text[places].astype(np.uint16 if text.max(initial=0) < 1 << 16 else np.int64)
    by = np.argsort(narrow, kind="stable")
    order, first = places[by], narrow[by]
    rank = np.arange(n + 1, dtype=np.int64)  # breaks and the end, told apart by place, come first
    fresh = np.concatenate(([True], first[1:] != first[:-1])) if len(first) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    rank[order] = head + n + 1
    tied = _tied(fresh)
    slots, width = np.flatnonzero(tied), 1
    while len(slots):
        at = order[slots]
        group, following = rank[at], rank[np.minimum(at + width, n)]
        by = np.argsort((group.astype(np.uint64) << np.uint64(32)) | following.astype(np.uint64))
        at, group, following = at[by], group[by], following[by]
        order[slots] = at  # a group's slots adjoin, and groups keep their order
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])))
        head = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[at] = head + n + 1
        slots = slots[_tied(fresh)]
        width *= 2
    return order


def _tied(fresh: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, given where groups begin."""
    return ~(fresh & np.concatenate((fresh[1:], [True]))) if len(fresh) else fresh


class Bits:
    """A bit sequence with ranks: packed words and the count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before place ``i``."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Ranks of every symbol of a sequence, one bit level at a time from the highest (level-wise layout)."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.levels = []
        for k in reversed(range(depth)):
            bit = ((sequence >> k) & 1).astype(bool)
            self.levels.append((k, Bits(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place ``i``."""
        low = np.zeros_like(i)
        for k, bits, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def get(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for k, bits, zeros in self.levels:
            one, a = bits.get(i), bits.rank(i)
            symbol |= one.astype(symbol.dtype) << k
            i = np.where(one, zeros + a, i - a)
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, rate: int = 8):
        """``text`` holds 0 (break) to ``symbols``; every ``rate``-th place is sampled."""
        text = np.asarray(text, np.int64)
        order = suffix_order(text)
        last = np.where(order > 0, text[np.maximum(order - 1, 0)], 0)
        followed = np.append(text[1:], 0)
        counts = np.bincount(text[order], minlength=symbols + 2)
        at_break = np.bincount(text[order[followed[order] == 0]], minlength=symbols + 2)
        self.starts = np.concatenate(([0], np.cumsum(counts)))[:symbols + 2]
        self.ends = self.starts + counts[:symbols + 2]
        self.base = self.starts + at_break[:symbols + 2]  # a symbol before a break has no successor row; such rows come first
        self.tree = WaveletTree(last, max(1, int(symbols).bit_length()))
        sampled = (order % rate == 0) | (last == 0)
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase (one per row, equal lengths)."""
        symbol = phrases[:, -1]
        low, high = self.starts[symbol], self.ends[symbol]
        for k in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[:, k]
            low, high = self.base[symbol] + self.tree.rank(symbol, low), self.base[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: step back to a sampled row and count the steps."""
        places = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            done = self.sampled.get(rows)
            places[left[done]] = self.samples[self.sampled.rank(rows[done])] + steps
            left, rows = left[~done], rows[~done]
            symbol = self.tree.get(rows)
            rows = self.base[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return places

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: the phrase's row number and the place where it begins."""
        low, high = self.search(phrases)
        size = high - low
        which = np.repeat(np.arange(len(phrases)), size)
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        return which, self.locate(rows)
