"""Elias-Fano n-gram trie of orders 2 and 3 over one buffer, searched many keys at a time.

Words are numbers. Level 1 holds the words that have followers, level 2 under each
its followers and the words that stood before it; level 3 under each such pair its
followers, as places among the followers of the shorter context, which are smaller
numbers than words (Pibiri & Venturini, "Handling massive n-gram datasets
efficiently", 2019). Each level's numbers rise, as a range goes on where the one
before it ends; pointers to ranges rise anyway. Rising numbers take 2 bits and the
logarithm of their mean step (Elias, 1974; Fano, 1971). Probabilities are logarithms
in steps of 1 / ``STEPS``, 16 bits each.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64
STEPS = 1024
_POP = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)).astype(np.uint8)


def _select_table() -> np.ndarray:
    """Place of the k-th set bit in each number of 16 bits."""
    table = np.zeros((1 << 16, 16), np.uint8)
    number = np.arange(1 << 16)
    seen = np.zeros(1 << 16, np.int64)
    for bit in range(16):
        own = number >> bit & 1 == 1
        table[number[own], seen[own]] = bit
        seen[own] += 1
    return table


_SELECT = _select_table()


def code(log10: np.ndarray) -> np.ndarray:
    """A logarithm of a probability as a number of steps; beyond 64 powers of ten it stays there."""
    return np.clip(np.rint(-STEPS * log10), 0, 0xFFFF).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes.astype(np.float64) / -STEPS)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit in each word of 64 bits."""
    out = np.zeros(len(words), np.int64)
    left = k.astype(np.int64)
    open_ = np.ones(len(words), bool)
    for part in range(4):
        piece = (words >> _U(16 * part) & _U(0xFFFF)).astype(np.int64)
        count = _POP[piece]
        here = open_ & (left < count)
        out[here] = 16 * part + _SELECT[piece[here], left[here]]
        open_ &= ~here
        left -= np.where(open_, count, 0)
    return out


class Rising:
    """Strictly or weakly rising numbers: low bits packed, high bits in unary, and the set bits before each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @staticmethod
    def build(numbers: np.ndarray) -> Rising:
        n = len(numbers)
        numbers = numbers.astype(_U)
        top = int(numbers[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, _U)
        if bits:
            rest = numbers & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(low, word, rest << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (_U(64) - shift[over]))
        place = (numbers >> _U(bits)).astype(np.int64) + np.arange(n)
        length = (int(place[-1]) if n else 0) + 2
        flags = np.zeros((length + 63) // 64 * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(_U)
        before = np.append(0, np.cumsum(np.bitwise_count(high).astype(np.int64)))[:-1].astype(np.uint32)
        return Rising(n, bits, low, high, before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        out = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & _U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, "right") - 1
        place = (word << 6) + _select(self.high[word], i - self.before[word])
        return ((place - i).astype(_U) << _U(self.low_bits) | self._low(i)).astype(np.int64)

    def _with_high(self, h: np.ndarray) -> np.ndarray:
        """How many numbers have high bits below ``h``: those before the h-th unset bit, counted from one."""
        out = np.zeros(len(h), np.int64)
        some = h > 0
        k = h[some] - 1
        zeros = (np.arange(len(self.high), dtype=np.int64) << 6) - self.before
        word = np.searchsorted(zeros, k, "right") - 1
        last = k >= (len(self.high) << 6) - self.n  # beyond the last number
        word[last] = 0
        place = (word << 6) + _select(~self.high[word], np.where(last, 0, k - zeros[word]))
        out[some] = np.where(last, self.n, np.minimum(place - k, self.n))
        return out

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first number that isn't less than each of ``x``, the end of those with its high bits, its low bits."""
        h = x >> self.low_bits
        low, end = self._with_high(h), self._with_high(h + 1)
        rest = (x & ((1 << self.low_bits) - 1)).astype(_U)
        high = end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low, end, rest
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < rest[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]

    def successor(self, x: np.ndarray) -> np.ndarray:
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each of ``x``, -1 if it isn't there."""
        at, end, rest = self._search(x)
        some = np.flatnonzero(at < end)
        out = np.full(len(x), -1, np.int64)
        there = some[self._low(at[some]) == rest[some]]
        out[there] = at[there]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.before]


class Ranges:
    """Numbers that rise within ranges only, one range a parent: pointers, and numbers that go on where the range before ends."""

    def __init__(self, pointers: Rising, numbers: Rising):
        self.pointers, self.numbers = pointers, numbers

    @staticmethod
    def build(parent: np.ndarray, numbers: np.ndarray, parents: int) -> Ranges:
        """``parent`` rises; within one, ``numbers`` strictly rise."""
        ends = np.searchsorted(parent, np.arange(parents + 1))
        last = numbers[ends[1:] - 1] + 1 if len(numbers) else np.zeros(parents, np.int64)
        base = np.append(0, np.cumsum(np.where(ends[1:] > ends[:-1], last, 0)))[:-1]
        return Ranges(Rising.build(ends), Rising.build(numbers + base[parent]))

    def base(self, parent: np.ndarray) -> np.ndarray:
        """What was added to the numbers of a parent's range."""
        low = self.pointers.access(parent)
        out = np.zeros(len(parent), np.int64)
        some = low > 0
        out[some] = self.numbers.access(low[some] - 1) + 1
        return out

    def find(self, parent: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Place of a number in its parent's range, counted from the first range on; -1 if it isn't there or the parent is -1."""
        out = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero(parent >= 0)
        own, back = np.unique(parent[some], return_inverse=True)
        at = self.numbers.find(number[some] + self.base(own)[back])
        # a number beyond the range's last one may be found in the range after it
        out[some] = np.where((at >= self.pointers.access(own)[back]) & (at < self.pointers.access(own + 1)[back]), at, -1)
        return out

    def arrays(self) -> list[np.ndarray]:
        return self.pointers.arrays() + self.numbers.arrays()


class Trie:
    """``words`` with followers and their weight; (word, follower) with its probability; (word, word before) with its weight; followers of that pair with theirs."""

    def __init__(self, words: Rising, weight2: np.ndarray, followers: Ranges, code2: np.ndarray, contexts: Ranges, weight3: np.ndarray, thirds: Ranges, code3: np.ndarray):
        self.words, self.weight2, self.followers, self.code2 = words, weight2, followers, code2
        self.contexts, self.weight3, self.thirds, self.code3 = contexts, weight3, thirds, code3

    def write(self) -> mmap.mmap:
        """One memory map of all levels: the arrays' lengths, then the arrays, each on a multiple of eight bytes."""
        arrays = [*self.words.arrays(), self.weight2, *self.followers.arrays(), self.code2, *self.contexts.arrays(), self.weight3, *self.thirds.arrays(), self.code3]
        sizes = np.array([a.nbytes for a in arrays], np.int64)
        starts = 8 * (1 + len(arrays)) + np.append(0, np.cumsum((sizes + 7) // 8 * 8))
        out = mmap.mmap(-1, int(starts[-1]))
        out[:8] = np.int64(len(arrays)).tobytes()
        out[8 : 8 + sizes.nbytes] = sizes.tobytes()
        for a, at in zip(arrays, starts.tolist(), strict=False):
            out[at : at + a.nbytes] = a.tobytes()
        return out

    @staticmethod
    def read(buffer: mmap.mmap | bytes) -> Trie:
        """Views of a buffer that ``write`` made, in memory or mapped from a file; nothing is copied."""
        n = int(np.frombuffer(buffer, np.int64, 1)[0])
        sizes = np.frombuffer(buffer, np.int64, n, 8)
        starts = iter((8 * (1 + n) + np.append(0, np.cumsum((sizes + 7) // 8 * 8))).tolist())
        left = iter(sizes.tolist())
        take = lambda kind: np.frombuffer(buffer, kind, next(left) // np.dtype(kind).itemsize, next(starts))

        def rising() -> Rising:
            head = take(np.int64)
            return Rising(int(head[0]), int(head[1]), take(_U), take(_U), take(np.uint32))

        ranges = lambda: Ranges(rising(), rising())
        return Trie(rising(), take(np.uint16), ranges(), take(np.uint16), ranges(), take(np.uint16), ranges(), take(np.uint16))

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, code1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps of the logarithm of each w's probability after u v, and whether u v w is here; ``code1`` is that of w by itself."""
        pair, back = _pairs(v, w)
        own = self.words.find(pair[0])
        follower = self.followers.find(own, pair[1])
        place = np.where(follower >= 0, follower - self.followers.pointers.access(np.maximum(own, 0)), -1)
        own, follower, place = own[back], follower[back], place[back]
        pair, back = _pairs(v, u)
        context = self.contexts.find(self.words.find(pair[0]), pair[1])[back]
        third = self.thirds.find(np.where(place >= 0, context, -1), place)
        two = np.where(follower >= 0, _at(self.code2, follower), code1.astype(np.int64) + _at(self.weight2, own))
        return np.where(third >= 0, _at(self.code3, third), two + _at(self.weight3, context)), third >= 0


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as two rows, and which of them each is."""
    first, at = np.unique(a, return_inverse=True)
    width = int(b.max()).bit_length() if len(b) else 1
    if width + len(first).bit_length() > 62:
        second, b = np.unique(b, return_inverse=True)
        width = len(second).bit_length()
    else:
        second = None
    key, back = np.unique(at << width | b, return_inverse=True)
    rest = key & ((1 << width) - 1)
    return np.stack([first[key >> width], rest if second is None else second[rest]]), back


def _at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A value at each place, 0 at -1."""
    out = np.zeros(len(place), np.int64)
    some = place >= 0
    out[some] = values[place[some]]
    return out
