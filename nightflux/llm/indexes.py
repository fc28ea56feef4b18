"""Arrays for one shard: suffix array, wavelet matrix, FM-index. A shard is small; Spark deals the shards."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(seq: np.ndarray, depth: int, pack: int = 1, bits: int = 32) -> np.ndarray:
    """Suffixes of seq in order, compared over at least depth symbols (prefix doubling of those that are still equal).

    pack symbols of so many bits are compared at once in the first round.
    """
    n = len(seq)
    key = np.zeros(n, np.int64)
    for j in range(pack):
        key <<= bits
        key[: n - j] |= seq[j:]
    sa = np.argsort(key)
    live, key, h = np.arange(n), key[sa], pack  # places of the array that may still change, and their keys in order
    rank = np.zeros(n + 1, np.int64)  # of a suffix: 1 + the place of the first that equals it so far; 0 behind the end
    while True:
        new = np.ones(len(live), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(live)))
        rank[sa[live]] = np.repeat(live[begin] + 1, size)
        live = live[np.repeat(size > 1, size)]
        if h >= depth or not len(live):
            return sa
        own = sa[live]
        key = rank[own] * (n + 1) + rank[np.minimum(own + h, n)]
        order = np.argsort(key)
        sa[live], key = own[order], key[order]
        h *= 2


class WaveletMatrix:
    """Bit vectors by level with counts each 64 bits; ranks of many places at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.levels, cur = len(seq), [], seq
        for b in range(bits - 1, -1, -1):
            bit = (cur >> b) & 1
            packed = np.zeros((self.n >> 6) + 1, U64)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            on = bit.astype(bool)
            self.levels.append((b, packed, ones, self.n - int(ones[-1])))
            cur = np.concatenate([cur[~on], cur[on]])
        self.first = np.zeros(1 << bits, np.int64)  # place of a symbol's first copy below the last level
        if self.n:
            at = np.flatnonzero(np.concatenate([[True], cur[1:] != cur[:-1]]))
            self.first[cur[at]] = at

    @staticmethod
    def _ones(packed: np.ndarray, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return ones[w] + np.bitwise_count(packed[w] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols are c."""
        for b, packed, ones, zeros in self.levels:
            one = self._ones(packed, ones, i)
            i = np.where((c >> b) & 1 == 1, zeros + one, i - one)
        return i - self.first[c]


class FMIndex:
    """FM-index of a sequence of small whole numbers; 0 separates the pieces and is never searched."""

    def __init__(self, seq: np.ndarray, depth: int, pack: int = 1, bits: int | None = None):
        self.bits = bits or max(1, int(seq.max(initial=0)).bit_length())
        self.n = len(seq)
        self.sa = suffix_array(seq, depth, pack, self.bits)
        self.bwt = WaveletMatrix(seq[self.sa - 1], self.bits)
        self.below = np.zeros((1 << self.bits) + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=1 << self.bits), out=self.below[1:])

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with c and go on as those in the given ranges."""
        return self.below[c] + self.bwt.rank(c, lo), self.below[c] + self.bwt.rank(c, hi)

    def search(self, seq: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of seq[a : a + length] for each a of at.

        Returns the matching statistic, cut off at length (the search ends early where one suffix is left, and the
        statistic is then what had matched), and the range of the suffixes that match.
        """
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        matched = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for j in range(length - 1, -1, -1):
            a, z = self.step(seq[at[live] + j], lo[live], hi[live])
            lo[live], hi[live] = a, z
            matched[live] += 1
            live = live[z - a > 1]
            if not len(live):
                break
        return matched, lo, hi


class RunIndex:
    """Burrows-Wheeler transform of a sequence of small whole numbers, held as runs of equal symbols; 0 separates the pieces."""

    def __init__(self, seq: np.ndarray, depth: int, pack: int, bits: int):
        self.n = len(seq)
        self.sa = suffix_array(seq, depth, pack, bits)
        last = seq[self.sa - 1]
        new = np.ones(self.n, bool)
        np.not_equal(last[1:], last[:-1], out=new[1:])
        begin = np.flatnonzero(new)
        self.head = np.append(begin, self.n)  # where each run begins
        self.run = np.cumsum(new) - 1  # the run of each place
        self.symbol = last[begin].astype(np.int64)
        self.order = order = np.argsort(last[begin], kind="stable")  # runs by symbol
        size = np.diff(self.head)[order]
        self.target = np.empty(len(begin), np.int64)  # place of the suffix one symbol longer, for the first of each run
        self.target[order] = np.cumsum(size) - size
        self.sorted = self.symbol[order] * len(begin) + order
        same = self.symbol[order[1:]] == self.symbol[order[:-1]]
        self.next = np.full(len(begin), len(begin))  # the next run of the same symbol, and the one before
        self.next[order[:-1][same]] = order[1:][same]
        self.before = np.full(len(begin), -1)
        self.before[order[1:][same]] = order[:-1][same]

    def extended(self, lo: np.ndarray, hi: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range and each symbol before it: the range of the longer suffixes, where its end is not found yet."""
        a, z = self.run[lo], self.run[hi - 1]
        count = z - a + 1
        of = np.repeat(np.arange(len(lo)), count)
        r = np.arange(len(of)) + (a - (np.cumsum(count) - count))[of]
        at = np.flatnonzero((self.next[r] > z[of]) & (self.symbol[r] > 0))  # the last run of its symbol in the range
        r, of = r[at], of[at]
        end = self.target[r] + np.minimum(self.head[r + 1], hi[of]) - self.head[r]
        at = np.flatnonzero(~found[end])
        r, of, end = r[at], of[at], end[at]
        many = np.flatnonzero(self.before[r] >= a[of])  # there its first run is another one
        r[many] = self.order[np.searchsorted(self.sorted, self.symbol[r[many]] * len(self.symbol) + a[of[many]])]
        return self.target[r] + np.maximum(lo[of] - self.head[r], 0), end

    def boundaries(self, length: int) -> np.ndarray:
        """Whether the common prefix of the suffixes at i - 1 and i of the array is under length symbols.

        Intervals are extended to the left breadth first, so the common prefixes come by increasing value; it stops
        at length. Boundaries next to suffixes that meet a separator within length symbols may be left out.
        """
        found = np.zeros(self.n + 1, bool)
        found[[0, self.n]] = True
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for _ in range(length):
            lo, hi = self.extended(lo, hi, found)
            if not len(lo):
                break
            found[hi] = True
        return found
