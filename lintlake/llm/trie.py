"""A compact bigram trie: Elias-Fano levels in a memory-mapped file, searched by context-relative successor."""

from __future__ import annotations

import tempfile

import numpy as np

ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence below `universe` in about 2 + log2(universe / n) bits a value: low bits packed, high bits in unary.

    Built from an array, kept as three arrays (see `parts`), which may be memory maps.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        shift = np.uint64(width)
        at = (values >> shift).astype(np.int64) + np.arange(n)
        size = (max(0, universe - 1) >> width) + n + 2
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[at] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
        if width:
            start = np.arange(n, dtype=np.uint64) * shift
            word, bit = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
            part = values & ((ONE << shift) - ONE)
            np.bitwise_or.at(low, word, part << bit)
            over = bit + shift > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - bit[over]))
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return cls(n, width, low, high, zeros)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        start = i.astype(np.uint64) * np.uint64(self.width)
        word, bit = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
        left = self.low[word] >> bit
        right = np.where(bit > 0, self.low[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)), np.uint64(0))
        return (left | right) & ((ONE << np.uint64(self.width)) - ONE)

    def _nth_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left = (k - self.zeros[word]).astype(np.int64)
        bits = ~self.high[word]
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(bits & ((ONE << np.uint64(half)) - ONE)).astype(np.int64)
            go = left >= n
            left = np.where(go, left - n, left)
            bits = np.where(go, bits >> np.uint64(half), bits)
            at += half * go
        return word * 64 + at

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 value with these high bits."""
        first = np.where(high > 0, self._nth_zero(np.maximum(high, 1) - 1) - high + 1, 0)
        return first, self._nth_zero(high) - high

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first value >= x, and whether it is x; all of x below the universe."""
        x = x.astype(np.uint64)
        first, last = self.bucket((x >> np.uint64(self.width)).astype(np.int64))
        end, want = last.copy(), x & ((ONE << np.uint64(self.width)) - ONE)
        while True:
            open_ = np.flatnonzero(first < last)
            if not len(open_):
                break
            mid = (first[open_] + last[open_]) // 2
            less = self.lows(mid) < want[open_]
            first[open_] = np.where(less, mid + 1, first[open_])
            last[open_] = np.where(less, last[open_], mid)
        inside = np.flatnonzero(first < end)
        same = np.zeros(len(x), bool)
        same[inside] = self.lows(first[inside]) == want[inside]
        return first, same

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by number: the i-th one of the high bits, and the low bits."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        left = (i - ones[word]).astype(np.int64)
        bits, at = self.high[word], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(bits & ((ONE << np.uint64(half)) - ONE)).astype(np.int64)
            go = left >= n
            left = np.where(go, left - n, left)
            bits = np.where(go, bits >> np.uint64(half), bits)
            at += half * go
        return ((word * 64 + at - i).astype(np.uint64) << np.uint64(self.width)) | self.lows(i)


class Trie:
    """Level 1: contexts, and monotone pointers to where their successors begin. Level 2: successors; each context's range is made
    to follow the one before by adding that one's last value (its base), so the level is one monotone sequence, and
    a successor is sought relative to its context's base. One quantised value per entry. All levels are memory-mapped."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray):
        """Entries sorted by context, then word, each once."""
        begins = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([begins, [len(contexts)]]))
        ends = words[begins + counts - 1].astype(np.int64) if len(begins) else np.zeros(0, np.int64)
        bases = np.cumsum(ends + 1) - (ends + 1)
        values = words.astype(np.int64) + np.repeat(bases, counts)
        top = int(contexts[-1]) + 2 if len(contexts) else 2
        self.limit, self.top = int(values[-1]) + 2 if len(values) else 2, top
        levels = [EliasFano.of(contexts[begins], top), EliasFano.of(np.concatenate([begins, [len(contexts)]]), len(contexts) + 1),
                  EliasFano.of(np.concatenate([bases, [self.limit]]), self.limit + 1), EliasFano.of(values, self.limit)]
        arrays = [a for level in levels for a in level.parts()] + [codes]
        self.file = tempfile.TemporaryFile()
        for a in arrays:
            self.file.write(np.ascontiguousarray(a).tobytes())
            self.file.write(b"\0" * (-a.nbytes % 8))
        self.file.flush()
        self.bytes = self.file.tell()
        whole = np.memmap(self.file, np.uint8, "r") if self.bytes else np.zeros(0, np.uint8)
        maps, at = [], 0
        for a in arrays:
            maps.append(whole[at:at + a.nbytes].view(a.dtype))
            at += a.nbytes + -a.nbytes % 8
        for k, level in enumerate(levels):
            level.low, level.high, level.zeros = maps[3 * k:3 * k + 3]
        (self.contexts, self.pointers, self.bases, self.words), self.codes = levels, maps[-1]

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the given pairs, and whether the trie has them."""
        found = np.zeros(len(contexts), bool)
        codes = np.zeros(len(contexts), self.codes.dtype)
        known = np.flatnonzero(contexts < self.top - 1)
        place, same = self.contexts.successor(contexts[known])
        known, place = known[same], place[same]
        base, after = self.bases.at(place), self.bases.at(place + 1)
        x = words[known].astype(np.uint64) + base
        near = x < after
        known, place, x = known[near], place[near], x[near]
        entry, same = self.words.successor(x)
        first, last = self.pointers.at(place).astype(np.int64), self.pointers.at(place + 1).astype(np.int64)
        same &= (entry >= first) & (entry < last)
        found[known[same]] = True
        codes[known[same]] = self.codes[entry[same]]
        return codes, found

    def close(self) -> None:
        self.file.close()
