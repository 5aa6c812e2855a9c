"""Elias-Fano sequences and a two-level n-gram trie over them, readable from a memory map.

A monotone sequence of n values below u keeps each value's low l = log2(u / n) bits packed and the
high bits as unary gaps in a bitmap: about 2 + l bits a value. The trie of a shard has the levels

    contexts   sorted context keys
    words      sorted successor keys that occur in this shard
    pointers   for each context, where its successors start (monotone)
    successors context rank * words + word rank: each context's successors in order, relative to it
    codes      a quantised smoothed probability for each successor (one byte)

and a pair is found by ranking both keys and a successor search within the context's range.
"""

from __future__ import annotations

import struct

import numpy as np

#: Codes: 0 no such pair, else log10 of the probability is (1 - code) / CODE_STEPS.
CODE_STEPS = 32


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, buckets: int):
        self.n, self.low_bits, self.low, self.high, self.buckets = n, low_bits, low, high, buckets
        bits = np.unpackbits(high, bitorder="little")[: n + buckets] if n + buckets else np.zeros(0, np.uint8)
        ones = np.flatnonzero(bits)
        self.upper = (ones - np.arange(len(ones))).astype(np.uint64)
        self.first = np.searchsorted(self.upper, np.arange(buckets + 1, dtype=np.uint64))

    @classmethod
    def pack(cls, values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low_bits = max(0, int(np.floor(np.log2(universe / n)))) if n and universe > n else 0 if n else universe.bit_length()
        v = values.astype(np.uint64)
        buckets = (universe >> low_bits) + 1
        upper = (v >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(n + buckets, np.uint8)
        bits[upper + np.arange(n)] = 1
        packed = [np.zeros(0, np.uint8)]
        for i in range(0, n, 8 << 12):  # a multiple of 8 values is a whole number of bytes
            part = v[i : i + (8 << 12), None] >> np.arange(low_bits, dtype=np.uint64)
            packed.append(np.packbits((part & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(16, np.uint8)])
        high = np.packbits(bits, bitorder="little")
        return struct.pack("<5Q", n, low_bits, buckets, len(low), len(high)) + low.tobytes() + high.tobytes()

    @classmethod
    def load(cls, view: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, buckets, a, b = struct.unpack_from("<5Q", view, at)
        at += 40
        return cls(n, low_bits, np.frombuffer(view, np.uint8, a, at), np.frombuffer(view, np.uint8, b, at + a), buckets), at + a + b

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        byte = bit >> 3
        x = np.zeros(len(i), np.uint64)
        for k in range(8):
            x |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        x >>= (bit & 7).astype(np.uint64)
        over = (bit & 7) + self.low_bits > 64
        if over.any():
            x[over] |= self.low[byte[over] + 8].astype(np.uint64) << (np.uint64(64) - (bit[over] & 7).astype(np.uint64))
        return x & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.upper[i] << np.uint64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The position of each value (within [lo, hi) if given), -1 where it is not there."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        top = x >> np.uint64(self.low_bits)
        open_ = np.flatnonzero(top < self.buckets)
        t = top[open_].astype(np.int64)
        a, b = self.first[t], self.first[t + 1]
        if lo is not None:
            a, b = np.maximum(a, lo[open_]), np.minimum(b, hi[open_])
        want = x[open_] & np.uint64((1 << self.low_bits) - 1)
        stop = b.copy()
        while True:  # binary successor search on the low bits, all queries at once
            run = a < b
            if not run.any():
                break
            mid = (a + b) >> 1
            less = run.copy()
            less[run] = self._low(mid[run]) < want[run]
            a = np.where(less, mid + 1, a)
            b = np.where(run & ~less, mid, b)
        ok = a < stop
        ok[ok] = self._low(a[ok]) == want[ok]
        out[open_[ok]] = a[ok]
        return out


class Trie:
    def __init__(self, data):
        view, at, levels = memoryview(data), 0, []
        for _ in range(4):
            level, at = EliasFano.load(view, at)
            levels.append(level)
        self.contexts, self.words, self.pointers, self.successors = levels
        self.codes = np.frombuffer(view, np.uint8, self.successors.n, at)

    @staticmethod
    def pack(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> bytes:
        """counts: successors of each context; successors: context rank * len(words) + word rank, ascending."""
        pointers = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        return b"".join(
            [
                EliasFano.pack(contexts, 1 << 62),
                EliasFano.pack(words, 1 << 40),
                EliasFano.pack(pointers, len(successors) + 1),
                EliasFano.pack(successors, max(1, len(contexts) * len(words))),
                codes.astype(np.uint8).tobytes(),
            ]
        )

    def query(self, contexts: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each pair, number of successors of each context); owner: the index in contexts of each pair."""
        rank = self.contexts.find(contexts)
        known = rank >= 0
        begin, end = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        begin[known] = self.pointers.get(rank[known]).astype(np.int64)
        end[known] = self.pointers.get(rank[known] + 1).astype(np.int64)
        word = self.words.find(words)
        out = np.zeros(len(words), np.uint8)
        ask = np.flatnonzero((word >= 0) & known[owner])
        own = owner[ask]
        at = self.successors.find(rank[own].astype(np.uint64) * np.uint64(self.words.n) + word[ask].astype(np.uint64), begin[own], end[own])
        out[ask[at >= 0]] = self.codes[at[at >= 0]]
        return out, end - begin


def encode(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities in (0, 1]."""
    return np.clip(np.rint(-np.log10(p) * CODE_STEPS), 0, 254).astype(np.uint8) + np.uint8(1)


def decode(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, 10.0 ** ((1.0 - code.astype(np.float64)) / CODE_STEPS))
