"""Whole Arrow text columns as numpy arrays: word spans, span hashes, window hashes.

Texts are never turned into Python strings here. Work goes in pieces of a bounded number of
bytes, so memory does not follow the length of a batch; only one very long line or document
makes a larger piece.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SEGMENT = 1 << 18
LONG_SPAN = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give freed memory back to the system: a worker that is idle between tasks keeps only what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        a = np.full(max(n, SEGMENT + 1), base, np.uint64)
        a[0] = 1
        _powers[name] = have = np.multiply.accumulate(a)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values: by a sort, which is far faster than ``np.unique`` without further results."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``limit`` text bytes."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``limit`` text bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, size = [], 0
    if held:
        got = pa.Table.from_batches(held).combine_chunks().to_batches()
        if got:
            yield got[0]


def word_spans(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words in each text) of the maximal runs of word bytes; none crosses texts."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    w = (~SPACE if is_word is None else is_word)[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | edge[1:n]
    end[:-1] &= ~w[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.diff(np.searchsorted(s, off))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + SEGMENT, "right")), i + 1)
        stop = int(ends[j - 1])
        if stop - base > LONG_SPAN:
            out[i] = int.from_bytes(hashlib.blake2b(raw[base:stop].tobytes(), digest_size=8).digest(), "little")
        else:
            c = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(_BYTE[raw[base:stop]] * _power(_P, "p", stop - base)[: stop - base], out=c[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (c[e] - c[s]) * _power(_P_INV, "i", stop - base)[s]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * _P))


def beginning_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """``span_hashes`` of each span (length 0) and of its first bytes, from one pass; shorter spans count whole."""
    out = [np.empty(len(starts), np.uint64) for _ in lengths]
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + SEGMENT, "right")), i + 1)
        stop = int(ends[j - 1])
        if stop - base > LONG_SPAN:
            for k, h in zip(lengths, out, strict=True):
                h[i] = span_hashes(raw, starts[i:j], ends[i:j] if k == 0 else starts[i:j] + k)[0]
            i = j
            continue
        c = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTE[raw[base:stop]] * _power(_P, "p", stop - base)[: stop - base], out=c[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        from_s, shift = c[s], _power(_P_INV, "i", stop - base)[s]
        for k, h in zip(lengths, out, strict=True):
            to = e if k == 0 else np.minimum(s + k, e)
            h[i:j] = mix(((c[to] - from_s) * shift) ^ ((to - s).astype(np.uint64) * _P))
        i = j
    return out


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values, len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, q = np.zeros(m, np.uint64), np.uint64(1)
    for k in range(n):
        out += h[k : k + m] * q
        q = np.uint64((int(q) * int(_Q)) & (2**64 - 1))
    return mix(out)


def windows_inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Positions whose window of ``n`` words stays within its text."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    left = np.repeat(ends, counts) - np.arange(total)
    return np.flatnonzero(left >= n)


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return np.diff(c[off])
