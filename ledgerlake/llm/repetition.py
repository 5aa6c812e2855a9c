"""Quality rules on repetition: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

For n of ``LENGTHS`` a rolling 64-bit hash of every n consecutive words is taken; words inside any
window that comes twice or more within its text are covered, and the share of word characters
covered is compared with the limit for n. A longer window can only repeat where its shorter
beginning does, so each length looks at what the length before has left. Lines are hashed whole;
the word characters of lines equal to an earlier line of the text are compared with ``LINE_CHARS``. Hashes
have 64 bits, salted by text: two unlike windows or lines of one text would have to collide to be miscounted.

Inputs and defined results
- null, empty or wordless texts: all counts 0, base_failed true (fewer than ``MIN_WORDS`` words), kept false.
- very long texts are whole; memory follows one piece of texts (``vectext.PIECE_BYTES``) or one longer text.
- ties, repeated rows and null doc_id: each row is judged alone and returned with its id.
- empty tables: no rows. Extra columns of any name are ignored by ``measure`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlake.llm import scratch
from ledgerlake.llm import vectext as V

BASE_WINDOW = 5
MIN_WORDS = 10
BASE_PERCENT = 20
#: Windows of so many words, and the most of a text's word characters that may lie in repeated ones.
LENGTHS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS = 0.20
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DDL = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "dup_line_chars long", *(f"dup_chars_{n} long" for n in LENGTHS), "base_failed boolean", "kept boolean"])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key comes more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(k), bool)
    out[order] = twice
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key came before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros(len(k), bool)
    out[order[1:]] = k[1:] == k[:-1]
    return out


def measures(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(off) - 1
    starts, ends, counts = V.word_spans(raw, off)
    doc = np.repeat(np.arange(n), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    inked = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(((raw & 0xC0) != 0x80) & ~V.SPACE[raw], out=inked[1:])
    sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    out = {"n_words": counts, "word_chars": sums(chars, first), "n_symbols": V.per_text(SYMBOL[raw], off)}

    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    cut[1:] |= np.concatenate([raw == 10])
    at = np.flatnonzero(cut[: len(raw)])
    stop = np.concatenate([at[1:], [len(raw)]]).astype(np.int64)
    stop = np.where((stop > at) & (len(raw) > 0) & (raw[np.maximum(stop, 1) - 1] == 10), stop - 1, stop) if len(at) else stop[:0]
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, at) if len(at) else np.zeros(0, bool)
    at, stop = at[worded], stop[worded]
    line_doc = np.searchsorted(off, at, "right") - 1
    salt = V.mix(np.arange(n, dtype=np.uint64) + np.uint64(11))
    again = _later(V.span_hashes(raw, at, stop) ^ salt[line_doc])
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc[again], (inked[stop] - inked[at])[again], minlength=n).astype(np.int64)

    h = V.span_hashes(raw, starts, ends)
    ends_of = np.repeat(first[1:], counts)
    left = ends_of - np.arange(len(h))
    can = None
    for k in LENGTHS:
        w = V.window_hashes(h, k)
        pos = np.flatnonzero(left[: len(w)] >= k) if can is None else can[(can < len(w)) & (left[can] >= k)]
        twice = pos[_repeated(w[pos] ^ salt[doc[pos]])]
        edge = np.zeros(len(h) + 1, np.int64)
        edge[twice] += 1
        np.subtract.at(edge, twice + k, 1)
        inside = np.cumsum(edge)[: len(h)] > 0
        if k == BASE_WINDOW:
            out["n_repeat_words"] = sums(inside, first)
        out[f"dup_chars_{k}"] = sums(np.where(inside, chars, 0), first)
        can = twice
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each text."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    good = m["dup_line_chars"] <= LINE_CHARS * m["word_chars"]
    for k, most in LENGTHS.items():
        good &= m[f"dup_chars_{k}"] <= most * m["word_chars"]
    return failed, good & ~failed


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in V.pieces(batch, "text"):
            m = measures(*V.buffers(part.column(1)))
            failed, kept = verdict(m)
            cols = [part.column(0), *(pa.array(m[c].astype(np.int64)) for c in [*COUNTS, "dup_line_chars", *(f"dup_chars_{n}" for n in LENGTHS)]), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "dup_line_chars", *(f"dup_chars_{n}" for n in LENGTHS), "base_failed", "kept"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    scratch.lean_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_measured, DDL)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    scratch.lean_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.pieces(batch, "text"):
                yield part.filter(pa.array(verdict(measures(*V.buffers(part.column(at))))[1]))

    return docs.mapInArrow(run, docs.schema)
