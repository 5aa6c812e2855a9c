"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

``scan(docs, bench)`` reads every text once. Text is normalised (A-Z lower-cased, every other
ASCII byte that is no digit or letter a separator) and the automaton runs over its words, each a
number of the benchmark's vocabulary (0 for words that no item has); hits are mapped back to
character offsets of the original text.

Inputs and defined results
- null or empty texts, or texts without words: no hits, ``n_words`` 0; they are returned. Very long texts are whole.
- items that are null or have no words: no window. Items of fewer than ``window`` words: one window.
- repeated documents or items: each document row is returned once for each time it comes; equal
  items both count. Null doc_id or item_id: the former is returned as null, the latter is no item.
- empty tables: no rows, or rows without hits. Extra columns of any name are ignored by ``scan`` and kept by ``clean``.

Memory follows the number of the automaton's nodes, a node per word of a window at most: items are cut
into slices and dealt into blocks of about ``MAX_NODES`` nodes (some 50 bytes each). With several blocks they are
taken in turn: a block is sent to the executors, all documents are scanned for it, its hits are written, and
it is destroyed before the next. A worker builds a block's automaton once and keeps one at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import scratch
from ledgerlake.llm import vectext as V

WINDOW = 10
MAX_NODES = 1_500_000
#: Words of an item in a slice, at most; windows across the cut are in the earlier slice.
SLICE_WORDS = 10_000
#: Lower-cases A-Z and makes every ASCII byte that is not 0-9 or a-z a blank; bytes of longer characters stay.
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string())), ("text_key", pa.int64())])
_SPAN_DDL = "struct<first_word:bigint,words:bigint,start:bigint,end:bigint>"
FOUND_DDL = f"doc_id long, n_words long, spans array<{_SPAN_DDL}>, items array<string>, text_key long"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Windows:
    """The automaton of some items; ``vocabulary`` numbers their words from 1."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        import ahocorasick

        self.vocabulary: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.owners: list[tuple[int, frozenset[str]]] = []  # (words, items) that patterns share
        number: dict[tuple[int, frozenset[str]], int] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)] if item is not None else []
            for i in range(max(1, len(w) - window + 1) if w else 0):
                key = tuple(w[i : i + window])
                old = self.automaton.get(key, None)
                have = (len(key), (self.owners[old][1] if old is not None else frozenset()) | {str(item)})
                if have not in number:
                    number[have] = len(self.owners)
                    self.owners.append(have)
                if old != number[have]:
                    self.automaton.add_word(key, number[have])
        if self.owners:
            self.automaton.make_automaton()

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs (first word, words) that are hit, and the items found."""
        if not w or not self.owners:
            return [], set()
        runs, found = [], set()
        get = self.vocabulary.get
        for end, k in self.automaton.iter(tuple([get(x, 0) for x in w])):
            runs.append((end + 1 - self.owners[k][0], end + 1))
            found.add(k)
        merged: list[list[int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, b - a) for a, b in merged], set().union(*(self.owners[k][1] for k in found))


_built: dict[object, Windows] = {}


def _of_block(block: tuple, window: int) -> Windows:
    """The block's automaton, built once per worker process; the one before is forgotten."""
    name, shared = block
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = Windows(shared.value, window)
    return _built[name, window]


def scanner(block, window: int, only_hits: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of_block(block, window)
        for batch in batches:
            for part in V.pieces(batch, "text"):
                rows: dict[str, list] = {k: [] for k in FOUND.names}
                for doc, value, key in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    text = value.as_py()
                    w = words(text)
                    runs, items = found.hits(w)
                    if only_hits and not runs:
                        continue
                    spans = []
                    if runs:
                        at = [m.span() for m in _WORD.finditer(text)]
                        spans = [{"first_word": a, "words": k, "start": at[a][0], "end": at[a + k - 1][1]} for a, k in runs]
                    for k, v in zip(FOUND.names, (doc, len(w), spans, sorted(items), key), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=FOUND)
        V.release()

    return run


def _merged(spans: F.Column) -> F.Column:
    """Runs of several blocks, united where they touch."""
    end = lambda x: x["first_word"] + x["words"]

    def step(done, x):
        last = F.element_at(done, -1)
        both = F.struct(last["first_word"].alias("first_word"), (F.greatest(end(last), end(x)) - last["first_word"]).alias("words"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touch = (F.size(done) > 0) & (x["first_word"] <= end(last))
        return F.when(touch, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as array<{_SPAN_DDL}>)"), step)


def _slices(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, str, int]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                for k, i in enumerate(range(0, max(1, len(w) - window + 1) if w else 0, SLICE_WORDS)):
                    some = w[i : i + SLICE_WORDS + window - 1]
                    out.append((item, k, b" ".join(some).decode("utf-8", "surrogatepass"), (max(1, len(some) - window + 1)) * min(window, len(some))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["item", "k", "text", "nodes"])

    return run


def _blocks(bench: DataFrame, window: int, max_nodes: int) -> tuple[DataFrame, int]:
    """The items' slices with their block, and the number of blocks."""
    items = bench.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    cut = scratch.materialize(items.mapInArrow(_slices(window), "item string, k long, text string, nodes long"), "items")
    n = max(1, -(-(cut.agg(F.sum("nodes")).first()[0] or 0) // max_nodes))
    return cut.withColumn("block", F.pmod(F.xxhash64("item", "k", "text"), F.lit(n))), n


def _shared(slices: DataFrame, k: int):
    """(a name, block k as a broadcast): bounded, because its nodes are."""
    return uuid.uuid4().hex, slices.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in slices.where(F.col("block") == k).select("item", "text").toLocalIterator()])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def _found_in_turn(docs: DataFrame, slices: DataFrame, n: int, window: int) -> DataFrame:
    """The hits of several blocks, a row per (doc_id, text_key) that has any; equal rows have equal hits."""
    every = None
    for k in range(n):
        shared = _shared(slices, k)
        got = scratch.materialize(_keyed(docs).mapInArrow(scanner(shared, window, True), FOUND_DDL), "hits")
        shared[1].destroy()
        every = got if every is None else every.unionAll(got)
    together = every.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return together.withColumn("spans", _merged("spans"))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words(v.as_py())) for v in batch.column(1)], pa.int64()), batch.column(2)], names=["doc_id", "n_words", "text_key"])


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_nodes: int = MAX_NODES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (hit runs: words and original character offsets), items."""
    scratch.lean_batches(docs.sparkSession)
    slices, n = _blocks(bench, window, max_nodes)
    if n == 1:
        return _keyed(docs).mapInArrow(scanner(_shared(slices, 0), window), FOUND_DDL).drop("text_key")
    found = scratch.materialize(_found_in_turn(docs, slices, n, window), "found").withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    rows = _keyed(docs).mapInArrow(_words_of, "doc_id long, n_words long, text_key long")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")
    return rows.select("doc_id", "n_words", F.coalesce("spans", none(_SPAN_DDL)).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def digest_items(items: list[object]) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


def report(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_nodes: int = MAX_NODES) -> DataFrame:
    """The documents without any hit, with all their columns; with one block no row moves."""
    scratch.lean_batches(docs.sparkSession)
    at = docs.columns.index("text")
    slices, n = _blocks(bench, window, max_nodes)
    if n > 1:
        bad = scratch.materialize(_found_in_turn(docs, slices, n, window).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")), "found")
        return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")
    shared = _shared(slices, 0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _of_block(shared, window)
        for batch in batches:
            bad = [bool(found.hits(words(v.as_py()))[0]) for v in batch.column(at)]
            yield batch.filter(pa.array([not b for b in bad], pa.bool_()))
        V.release()

    return docs.mapInArrow(keep, docs.schema)
