"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

Two fixed permutations of the 32-bit universe give the whole signature: the first scatters the
shingle hashes, the second is applied after a circular shift of k steps for coordinate k. Bands of
``ROWS`` coordinates are bucket keys; with ``BANDS`` x ``ROWS`` = 48 x 6 a pair of similarity 0.8
shares no bucket with a chance below 5e-7, and every candidate is confirmed on its full shingle sets.

1. Documents with the same shingle set form a class; its smallest doc_id stands for it.
2. Each class is checked against the smallest class that it shares a bucket with (a star, one pair
   per class); the links found give preliminary components.
3. In buckets that still hold several components, those are noted that may belong together: buckets
   are streamed in blocks of at most ``BLOCK`` classes, which compare one byte of every coordinate; a
   similarity of 0.8 must be possible (six standard deviations below it). A block emits a spanning
   forest of such components, not its pairs. Members of a bucket's largest component are never
   compared with each other: only the others meet them, and one another.
4. The classes of components that may belong together come together once, in blocks with their full
   shingle sets; pairs in different components that pass the sketch are compared exactly, and links join
   components at once. Only links that joined something are emitted.
So no link between two components is lost. Of a bucket (or, in step 4, a super-component) with n classes, s of
them outside its largest component, each of the n goes to s / ``BLOCK`` blocks and each of the s to n / ``BLOCK``:
rows in proportion to n while s is small. If s grows with n, rows grow with n * s / ``BLOCK``.

Inputs and defined results
- null or empty texts, texts without words: n_shingles 0, linked with nothing, their own component, kept.
- fewer words than the shingle: the whole sequence is the one shingle. Very long texts are whole.
- null doc_id: takes no part; component_id null, kept true.
- repeated doc_ids count as one document with several texts: all of them have one component, and ``dedupe``
  keeps or drops them together; of rows with equal doc_id and text it keeps one.
- equal texts under different ids are one class, the smallest id is kept.
- empty tables: no rows. Extra columns of any name are ignored by ``link`` and kept by ``dedupe``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import scratch
from ledgerlake.llm import vectext as V
from ledgerlake.llm.components import components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 48, 6
#: The circular shift from one coordinate to the next, an odd number.
STEP = 0x9E3779B1
BLOCK = 512
#: How far below the wanted similarity the estimate from the coordinates may be.
SLACK = 0.16
_TILE = 512
SETS = "id long, set_key binary, shingles binary"
_SHIFTS = (np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)[:, None]


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of 32 bits."""
    x = x * np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xD35A2D97)
    x ^= x >> np.uint32(15)
    return x


def _permute(x: np.ndarray, t: np.ndarray) -> None:
    """The second permutation, in place; t is scratch of the same shape."""
    np.right_shift(x, np.uint32(16), out=t)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, np.uint32(15), out=t)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, np.uint32(0x846CA68B), out=x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of 64-bit shingle hashes."""
    first = _scatter((shingles >> np.uint64(32)).astype(np.uint32))
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(first), _TILE):
        x = first[None, i : i + _TILE] + _SHIFTS
        _permute(x, np.empty_like(x))
        np.minimum(out, x.min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(ROWS):
        h = V.mix(h ^ rows[:, k])
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> bytes:
    """One byte of every coordinate."""
    return (sig & np.uint32(0xFF)).astype(np.uint8).tobytes()


def shingle_sets(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, off = V.buffers(col)
    raw = V.LOWER[raw]
    starts, ends, counts = V.word_spans(raw, off)
    h = V.span_hashes(raw, starts, ends)
    w = V.window_hashes(h, size)
    at = 0
    for n in counts.tolist():
        if n >= size:
            yield V.distinct(w[at : at + n - size + 1])
        else:
            yield V.window_hashes(h[at : at + n], n) if n else w[:0]
        at += n


def _key(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.pieces(batch, "text"):
                n, key, band, brief = [], [], [], []
                for s in shingle_sets(part.column(1), size):
                    n.append(len(s))
                    key.append(_key(s.tobytes()))
                    sig = signature(s) if len(s) else None
                    band.append(None if sig is None else bands(sig))
                    brief.append(None if sig is None else sketch(sig))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(brief, pa.binary())], names=["doc_id", "n", "set_key", "bands", "sketch"])
        V.release()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.pieces(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_key, sets), pa.binary()), pa.array(sets, pa.binary())], names=["id", "set_key", "shingles"])
        V.release()

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _once(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``docs`` (doc_id, text) without equal rows; only rows of ids that repeat move for it."""
    if repeated is None:
        return docs
    return docs.join(repeated, "doc_id", "left_anti").unionByName(docs.join(repeated, "doc_id", "left_semi").distinct())


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    ids = pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = scratch.materialize(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(size), SETS), "sets")
    wide = pairs.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    return wide.select("u", "v", "a", "b").mapInArrow(_confirm(percent), "u long, v long")


def _likely(percent: int):
    """Of (u, v, a, b) those pairs whose sketches a and b may belong to similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(batch.column(k).cast(pa.binary(BANDS * ROWS)).buffers()[1], np.uint8).reshape(-1, BANDS * ROWS)[batch.column(k).offset :][: batch.num_rows] for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(axis=1) >= percent / 100 - SLACK))

    return run


def _runs(n_keys: int, handle):
    """A mapInArrow function over rows sorted by their first ``n_keys`` columns; ``handle`` takes one run's table and yields (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            keys = [table.column(k).to_numpy() for k in range(n_keys)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cut = [0, *change.tolist()]
            u, v = [], []
            for a, b in zip(cut, cut[1:], strict=False):
                if b - a > 1:
                    for x, y in handle(table.slice(a, b - a)):
                        u.append(x)
                        v.append(y)
            held = table.slice(cut[-1])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if held is not None and held.num_rows > 1:
            got = list(handle(held))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["u", "v"])

    return run


def _joined(percent: int, emit_roots: bool):
    """Handles a run of (key, i, j, block, id, n, root, sketch[, shingles]): links that join its local components."""
    least = (percent / 100 - SLACK) * BANDS * ROWS

    def handle(t: pa.Table) -> Iterator[tuple[int, int]]:
        ids, n, root, block = (t.column(c).to_numpy() for c in ("id", "n", "root", "block"))
        raw, _ = V.buffers(t.column("sketch"))
        brief = raw.reshape(-1, BANDS * ROWS)
        across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        sets = None if emit_roots else t.column("shingles").combine_chunks()
        known: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in known:
                known[i] = np.frombuffer(sets[i].as_buffer(), np.uint64)
            return known[i]

        label = root.copy()
        for k in range(len(ids) - 1):
            rest = slice(k + 1, None)
            ok = (label[rest] != label[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
            if across:
                ok &= block[rest] != block[k]
            at = np.flatnonzero(ok) + k + 1
            if not len(at):
                continue
            agree = (brief[at] == brief[k]).sum(axis=1)
            order = np.argsort(-agree, kind="stable")
            for j in at[order[agree[order] >= least]].tolist():
                if label[j] == label[k]:
                    continue
                if not emit_roots:
                    x, y = shingles(k), shingles(j)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both < percent * (len(x) + len(y) - both):
                        continue
                yield (root[k], root[j]) if emit_roots else (ids[k], ids[j])
                label[label == label[j]] = label[k]

    return handle


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, id, root, ...) with block, i, j: runs (key, i, j) in which all pairs of different roots meet, each pair once.

    Rows of a key's largest root are in blocks -1, -2, ..., the others in 0, 1, ...; a run takes one block of the
    others and another block of either kind (or that block alone).
    """
    per = rows.groupBy(key, "root").agg(F.count("*").alias("k"))
    per = per.groupBy(key).agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("n"))
    n_rest = F.col("n") - F.col("top.k")
    per = per.where(n_rest > 0).select(key, F.col("top.root").alias("main"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("mains"), F.ceil(n_rest / BLOCK).cast("int").alias("rests"))
    rows = rows.join(per, key)
    at = lambda n: F.pmod(F.xxhash64("id", key), F.col(n)).cast("int")
    rows = rows.withColumn("block", F.when(F.col("root") == F.col("main"), -1 - at("mains")).otherwise(at("rests")))
    rests = F.sequence(F.lit(0), F.col("rests") - 1)
    meets = F.when(F.col("block") < 0, rests).otherwise(F.concat(F.sequence(F.lit(-1), -F.col("mains")), rests))
    rows = rows.withColumn("other", F.explode(meets))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "main", "mains", "rests")


def _links(members: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Steps 3 and 4: links (u, v) that join preliminary components."""
    brief = classes.select("id", "set_key", "n", "sketch")
    roots = roots.withColumnRenamed("node", "id")
    rooted = lambda df: df.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = rooted(members.select("bucket", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    placed = scratch.materialize(placed.join(mixed, "bucket"), "placed")
    rows = _in_blocks(placed, "bucket").join(brief, "id").select("bucket", "i", "j", "block", "id", "n", "root", "sketch")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    maybe = components(rows.mapInArrow(_runs(3, _joined(percent, True)), "u long, v long"))
    near = rooted(classes.select("id")).join(maybe.select(F.col("node").alias("root"), F.col("root").alias("super")), "root")
    near = scratch.materialize(near.select("super", "id", "root").distinct(), "near")
    ids = near.select(F.col("id").alias("doc_id"))
    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(size), SETS)
    whole = scratch.materialize(near.join(brief, "id").join(sets, ["id", "set_key"]), "sets")
    rows = _in_blocks(whole, "super").select("super", "i", "j", "block", "id", "n", "root", "sketch", "shingles")
    rows = rows.repartition("super", "i", "j").sortWithinPartitions("super", "i", "j")
    return rows.mapInArrow(_runs(3, _joined(percent, False)), "u long, v long")


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    if percent < PERCENT:
        raise ValueError(f"the bands find pairs of {PERCENT} % or more")
    scratch.lean_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.materialize(docs.mapInArrow(_signed(size), "doc_id long, n long, set_key binary, bands array<long>, sketch binary"), "signed")
    known = signed.where("doc_id is not null and set_key is not null")
    repeated = scratch.materialize(known.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "repeated")
    repeats = not repeated.isEmpty()
    docs = _once(docs, repeated if repeats else None)
    named = known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    # a class's signature is that of the row with its smallest id; a repeated id gives its rows' classes one name
    classes = scratch.materialize(known.join(named, "set_key").where("doc_id = id").select("id", "n", "set_key", "bands", "sketch").dropDuplicates(["id", "set_key"]), "classes")
    rows = classes.select("id", "n", F.explode("bands").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("k")).where("k > 1").select("bucket", "head")
    members = scratch.materialize(rows.join(heads, "bucket"), "members")
    near = F.expr(f"100 * least(n, head.n) >= {percent} * greatest(n, head.n)")
    star = members.where("id <> head.id").where(near).groupBy("id").agg(F.min("head.id").alias("u")).select("u", F.col("id").alias("v"))
    brief = classes.select("id", "sketch")
    star = star.join(brief.withColumnsRenamed({"id": "v", "sketch": "b"}), "v").join(brief.withColumnsRenamed({"id": "u", "sketch": "a"}), "u")
    star = scratch.materialize(star.select("u", "v", "a", "b").mapInArrow(_likely(percent), "u long, v long"), "star")
    joined = _verified(star, docs, size, percent)
    if repeats:  # the classes of one doc_id belong together
        joined = joined.unionAll(known.join(repeated, "doc_id", "left_semi").join(named, "set_key").where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).distinct())
    roots = components(joined)
    more = _links(members, classes, roots, docs, size, percent)
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more))
    ids = named.select("set_key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    return (
        signed.select("doc_id", "n", "set_key")
        .join(ids, "set_key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def dedupe(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept, with all their columns."""
    linked = scratch.materialize(link(docs, size, percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("kept").alias("_kept"), F.count("*").alias("_k")).where("not _kept or _k > 1"), "gone")
    again = linked.where("_kept")
    rest = docs.join(linked, docs["doc_id"] == linked["_id"], "left_anti")
    if again.isEmpty():
        return rest
    return rest.unionByName(docs.join(again, docs["doc_id"] == again["_id"], "left_semi").dropDuplicates(["doc_id", "text"]))
