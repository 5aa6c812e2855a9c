"""Token-ID shards with a minimal perfect hash index over document keys.

Texts are encoded with the tokenizers library, an end id is appended, and the ids of each range of
ascending doc_ids make one shard file of the shared folder. A file holds

    magic 8 bytes | uint64: documents, ids, distinct keys, levels, bytes per id |
    int64 first key per document (ascending), uint64 start per document and end |
    for each level of the hash: uint64 bits and words, its bitmap, uint64 ones before each block of it |
    uint64 document rank per hash slot, uint32 fingerprint per slot | raw little-endian ids

The hash is minimal and perfect: in each level a key whose bit no other key shares takes the rank of
that bit; the others go on to the next level. A stored fingerprint rejects keys that are not there.
``Shard.lookup`` answers keys in constant time, ``get`` a key of the whole store from its mapped shard; ``read`` goes
through the index for every document.

Inputs and defined results
- null or empty texts: the end id alone. Very long texts are whole.
- null doc_id: first, under the key -2**63; it is returned as null.
- repeated doc_ids: every row is written, neighbours in the order of their texts; the index leads to
  the first, the key column to the others.
- empty tables: no file, no rows. Extra columns of any name are ignored.

A file is written under a name of its task attempt and then renamed to that of its place in the order, so a task
that runs again replaces its own; the tables of the run name the files that count, and half-written ones are never read.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm import scratch
from ledgerlake.llm import vectext as V

MAGIC = b"LLTOKEN2"
END_ID = 0
SHARD_BYTES = 8 << 20
#: Words of 64 bits in a block of a level's bitmap.
BLOCK_WORDS = 8
#: Bytes of a task by Spark's estimate of the input; there are at least as many tasks as shuffle partitions.
TASK_BYTES = 64 << 20
#: Text bytes that are encoded at a time: their pieces are looked up together.
ENCODE_BYTES = 4 << 20
#: Pieces whose ids a worker remembers.
CACHE_PIECES = 160_000
#: A blank beside other white space, or a NUL, which marks heads here: such texts are encoded in one go.
_BESIDE = ["\0", "  ", *(x for c in map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) for x in (f" {c}", f"{c} "))]
#: Fixed values of byte-level BPE: its settings, its split pattern, and the rule that gives each byte a visible character.
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A run of these after letters is a piece of its own.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_LEVEL_SALT = 0x9FB21C651E98DF25
NULL_KEY = -(2**63)


class Encoder:
    """Whole texts to ids; remembers the ids of pieces between single blanks.

    Byte-level pre-tokenisation always splits before a single blank that stands between two
    non-blank characters, so a text's ids are those of such pieces, one after the other. Texts with
    other white space around a blank are encoded in one go.
    """

    def __init__(self, tokenizer_path: str, dtype=np.uint16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = dtype if self.tokenizer.get_vocab_size() <= np.iinfo(dtype).max + 1 else np.uint32
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = json.loads(self.tokenizer.to_str())
        if level["normalizer"] or level["pre_tokenizer"] != _LEVEL or level["model"]["type"] != "BPE":
            self.special = [""]  # every text is encoded in one go
        self.code = {2: "H", 4: "I"}[np.dtype(self.dtype).itemsize]
        self.tails: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> list[int]:
        mapped = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.tokenize(mapped)]

    def _piece(self, lead: str, piece: str) -> bytes:
        """A piece without special tokens by the library's model, split as its byte-level pre-tokeniser does."""
        stem = piece.rstrip(_MARKS)
        if not stem.isalpha():
            return array(self.code, [i for word in _PATTERN.findall(lead + piece) for i in self._word(word)]).tobytes()
        name = stem if lead else "\0" + stem
        ids = self.young.get(name) or self.old.get(name)
        if ids is None:
            ids = self.young[name] = array(self.code, self._word(lead + stem)).tobytes()
        if len(stem) == len(piece):
            return ids
        tail = piece[len(stem) :]
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = array(self.code, self._word(tail)).tobytes()
        return ids + self.tails[tail]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; ``young`` and ``old`` hold the ids of pieces without their blank."""
        split: list[list[str] | None] = []
        beside = [*_BESIDE, *self.special]
        need: set[str] = set()
        for text in texts:
            if not text or text[0] == " " or text[-1] == " " or any(x in text for x in beside):
                split.append(None)
                continue
            pieces = text.split(" ")
            pieces[0] = "\0" + pieces[0]  # the head has no blank before it
            split.append(pieces)
            need.update(pieces)
        young, old = self.young, self.old
        missing = []
        for p in need - young.keys():
            got = old.get(p)
            if got is None:
                missing.append(p)
            else:
                young[p] = got
        for p in missing:
            young[p] = self._piece("", p[1:]) if p[0] == "\0" else self._piece(" ", p)
        out = [b"".join(map(young.__getitem__, pieces)) if pieces else self._plain(text) if text else b"" for text, pieces in zip(texts, split, strict=True)]
        if len(young) > CACHE_PIECES:  # what has not been asked for in two generations is forgotten
            self.old, self.young = young, {}
        return out


@functools.cache
def shared_encoder(tokenizer_path: str) -> Encoder:
    """One encoder for all tasks of a worker process: what one task has learnt serves the next."""
    return Encoder(tokenizer_path)


def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = V.mix(keys.view(np.uint64) + np.uint64((level + 1) * _LEVEL_SALT % 2**64))
    return ((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (V.mix(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class Level:
    """A level's bitmap with the number of ones before each block of it: a rank takes one block, whatever the size."""

    def __init__(self, bits: int, words: np.ndarray, before: np.ndarray):
        self.bits, self.words, self.before = bits, words, before

    @classmethod
    def of(cls, marks: np.ndarray) -> Level:
        words = np.zeros(-(-len(marks) // (64 * BLOCK_WORDS)) * BLOCK_WORDS, "<u8")
        packed = np.packbits(marks, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.uint64)
        return cls(len(marks), words, np.concatenate([[0], np.cumsum(ones)]).astype("<u8"))

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def test(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        word, block = at >> 6, at // (64 * BLOCK_WORDS)
        out = self.before[block].astype(np.int64)
        for k in range(BLOCK_WORDS - 1):
            w = block * BLOCK_WORDS + k
            out += np.where(w < word, np.bitwise_count(self.words[w]), 0)
        rest = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return out + np.bitwise_count(rest)


def build_hash(keys: np.ndarray) -> list[Level]:
    """The levels of a minimal perfect hash of distinct int64 keys."""
    levels, rest = [], keys
    while len(rest):
        bits = max(8, 2 * len(rest))
        at = _slots(rest, len(levels), bits)
        n = np.bincount(at.astype(np.int64), minlength=bits)
        levels.append(Level.of(n == 1))
        rest = rest[n[at.astype(np.int64)] > 1]
    return levels


def hash_slots(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level holds it; the work a key takes does not follow their number."""
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, level in enumerate(levels):
        if not len(open_):
            break
        at = _slots(keys[open_], k, level.bits).astype(np.int64)
        hit = level.test(at)
        out[open_[hit]] = base + level.rank(at[hit])
        base += level.ones
        open_ = open_[~hit]
    return out


def pack(keys: np.ndarray, lengths: np.ndarray, payload: bytes, width: int) -> bytes:
    """A shard file's bytes; keys ascend."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    distinct, first = np.unique(keys, return_index=True)
    levels = build_hash(distinct)
    slot = hash_slots(levels, distinct)
    prints, ranks = np.empty(len(distinct), np.uint32), np.empty(len(distinct), np.uint64)
    prints[slot], ranks[slot] = fingerprint(distinct), first
    out = [MAGIC, struct.pack("<5Q", len(keys), int(starts[-1]), len(distinct), len(levels), width), keys.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for level in levels:
        out += [struct.pack("<2Q", level.bits, len(level.words)), level.words.tobytes(), level.before.tobytes()]
    return b"".join([*out, ranks.astype("<u8").tobytes(), prints.astype("<u4").tobytes(), payload])


class Shard:
    """A shard file that has been read or mapped; raises ValueError if it isn't one."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n, self.n_ids, n_keys, n_levels, self.width = struct.unpack_from("<5Q", view, 8)
        at = 48

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(view, kind, k, at)
            at += got.nbytes
            return got

        self.keys, self.starts, self.levels = take("<i8", n), take("<u8", n + 1), []
        for _ in range(n_levels):
            bits, words = (int(x) for x in take("<u8", 2))
            self.levels.append(Level(bits, take("<u8", words), take("<u8", words // BLOCK_WORDS + 1)))
        self.ranks, self.prints = take("<u8", n_keys), take("<u4", n_keys)
        self.ids = take({2: "<u2", 4: "<u4"}[self.width], self.n_ids)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The (first) document rank of each key, -1 where it is not here."""
        slot = hash_slots(self.levels, keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.ranks[slot[ok]]
        return out

    def document(self, rank: int) -> np.ndarray:
        return self.ids[int(self.starts[rank]) : int(self.starts[rank + 1])]


def get(spark: SparkSession, path: str, doc_id: int | None) -> np.ndarray | None:
    """The ids of a document (the first of its id) by the index of its shard; None if it is not there."""
    key = NULL_KEY if doc_id is None else doc_id
    # a fingerprint of 32 bits may let a stranger pass: the key column has the last word
    for r in spark.read.parquet(f"{path}/shards").where((F.col("low") <= key) & (F.col("high") >= key)).select("file").orderBy("low", "file").collect():
        shard = Shard(_opened(f"{path}/files/{r['file']}"))
        rank = int(shard.lookup(np.array([key], np.int64))[0])
        if rank >= 0 and shard.keys[rank] == key:
            return shard.document(rank)
    return None


def _writer(tokenizer_path: str, where: str, shard_bytes: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(where)
        store.create_dir(folder, recursive=True)
        encoder = shared_encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        keys, lengths, body, size = [], [], [], 0
        part_id, k_file = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, lengths, body, size, k_file
            width = np.dtype(encoder.dtype).itemsize
            ids = np.array(keys, np.int64)
            name, attempt = f"{part_id:08d}-{k_file:06d}.tokens", f"{folder}/.{uuid.uuid4().hex}"
            k_file += 1
            with store.open_output_stream(attempt) as f:
                f.write(pack(ids, np.array(lengths, np.int64), b"".join(body), width))
            store.move(attempt, f"{folder}/{name}")
            row = [[name], [keys[0]], [keys[-1]], [len(keys)], [sum(lengths)]]
            keys, lengths, body, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(row[0]), *(pa.array(x, pa.int64()) for x in row[1:])], names=["file", "low", "high", "docs", "ids"])

        for batch in batches:
            for part in V.pieces(batch, "text", ENCODE_BYTES):
                ids = [NULL_KEY if k is None else k for k in part.column(0).to_pylist()]
                for k, x in zip(ids, encoder.encode_all([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    keys.append(k)
                    body.append(x + end)
                    lengths.append(len(body[-1]) // len(end))
                    size += len(body[-1])
                    if size >= shard_bytes:
                        yield flush()
        if keys:
            yield flush()
        V.release()

    return run


def _opened(uri: str):
    """A shard file, mapped where the store is local: only what is asked for is read."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    return pa.memory_map(name).read_buffer() if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name).read()


def _reader(where: str):
    """(file, base) to the file's documents; the files are read by the worker itself, so their bytes never pass the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(_opened(f"{where}/{name}"))
                distinct, copies = np.unique(s.keys, return_counts=True)
                first = s.lookup(distinct)  # the index leads to each key's first document
                if len(distinct) and (first < 0).any():
                    raise ValueError(f"{name}: a key is not in its index")
                ranks = np.repeat(first, copies) + (np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
                crc = [zlib.crc32(s.document(r).astype("<u4").tobytes()) for r in ranks]
                keys = np.repeat(distinct, copies)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=keys == NULL_KEY), pa.array(s.starts[ranks].astype(np.int64) + base), pa.array((s.starts[ranks + 1] - s.starts[ranks]).astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                del s
        V.release()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, shard_bytes: int = SHARD_BYTES, end_id: int = END_ID) -> DataFrame:
    """Write the shard files under ``path``/files; returns (and keeps under ``path``/shards) a row per file."""
    spark = docs.sparkSession
    scratch.lean_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Spark's own estimate, from the sizes of files: no pass over the texts; a plan of unknown size says 2**63 - 1
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES) if size < 1 << 60 else 1)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    files = ordered.mapInArrow(_writer(tokenizer_path, f"{path}/files", shard_bytes, end_id), "file string, low long, high long, docs long, ids long")
    files.write.parquet(f"{path}/shards")
    return spark.read.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each document as it is in the files that the shard table names: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(f"{path}/shards")
    earlier = Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))  # a row per file
    n = shards.count()
    spread = based.repartition(max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))), "file")
    return spread.mapInArrow(_reader(f"{path}/files"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer_path: str, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` as shard files and return their documents as read back."""
    path = path or scratch.new_dir(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, shard_bytes)
    return read(docs.sparkSession, path)
