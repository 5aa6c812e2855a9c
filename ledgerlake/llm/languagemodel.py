"""LM scoring: a bigram model with absolute discounting, kept as Elias-Fano tries, one per shard of contexts.

p(w | c) = max(n(c,w) - D, 0) / n(c) + D * N1(c) / n(c) * p1(w), and p1(w) alone after an unseen c;
p1 is add-one over the training tokens. Counts cover all training documents, however many.

1. Texts are read once into blocks: the block's sorted distinct token keys, its training counts and
   the stream of local token numbers (written to the shared folder).
2. Token keys go to shards by range and come back as corpus counts, in the order they were asked.
3. Each block asks the shards for its distinct (context, word) pairs and gives its training counts
   with them. A shard adds up the counts, builds its trie, maps it from its file and answers every
   block's pairs by successor search: one byte per pair.
4. Each block sums the log probabilities of its documents.

No step holds more than a block or a shard. Shards are by key hash, and a context that has more than
a shard's share of all tokens is split over as many shards as it needs; the list of those contexts
has at most two entries per shard, so it can be broadcast.

Tokens are known by 64-bit hashes (within a context's shard by 40 bits of them).

Inputs and defined results
- null or empty texts: the end token alone. Very long texts are whole (a block is then one text).
- null doc_id: crc32 of the text 'null' decides whether it is held out; it is scored and returned.
- repeated rows: each counts in training and is scored. No training rows: N = V = 0, p1 is 1.
- empty tables: no rows. Extra columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import scratch
from ledgerlake.llm import vectext as V
from ledgerlake.llm.eliasfano import Trie, decode, encode

DISCOUNT = 0.75
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 8 << 20
VOCAB_SHARD, PAIR_SHARD = 1 << 20, 1 << 20
#: A context with more tokens than this is split; so there are at most two such contexts per shard.
SHARE = PAIR_SHARD // 2
END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64((1 << 62) - 1)
_KEY = np.uint64((1 << 62) - 1)
_ZSTD = pa.Codec("zstd", compression_level=1)

BLOCKS = "block long, n_vocab long, n_pairs long, vocab binary, counts binary, tokens binary, doc_ids array<long>, lens binary, train binary"


def _pack(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def _unpack(b, kind) -> np.ndarray:
    view = memoryview(b.as_buffer() if isinstance(b, pa.Scalar) else b)
    n = int.from_bytes(view[:8], "little")
    return np.frombuffer(_ZSTD.decompress(view[8:], n), kind) if n else np.zeros(0, kind)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part_id, k = TaskContext.get().partitionId(), 0
    for batch in V.gathered(batches, "text", BLOCK_BYTES):
        for part in V.pieces(batch, "text", BLOCK_BYTES):
            ids = part.column(0).to_pylist()
            raw, off = V.buffers(part.column(1))
            raw = V.LOWER[raw]
            starts, ends, counts = V.word_spans(raw, off)
            h = V.span_hashes(raw, starts, ends) & _KEY
            stop = np.cumsum(counts + 1) - 1  # the place of each text's end token
            keys = np.full(len(h) + len(counts), END & _KEY, np.uint64)
            word = np.ones(len(keys), bool)
            word[stop] = False
            keys[word] = h
            train = ~np.array([held_out(i) for i in ids], bool)
            vocab, tokens = np.unique(keys, return_inverse=True)
            seen = np.bincount(tokens[np.repeat(train, counts + 1)], minlength=len(vocab))
            row = [[(part_id << 32) + k], [len(vocab)], [len(keys)], [vocab.tobytes()], [seen.astype(np.uint32).tobytes()], [tokens.astype(np.uint32).tobytes()], [ids], [(counts + 1).astype(np.uint32).tobytes()], [train.astype(np.uint8).tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["block", "n_vocab", "n_pairs", "vocab", "counts", "tokens", "doc_ids", "lens", "train"])
            k += 1


def _cuts(vocab: np.ndarray, shards: int) -> np.ndarray:
    edge = np.array([(k << 62) // shards for k in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(vocab, edge), [len(vocab)]])


def _ask_vocab(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                v, c = np.frombuffer(vocab.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32)
                cut = _cuts(v, shards)
                some = [s for s in range(shards) if cut[s] < cut[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array([v[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary()), pa.array([c[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary())],
                    names=["shard", "block", "keys", "counts"],
                )

    return run


def _count_vocab(group: pa.Table) -> pa.Table:
    """The corpus counts of a shard's keys for each block; in the row of block -1 its totals and hot contexts."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("counts")]).astype(np.int64)
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts, minlength=len(every)).astype(np.uint64)
    shard = group.column("shard")[0].as_py()
    ends = np.cumsum([len(k) for k in keys])
    top = np.flatnonzero((total > SHARE) | (every == (END & _KEY)))
    answers = [total[at[e - len(k) : e]].tobytes() for k, e in zip(keys, ends, strict=True)]
    n = len(keys) + 1
    return pa.table(
        {
            "shard": pa.array([shard] * n, pa.int64()),
            "block": pa.array([*group.column("block").to_pylist(), -1], pa.int64()),
            "answer": pa.array([*answers, b""], pa.binary()),
            "distinct": pa.array([0] * (n - 1) + [int((total > 0).sum())], pa.int64()),
            "total": pa.array([0] * (n - 1) + [int(total.sum())], pa.int64()),
            "top_keys": pa.array([[]] * (n - 1) + [every[top].view(np.int64).tolist()], pa.list_(pa.int64())),
            "top_counts": pa.array([[]] * (n - 1) + [total[top].astype(np.int64).tolist()], pa.list_(pa.int64())),
        }
    )


class Layout:
    """A block's distinct pairs and contexts in the order in which they are asked, shard by shard."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, lens: np.ndarray, train: np.ndarray, shards: int, hot: dict[int, int]):
        size = np.uint64(len(vocab) + 1)
        before = np.empty(len(tokens), np.uint64)
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], np.cumsum(lens.astype(np.int64))[:-1]])] = len(vocab)
        pairs, inverse = np.unique(before * size + tokens, return_inverse=True)
        a, b = (pairs // size).astype(np.int64), (pairs % size).astype(np.int64)
        self.vocab = np.append(vocab, START)
        splits = np.ones(len(self.vocab), np.int64)
        for key, n in hot.items():
            i = np.searchsorted(self.vocab, np.uint64(key))
            if i < len(self.vocab) and self.vocab[i] == np.uint64(key):
                splits[i] = min(shards, n // SHARE + 1)
        home = lambda ctx, sub: (V.mix(self.vocab[ctx] + sub.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
        shard = home(a, ((vocab[b] >> np.uint64(41)) % splits[a].astype(np.uint64)).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        spread = np.flatnonzero((splits > 1) & (np.bincount(a, minlength=len(splits)) > 0))
        all_ctx = np.repeat(spread, splits[spread])
        all_sub = np.concatenate([np.arange(k) for k in splits[spread]]) if len(spread) else np.zeros(0, np.int64)
        at = shard[order] * int(size) + a[order]
        entries = V.distinct(np.concatenate([at, home(all_ctx, all_sub) * int(size) + all_ctx]))
        self.runs = np.diff(np.searchsorted(at, np.append(entries, np.iinfo(np.int64).max)))
        self.ctx, self.ctx_shard = entries % int(size), entries // int(size)
        self.word, self.pair_ctx = b[order], a[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.inverse, self.order = inverse, order
        self.counts = np.bincount(inverse, np.repeat(train, lens), minlength=len(pairs)).astype(np.int64)[order]


def _layout(row: dict, shards: int, hot: dict[int, int]) -> Layout:
    arr = lambda k, t: np.frombuffer(row[k].as_buffer(), t)
    return Layout(arr("vocab", np.uint64), arr("tokens", np.uint32), arr("lens", np.uint32), arr("train", np.uint8), shards, hot)


def _ask_pairs(shards: int, hot: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                x = _layout(row, shards, hot)
                ctx_cut = np.searchsorted(x.ctx_shard, np.arange(shards + 1))
                pair_cut = np.concatenate([[0], np.cumsum(x.runs)])[ctx_cut]
                words, keys = x.vocab[x.word], x.vocab[x.ctx]
                out: dict[str, list] = {n: [] for n in ("shard", "block", "ctx", "runs", "low", "high", "small", "large")}
                for s in range(shards):
                    c, p = slice(ctx_cut[s], ctx_cut[s + 1]), slice(pair_cut[s], pair_cut[s + 1])
                    if c.start == c.stop:
                        continue
                    n = x.counts[p]
                    big = np.flatnonzero(n > 254)
                    values = (s, row["block"].as_py(), _pack(keys[c]), _pack(x.runs[c].astype(np.uint32)), (words[p] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((words[p] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes(), _pack(np.minimum(n, 255).astype(np.uint8)), _pack(n[big].astype(np.uint64)))
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("shard", "block") else pa.binary()) for k, v in out.items()], names=list(out))

    return run


def _answer_pairs(where: str, hot: dict[int, int], discount: float):
    def run(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        get = lambda n, t, plain=False: [np.frombuffer(x.as_buffer(), t) if plain else _unpack(x, t) for x in group.column(n)]
        ctx, runs = get("ctx", np.uint64), get("runs", np.uint32)
        small, large = get("small", np.uint8), get("large", np.uint64)
        counts = []
        for s, big in zip(small, large, strict=True):
            n = s.astype(np.uint64)
            n[s == 255] = big
            counts.append(n)
        n_ctx, n_pair = [len(c) for c in ctx], [len(c) for c in counts]
        ctx, runs, counts = np.concatenate(ctx), np.concatenate(runs).astype(np.int64), np.concatenate(counts)
        word = np.concatenate(get("low", np.uint32, True)).astype(np.uint64) | np.concatenate(get("high", np.uint8, True)).astype(np.uint64) << np.uint64(32)
        owner = np.repeat(np.arange(len(ctx)), runs)
        got = np.flatnonzero(counts > 0)
        contexts, c_rank = np.unique(ctx[owner[got]], return_inverse=True)
        words, w_rank = np.unique(word[got], return_inverse=True)
        succ, at = np.unique(c_rank.astype(np.uint64) * np.uint64(max(1, len(words))) + w_rank.astype(np.uint64), return_inverse=True)
        n = np.bincount(at, counts[got].astype(np.float64), minlength=len(succ))
        who = (succ // np.uint64(max(1, len(words)))).astype(np.int64)
        total = np.bincount(who, n, minlength=len(contexts))
        for key, all_ in hot.items():
            i = np.searchsorted(contexts, np.uint64(key))
            if i < len(contexts) and contexts[i] == np.uint64(key):
                total[i] = all_
        codes = encode((n - discount) / total[who])
        data = Trie.pack(contexts, words, np.bincount(who, minlength=len(contexts)), succ, codes)
        del got, c_rank, w_rank, at, succ, n, who
        shard = group.column("shard")[0].as_py()
        store, folder = fs.FileSystem.from_uri(where)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{shard:06d}.trie"
        task = TaskContext.get()
        attempt = f"{name}.{task.taskAttemptId() if task else 0}"
        with store.open_output_stream(attempt) as f:
            f.write(data)
        store.move(attempt, name)
        local = isinstance(store, fs.LocalFileSystem)
        trie = Trie(pa.memory_map(name).read_buffer() if local else data)
        del data
        code, n1 = trie.query(ctx, owner, word)
        c_end, p_end = np.cumsum(n_ctx), np.cumsum(n_pair)
        return pa.table(
            {
                "shard": group.column("shard"),
                "block": group.column("block"),
                "codes": pa.array([_pack(code[e - k : e]) for e, k in zip(p_end, n_pair, strict=True)], pa.binary()),
                "n1": pa.array([_pack(n1[e - k : e].astype(np.uint32)) for e, k in zip(c_end, n_ctx, strict=True)], pa.binary()),
            }
        )

    return run


def _score(shards: int, hot: dict[int, int], n_train: int, n_distinct: int, n_docs: int, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                x = _layout(row, shards, hot)
                count = np.concatenate([np.frombuffer(p["answer"].as_buffer(), np.uint64) for p in row["vocab_answers"]]).astype(np.float64)
                replies = list(row["pair_answers"])
                code = np.concatenate([_unpack(p["codes"], np.uint8) for p in replies])
                n1 = np.bincount(x.ctx, np.concatenate([_unpack(p["n1"], np.uint32) for p in replies]), minlength=len(x.vocab))
                p1 = (count + 1) / (n_train + n_distinct + 1)
                seen = np.append(count, n_docs)
                back = np.where((seen > 0) & (n1 > 0), discount * n1 / np.maximum(seen, 1), 1.0)
                logs = np.log10(np.minimum(1.0, decode(code) + back[x.pair_ctx] * p1[x.word]))
                tokens, lens = np.frombuffer(row["tokens"].as_buffer(), np.uint32), np.frombuffer(row["lens"].as_buffer(), np.uint32)
                first = np.concatenate([[0], np.cumsum(lens.astype(np.int64))[:-1]])
                sums = lambda v: np.add.reduceat(v, first)  # noqa: E731  each text has its end token at least
                ids = row["doc_ids"].values
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.frombuffer(row["train"].as_buffer(), np.uint8) == 0), pa.array(lens.astype(np.int64)), pa.array(sums((count > 0)[tokens].astype(np.int64))), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(sums(np.log10(p1)[tokens])), pa.array(sums(logs[x.place][x.inverse]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, path: str | None = None, discount: float = DISCOUNT) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the tries stay under ``path``."""
    spark = docs.sparkSession
    path = path or scratch.new_dir(spark, "lm")
    blocks = scratch.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, BLOCKS), "blocks")
    n_vocab, n_pairs = blocks.agg(F.coalesce(F.sum("n_vocab"), F.lit(0)), F.coalesce(F.sum("n_pairs"), F.lit(0))).first()
    v_shards, p_shards = max(1, -(-n_vocab // VOCAB_SHARD)), max(1, -(-n_pairs // PAIR_SHARD))
    asked = blocks.select("block", "vocab", "counts").mapInArrow(_ask_vocab(v_shards), "shard long, block long, keys binary, counts binary")
    counted = scratch.materialize(asked.groupBy("shard").applyInArrow(_count_vocab, "shard long, block long, answer binary, distinct long, total long, top_keys array<long>, top_counts array<long>"), "counted")
    ends = counted.where("block = -1")
    n_train, n_distinct = ends.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    top = dict(map(tuple, ends.select(F.explode(F.arrays_zip("top_keys", "top_counts")).alias("x")).select("x.*").collect()))
    n_docs = top.pop(int(END & _KEY), 0)
    hot = {k: n for k, n in [*top.items(), (int(START), n_docs)] if n > SHARE}
    asked = blocks.select("block", "vocab", "tokens", "lens", "train").mapInArrow(_ask_pairs(p_shards, hot), "shard long, block long, ctx binary, runs binary, low binary, high binary, small binary, large binary")
    answered = scratch.materialize(asked.groupBy("shard").applyInArrow(_answer_pairs(f"{path}/tries", hot, discount), "shard long, block long, codes binary, n1 binary"), "answered")
    by_shard = lambda df, *cols: df.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", *cols))).alias("all"))  # noqa: E731  a block has one answer per shard
    joined = (
        blocks.select("block", "vocab", "tokens", "doc_ids", "lens", "train")
        .join(by_shard(counted.where("block >= 0"), "answer").withColumnRenamed("all", "vocab_answers"), "block")
        .join(by_shard(answered, "codes", "n1").withColumnRenamed("all", "pair_answers"), "block")
    )
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.mapInArrow(_score(p_shards, hot, n_train, n_distinct, n_docs, discount), out)
