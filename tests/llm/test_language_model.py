import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from ledgerlake.llm import languagemodel as lm
from ledgerlake.llm.eliasfano import EliasFano, Trie, decode
from tests.llm.brute import WORD, lower
from tests.llm.test_text_operators import SF, odd

END = "\0end"


def brute(docs, discount=lm.DISCOUNT):
    toks = [(d, [*WORD.findall(lower(t)), END]) for d, t in docs]
    out_of = [zlib.crc32(("null" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    uni, big = Counter(), Counter()
    for (_, w), held in zip(toks, out_of, strict=True):
        if not held:
            uni.update(w)
            big.update(zip([None, *w], w, strict=False))
    after, n1 = Counter(), Counter()
    for (a, _), n in big.items():
        after[a] += n
        n1[a] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)

    def p2(a, w):
        return max(big[a, w] - discount, 0) / after[a] + discount * n1[a] / after[a] * p1(w) if after[a] else p1(w)

    return [(d, held, len(w), sum(x in uni for x in w), n, sum(log10(p1(x)) for x in w), sum(log10(p2(a, x)) for a, x in zip([None, *w], w, strict=False))) for (d, w), held in zip(toks, out_of, strict=True)]


@pytest.mark.parametrize("which", ["odd", "documents", "shards"])
def test_scores(spark, monkeypatch, which):
    df = odd(spark).drop("bucket") if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    if which == "shards":  # many shards, split contexts (the functions go to the workers with these values)
        for k, x in {"VOCAB_SHARD": 3000, "PAIR_SHARD": 4000, "BLOCK_BYTES": 100_000}.items():
            monkeypatch.setattr(lm, k, x)
    want = sorted(brute([tuple(r) for r in df.select("doc_id", "text").collect()]), key=lambda r: r[0])
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=lambda r: r[0])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    a, b, n = np.array([g[6] for g in got]), np.array([w[6] for w in want]), np.array([g[2] for g in got])
    assert (np.abs(a - b) / n <= 0.5 / 32 + 1e-6).all()  # half a step of the quantised codes


def test_split_contexts_agree(monkeypatch):
    """A block's layout with split contexts asks each pair once, and each split context everywhere it may be."""
    rng = np.random.default_rng(3)
    keys = rng.zipf(1.3, 5000) % 700
    vocab, tokens = np.unique(lm.V.mix(keys.astype(np.uint64)) & lm._KEY, return_inverse=True)
    monkeypatch.setattr(lm, "SHARE", 50)
    hot = {int(vocab[i]): int(n) for i, n in enumerate(np.bincount(tokens)) if n > 50}
    x = lm.Layout(vocab, tokens.astype(np.uint32), np.array([5000], np.uint32), np.array([1], np.uint8), 16, hot)
    assert x.counts.sum() == 5000 and x.runs.sum() == len(x.counts) and (np.diff(x.ctx_shard) >= 0).all()
    assert (x.word[x.place][x.inverse] == tokens).all()
    assert len(np.unique(x.ctx_shard * 10**6 + x.ctx)) == len(x.ctx)


def test_elias_fano_and_trie():
    rng = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1 << 62), (1000, 1 << 40), (5000, 5001), (3000, 1 << 61)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        raw = EliasFano.pack(v, top)
        ef, end = EliasFano.load(memoryview(raw), 0)
        assert end == len(raw) and (ef.get(np.arange(len(v))) == v).all()
        assert (ef.find(v) == np.arange(len(v))).all()
        other = rng.integers(0, top, 500).astype(np.uint64)
        at = ef.find(other)
        assert ((at >= 0) == np.isin(other, v)).all()
    contexts, words = np.array([5, 9], np.uint64), np.array([1, 2, 7], np.uint64)
    t = Trie(Trie.pack(contexts, words, np.array([2, 1]), np.array([0, 2, 4], np.uint64), np.array([1, 33, 65])))
    code, n1 = t.query(np.array([9, 6, 5], np.uint64), np.array([0, 0, 1, 2, 2, 2]), np.array([2, 1, 1, 7, 8, 2], np.uint64))
    assert code.tolist() == [65, 0, 0, 33, 0, 0] and n1.tolist() == [1, 0, 2]
    assert np.allclose(decode(np.array([0, 1, 33])), [0, 1, 0.1])


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
