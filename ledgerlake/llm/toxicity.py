"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier over hashed words and word beginnings.

Training sees confirmed toxic documents (positives) and all documents without their labels (unlabelled).
With class prior q the risk is  q * R+(P) + max(0, R-(U) - q * R-(P)); where the second term turns
negative, its gradient is reversed (the non-negative correction). The prior is the toxic share of all
labelled training rows, kept half a row away from 0 and 1. Rows whose crc32(doc_id) mod 3 is 1 are never learned from.

1. Every unlabelled row is counted: the features it has, of ``DIMENSIONS``. Only features are used that come in
   ``MIN_DOCS`` rows and whose share among the positives is ``SIGNIFICANT`` standard deviations off the unlabelled one.
2. Every unlabelled row is written down as the few used features that it has; equal rows become one with a count.
3. Adam minimises the risk: ``STEPS`` steps on a sample of the unlabelled rows as a beginning, then ``WHOLE_STEPS``
   steps whose gradient is summed over all unlabelled rows on the executors.
4. The margins are shifted so that the mean score of all unlabelled rows is the prior, and scaled for the least risk on them
   and on positives that 3 has not seen. Labelled negatives give the prior and nothing else.

Features: presence of each word (ASCII letters lower-cased, runs of letters, digits and non-ASCII
characters) and of its first 4 to 7 bytes, hashed. Small weights are dropped, so a score needs few lookups.

What reaches the driver: ``POSITIVES`` and ``CHECKED`` labelled rows at most (chosen by a hash of doc_id, one row
an id, used features only), ``UNLABELLED`` sampled rows for the beginning, and sums with a row per feature or
histogram bin. Sums are of whole numbers, so reruns agree.

Inputs and defined results
- null or empty texts, texts without known features: the score of the intercept. Very long texts are whole.
- null doc_id: scored, never learned from; crc32 of the text 'null' says whether it is held out.
- repeated rows: each is scored and counts as an unlabelled row; among the positives an id counts once (of unlike texts the
  one with the least features). A doc_id with several labels is toxic if one of them says so.
- no labelled positives, or empty tables: the score is the prior (0 without labels) for every row.
- extra columns of any name are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import scratch
from ledgerlake.llm import vectext as V

FOLDS, HELD_OUT = 3, 1
DIMENSIONS = 1 << 18
PREFIXES = (0, 4, 5, 6, 7)
POSITIVES, UNLABELLED, CHECKED = 3000, 6000, 1000
MIN_DOCS = 4
SIGNIFICANT = 4.0
STEPS, WHOLE_STEPS, RATE, DECAY = 150, 10, 0.15, 2e-4
SMALL = 0.15
#: Sums over rows are kept in units of 1 / UNIT, margins in bins of 1 / BINS.
UNIT, BINS = 1 << 20, 64
#: Scales of the margins that are tried.
SCALES = [2.0 ** (k / 4) for k in range(-12, 13)]
THRESHOLD = 0.7
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _held(ids: list[int | None]) -> np.ndarray:
    return np.array([held_out(i) for i in ids], bool)


def features(col: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(text number, feature) pairs, distinct and sorted, of those features that ``keep`` marks."""
    raw, off = V.buffers(col)
    raw = V.LOWER[raw]
    starts, ends, counts = V.word_spans(raw, off, _ALNUM)
    # (text, feature) in one number, of 32 bits where that is enough: it is sorted to find equal ones
    kind = np.uint32 if len(counts) * DIMENSIONS < 1 << 32 else np.uint64
    doc = np.repeat(np.arange(len(counts), dtype=kind) * kind(DIMENSIONS), counts)
    found = []
    for k, h in zip(PREFIXES, V.beginning_hashes(raw, starts, ends, PREFIXES), strict=True):
        f = (V.mix(h + np.uint64(k)) & np.uint64(DIMENSIONS - 1)).astype(kind)
        some = np.ones(len(f), bool) if k == 0 else ends - starts >= k
        if keep is not None:
            some &= keep[f]
        found.append(doc[some] + f[some])
    pairs = V.distinct(np.concatenate(found))
    return (pairs // kind(DIMENSIONS)).astype(np.int64), (pairs % kind(DIMENSIONS)).astype(np.int64), len(counts)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, doc_id, text) to (kind, doc_id, features)."""
    for batch in batches:
        for part in V.pieces(batch, "text"):
            doc, f, n = features(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _packed(doc, f, n)], names=["kind", "doc_id", "features"])
    V.release()


def _packed(doc: np.ndarray, f: np.ndarray, n: int) -> pa.Array:
    cut = np.searchsorted(doc, np.arange(n + 1))
    f = f.astype(np.int32)
    return pa.array([f[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) or (features) to (feature, n): how many rows have it; feature -1 counts the rows."""
    have, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        if batch.schema.names[0] == "features":
            f = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0)]
            have += np.bincount(np.concatenate([np.zeros(0, np.int32), *f]), minlength=DIMENSIONS)
            rows += batch.num_rows
            continue
        for part in V.pieces(batch, "text"):
            _, f, n = features(part.column(0))
            have += np.bincount(f, minlength=DIMENSIONS)
            rows += n
    at = np.flatnonzero(have)
    V.release()
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(have[at], rows))], names=["feature", "n"])


def _tallied(rows: DataFrame) -> tuple[np.ndarray, int]:
    got = rows.mapInArrow(_tally, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    out[got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _compact(used: np.ndarray):
    """(key, text) to (key, features): the places in ``used`` of the features that a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(DIMENSIONS, bool)
        keep[used] = True
        for batch in batches:
            for part in V.pieces(batch, "text"):
                doc, f, n = features(part.column(1), keep)
                yield pa.RecordBatch.from_arrays([part.column(0), _packed(doc, np.searchsorted(used, f), n)], names=["key", "features"])
        V.release()

    return run


def _inside(used: np.ndarray):
    """(kind, doc_id, features) to (kind, features): the places in ``used`` of those features that are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.searchsorted(used, f[np.isin(f, used)]).astype(np.int32).tobytes() for f in _arrays(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(some, pa.binary())], names=["kind", "features"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class _Rows:
    """Sparse presence rows, each with the number of times it comes."""

    def __init__(self, rows: list[np.ndarray], size: int, times: np.ndarray | None = None):
        self.size = size
        self.times = np.ones(len(rows)) if times is None else times.astype(np.float64)
        self.f = np.concatenate([np.zeros(0, np.int32), *rows])
        self.r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])

    def dot(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.r, w[self.f], minlength=len(self.times)) + b

    def sums(self, w: np.ndarray, b: float) -> np.ndarray:
        """Sums over the rows: of each feature's share in the gradient of softplus(margin), of its margin's share, of softplus, and the rows."""
        x = self.dot(w, b)
        g = _sigmoid(x) * self.times
        return np.concatenate([np.bincount(self.f, g[self.r], minlength=self.size), [g.sum(), (_softplus(x) * self.times).sum(), self.times.sum()]])


def _arrays(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in col]


def _sums_of(w: np.ndarray, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 3)
        for batch in batches:
            total += _Rows(_arrays(batch.column(0)), len(w), batch.column(1).to_numpy()).sums(w, b)
        v = np.rint(total * UNIT).astype(np.int64)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(v[at])], names=["place", "v"])

    return run


def _whole_sums(rows: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """``_Rows.sums`` over all rows (features, n) of a table."""
    got = rows.mapInArrow(_sums_of(w, b), "place long, v long").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(w) + 3)
    out[got.column("place").to_numpy()] = got.column("v").to_numpy() / UNIT
    return out


class Descent:
    """Adam on the non-negative PU risk with logistic loss; the unlabelled rows' sums are given for each step."""

    def __init__(self, positive: list[np.ndarray], size: int, prior: float):
        self.p, self.prior, self.t = _Rows(positive, size), prior, 0
        self.w = np.append(np.zeros(size), np.log(prior / (1 - prior)))  # the intercept last
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def gradient(self, u: np.ndarray) -> tuple[np.ndarray, float, float]:
        """(gradient, risk, the second term before the correction) where ``u`` are the unlabelled rows' sums."""
        p, q = self.p.sums(self.w[:-1], self.w[-1]), self.prior
        p, u = p / max(1.0, p[-1]), u / max(1.0, u[-1])
        mean = np.append(np.bincount(self.p.f, minlength=self.p.size), len(self.p.times)) / max(1, len(self.p.times))
        negative_part, positive_loss = u[-2] - q * p[-2], p[-2] - mean @ self.w  # softplus(-x) = softplus(x) - x
        if negative_part >= 0:
            g = u[:-2] - q * mean
        else:
            g = q * p[:-2] - u[:-2]
        return g, q * positive_loss + max(0.0, negative_part), negative_part

    def step(self, u: np.ndarray) -> None:
        g = self.gradient(u)[0]
        g[:-1] += DECAY * self.w[:-1]
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        self.w = self.w - RATE * fix * self.m / (np.sqrt(self.v) + 1e-8)


def calibrate(x_p: np.ndarray, x_u: np.ndarray, n_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(a, c) of the margins a * x + c; ``n_u``: how often each unlabelled margin comes.

    For each scale of ``SCALES`` the shift makes the unlabelled rows' mean score the prior, as it is where the risk
    is least; of the scales that of the least non-negative risk is taken.
    """
    n = float(n_u.sum())
    if not len(x_p) or not n:
        return 1.0, 0.0
    best = None
    for a in SCALES:
        low, high = -100.0 * a - 40, 100.0 * a + 40
        for _ in range(60):
            c = (low + high) / 2
            low, high = (low, c) if (_sigmoid(a * x_u + c) * n_u).sum() > prior * n else (c, high)
        rest = (_softplus(a * x_u + c) * n_u).sum() / n - prior * _softplus(a * x_p + c).mean()
        risk = prior * _softplus(-a * x_p - c).mean() + max(0.0, rest)
        if best is None or risk < best[0]:
            best = risk, a, c
    return best[1], best[2]


def _histogram(w: np.ndarray, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.clip(_Rows(_arrays(batch.column(0)), len(w)).dot(w, b), -100, 100)
            at, where = np.unique(np.rint(x * BINS).astype(np.int64), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(where, batch.column(1).to_numpy()).astype(np.int64))], names=["bin", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, checked: int = CHECKED) -> Model:
    scratch.lean_batches(docs.sparkSession)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT
    known = labels.where("doc_id is not null and toxic is not null").where(~held).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n_toxic, n = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    share = n_toxic / n if n else 0.0
    flat = Model(np.zeros(DIMENSIONS, np.float32), float(np.log(share / (1 - share))) if 0 < share < 1 else 40.0 if share else -40.0)
    if not n_toxic:
        return flat
    prior = min(max(share, 0.5 / n), 1 - 0.5 / n)
    half = F.pmod(F.xxhash64(F.lit(18), "doc_id"), F.lit(4)) == 0  # scale and shift are fitted on other positives than the weights
    some = lambda df, kind, k: df.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(k).select("doc_id", F.lit(kind).alias("kind"))
    toxic = known.where("toxic = 1")
    picked = some(toxic.where(~half), 0, positives).unionAll(some(toxic.where(half), 2, checked))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most positives + checked ids: a bound that does not follow the input
    rows = texts.join(F.broadcast(picked), "doc_id").select("kind", "doc_id", "text").mapInArrow(_extract, "kind int, doc_id long, features binary")
    rows = scratch.materialize(rows.groupBy("kind", "doc_id").agg(F.min("features").alias("features")), "positives")
    every = texts.where("doc_id is not null").where(~held)
    in_p, n_p = _tallied(rows.where("kind = 0").select("features"))
    in_u, n_u = _tallied(every.select("text"))
    if not n_p or not n_u:
        return flat
    usual = n_p * (in_u + 0.5) / (n_u + 1)
    used = np.flatnonzero((in_p + in_u >= MIN_DOCS) & (np.abs(in_p - usual) >= SIGNIFICANT * np.sqrt(usual + 0.5)))
    lean = scratch.materialize(every.select(F.xxhash64(F.lit(17), "doc_id").alias("key"), "text").mapInArrow(_compact(used), "key long, features binary"), "lean")
    counted = scratch.materialize(lean.groupBy("features").agg(F.count("*").alias("n")), "counted")
    got = rows.mapInArrow(_inside(used), "kind int, features binary").toArrow()
    inside, kind = _arrays(got.column("features")), got.column("kind").to_numpy()
    first = lean.orderBy("key", "features").limit(unlabelled).select("features").toArrow()
    way = Descent([x for x, k in zip(inside, kind, strict=True) if k == 0], len(used), prior)
    begin = _Rows(_arrays(first.column(0)), len(used))
    for _ in range(STEPS):
        way.step(begin.sums(way.w[:-1], way.w[-1]))
    for _ in range(WHOLE_STEPS):
        way.step(_whole_sums(counted, way.w[:-1], way.w[-1]))
    w, b = np.where(np.abs(way.w[:-1]) < SMALL, 0, way.w[:-1]), float(way.w[-1])
    seen = counted.mapInArrow(_histogram(w, b), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    x_p = _Rows([x for x, k in zip(inside, kind, strict=True) if k == 2], len(used)).dot(w, b)
    a, c = calibrate(x_p, seen.column("bin").to_numpy() / BINS, seen.column("n").to_numpy().astype(np.float64), prior)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w * a
    return Model(weights, b * a + c)


def predict(model: Model, col: pa.Array) -> np.ndarray:
    doc, f, n = features(col, model.weights != 0)
    return _sigmoid(np.bincount(doc, model.weights[f], minlength=n) + model.bias)


def _lean(model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights that are not 0: small enough to go with the task."""
    at = np.flatnonzero(model.weights)
    return at.astype(np.int32), model.weights[at], model.bias


def _full(lean: tuple[np.ndarray, np.ndarray, float]) -> Model:
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[lean[0]] = lean[1]
    return Model(weights, lean[2])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    lean = _lean(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _full(lean)
        for batch in batches:
            for part in V.pieces(batch, "text"):
                p = predict(model, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_held(part.column(0).to_pylist())), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        V.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    lean = _lean(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _full(lean)
        for batch in batches:
            for part in V.pieces(batch, "text"):
                yield part.filter(pa.array(predict(model, part.column(at)) < threshold))
        V.release()

    return docs.mapInArrow(run, docs.schema)
