import zlib

import numpy as np
import pytest

from ledgerlake.llm import toxicity

BAD = ["zorgl", "blixt", "frump"]


def corpus(n=3000, seed=7):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(20, 120))))
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), str(rng.choice(BAD)).upper() + str(rng.choice(["", "en", ","])))
        rows.append((i, " ".join(w), toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows if i % 2 == 0], "doc_id long, toxic int, quality int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_accuracy(scored):
    docs, labels, truth = scored
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    hit = sum(r["predicted"] for r in held if truth[r["doc_id"]])
    assert hit >= 0.9 * sum(truth[r["doc_id"]] for r in held)
    assert sum(r["predicted"] for r in held if not truth[r["doc_id"]]) <= 0.01 * len(held)


def test_held_out_labels_do_not_matter(scored):
    docs, labels, _ = scored
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 3) = 1 then 1 - toxic else toxic end as toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()}
    assert a == b


def test_odd_rows(scored, spark):
    docs, labels, _ = scored
    odd = spark.createDataFrame([(None, "zorgl blixt zorgl frump"), (1, None), (2, ""), (2, ""), (3, "  \n")], "doc_id long, text string")
    got = toxicity.score(odd, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert [r["score"] for r in toxicity.score(odd, none).collect()] == pytest.approx([0] * 5)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    kept = toxicity.keep(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def sparse(rng, n, size=40):
    return [np.unique(rng.integers(0, size, int(rng.integers(0, 9)))).astype(np.int32) for _ in range(n)]


def risk(w, b, pos, unl, prior):
    """The non-negative PU risk, row by row, and its second term before the correction."""
    z = lambda rows: np.array([sum(w[f] for f in r) + b for r in rows])
    p, u = z(pos), z(unl)
    rest = np.log1p(np.exp(u)).mean() - prior * np.log1p(np.exp(p)).mean()
    return prior * np.log1p(np.exp(-p)).mean() + max(0.0, rest), rest


def test_risk_and_gradient_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pos, unl = [np.append(x, 39).astype(np.int32) for x in sparse(rng, 30, 39)], sparse(rng, 200, 39)
    signs = set()
    for scale, bias, prior in ((0.3, -1.0, 0.1), (2.0, -4.0, 0.9), (0.0, 0.0, 0.5)):
        way = toxicity.Descent(pos, 40, prior)
        way.w = np.append(rng.normal(0, scale, 40), bias)
        if prior == 0.9:  # positives high and the others low: the correction sets in
            way.w[39] = 9.0
        table = spark.createDataFrame([(x.tobytes(), 2 if i < 50 else 1) for i, x in enumerate(unl[:150])], "features binary, n long")
        sums = toxicity._whole_sums(table, way.w[:-1], way.w[-1])
        whole = [*unl[:50], *unl[:150]]
        assert np.allclose(sums, toxicity._Rows(whole, 40).sums(way.w[:-1], way.w[-1]), atol=1e-3)
        g, r, rest = way.gradient(toxicity._Rows(whole, 40).sums(way.w[:-1], way.w[-1]))
        want, want_rest = risk(way.w[:-1], way.w[-1], pos, whole, prior)
        assert np.isclose(r, want) and np.isclose(rest, want_rest)
        signs.add(rest >= 0)
        for k in range(41):  # where the second term is negative, its gradient reversed is followed alone
            up, down = (risk(way.w[:-1] + d * (np.arange(40) == k), way.w[-1] + d * (k == 40), pos, whole, prior)[int(rest < 0)] for d in (1e-5, -1e-5))
            assert np.isclose(g[k], (up - down) / 2e-5 * (1 if rest >= 0 else -1), atol=1e-5)
    assert signs == {True, False}


def test_descent_finds_the_positive_feature():
    rng = np.random.default_rng(1)
    rows = lambda k, extra: [np.unique(np.concatenate([rng.integers(0, 50, 10), extra]).astype(np.int32)) for _ in range(k)]
    unl = toxicity._Rows([*rows(20, [100]), *rows(180, [101])], 102)
    way = toxicity.Descent(rows(60, [100]), 102, 0.1)
    for _ in range(100):
        way.step(unl.sums(way.w[:-1], way.w[-1]))
    assert way.w[100] > 0 and way.w[100] > way.w[101]


def test_calibration_gives_the_prior():
    rng = np.random.default_rng(4)
    x_u = np.concatenate([rng.normal(3, 1, 100), rng.normal(-3, 1, 900)])
    a, c = toxicity.calibrate(rng.normal(3, 1, 50), x_u, np.ones(1000), 0.1)
    s = 1 / (1 + np.exp(-(a * x_u + c)))
    assert np.isclose(s.mean(), 0.1, atol=1e-6) and s[:100].mean() > 0.8 and s[100:].mean() < 0.03
    assert toxicity.calibrate(np.zeros(0), x_u, np.ones(1000), 0.1) == (1.0, 0.0)


def test_repeated_ids_bring_no_more_rows(spark, scored, monkeypatch):
    docs, labels, truth = scored
    toxic = next(i for i, y in truth.items() if y and i % 2 == 0 and not toxicity.held_out(i))
    plain = next(i for i in truth if i % 2 and not toxicity.held_out(i))
    copies = spark.range(1000).drop("id").crossJoin(docs.where(docs["doc_id"].isin(toxic, plain)))
    many = docs.unionByName(copies)
    seen = []
    made = toxicity._Rows.__init__
    monkeypatch.setattr(toxicity._Rows, "__init__", lambda self, rows, *a: seen.append(len(rows)) or made(self, rows, *a))
    got = toxicity.score(many, labels.unionAll(labels), 0.7)
    assert max(seen) <= max(toxicity.POSITIVES, toxicity.UNLABELLED, toxicity.CHECKED)
    toxic_labels = sum(y for i, y in truth.items() if i % 2 == 0 and not toxicity.held_out(i))
    assert seen[0] < toxic_labels and got.count() == len(truth) + 2000


def test_very_long_text_and_extra_columns(spark, scored):
    docs, labels, _ = scored
    df = spark.createDataFrame([(10**9, "w1 " * 700_000 + "ZORGL", 1, "x"), (10**9 + 1, "w1", 0, "y")], "doc_id long, text string, key long, features string")
    whole = docs.select("doc_id", "text").unionByName(df.select("doc_id", "text"))
    assert toxicity.score(whole, labels).count() == docs.count() + 2
    assert toxicity.keep(df, labels.limit(0)).columns == df.columns
