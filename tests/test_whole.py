"""Queries over all of their input, held against plain Python."""

import math
import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from ledgerlake import queries
from ledgerlake.operators import plugins, predict

SF = "/root/testdata/sf0.001"


def brute_prices(rows, targets):
    """Every day's graph of all pairs' latest prices."""
    last = {(b, q, d): r for s, d, b, q, r in sorted(rows)}
    out = []
    for day in sorted({r[1] for r in rows}):
        at = {}
        for (b, q, d), r in sorted(last.items(), key=lambda x: x[0][2]):
            if d <= day:
                at[b, q] = (r, (day - d).days)
        edges = pd.DataFrame([(b, q, r, n) for (b, q), (r, n) in at.items()], columns=["base", "quote", "rate", "days"])
        direct = {k for k, (_, n) in at.items() if n == 0}
        out += [(day, c, t, round(r, 9)) for c, t, r, fresh in plugins.best_rates(edges, targets) if fresh and (c, t) not in direct]
    return sorted(out)


def test_completed_prices(spark):
    rng, rows = random.Random(5), []
    pairs = [("USD", "EUR"), ("GBP", "USD"), ("GBP", "EUR"), ("CHF", "GBP"), ("CHF", "USD"), ("USD", "GBP"), ("EUR", "EUR"), ("LONE", "ALONE"), ("EUR", "L9"), *((f"L{k}", ("USD", "EUR", "GBP")[k % 3]) for k in range(6)), ("USD", "L7"), ("L7B", "L7C"), ("L7C", "CHF")]
    for k in range(160):
        b, q = rng.choice(pairs)
        rows.append((k, date(2024, 1, 1) + timedelta(days=rng.randrange(25)), b, q, 0.0 if k % 20 == 0 else rng.randrange(1, 400) / 100))
    df = spark.createDataFrame(rows, "seq long, date date, base string, quote string, rate double")
    for targets in (("EUR",), ("EUR", "USD")):
        got = sorted((r["date"], r["base"], r["quote"], round(r["rate"], 9)) for r in plugins.completed_prices(df, targets).collect())
        assert got == brute_prices(rows, targets) and len(got) > 100


def test_pricecompletion_holds_every_part(spark):
    got = queries.QUERIES["pricecompletion"](spark, SF)
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("concat('P', l_partkey) as base").distinct()
    assert parts.join(got, "base", "left_anti").count() == 0


def brute_predict(train, asked, k=10):
    """Every query against every training row: label, confidence, margin by seq of those that don't abstain."""
    w = predict.WEIGHTS

    def terms(r):
        out = Counter()
        for field, text in (("payee", r[2]), ("narration", r[3])):
            for x in predict.tokenize(text):
                out[field, x] += w[field]
        parts = r[4].split(":")
        for n in range(1, len(parts) + 1):
            out["account", tuple(parts[:n])] += w["account"]
        out["sign", r[5] < 0] += w["sign"]
        return out

    vectors = [terms(r) for r in train]
    df = Counter(x for v in vectors for x in v)
    idf = {x: math.log((1 + len(train)) / (1 + n)) + 1 for x, n in df.items()}

    def unit(v):
        v = {x: n * idf[x] for x, n in v.items() if x in idf}
        norm = math.sqrt(sum(n * n for n in v.values()))
        return {x: n / norm for x, n in v.items()}

    vectors, out = [unit(v) for v in vectors], {}
    for r in asked:
        u, near = unit(terms(r)), []
        for t, v in zip(train, vectors, strict=True):
            cos = sum(n * v.get(x, 0) for x, n in sorted(u.items(), key=str))
            if cos > 0:
                bonus = 0.25 if abs(t[5]) == abs(r[5]) and t[6] == r[6] else 0
                near.append((-round((cos + bonus) * 2 ** (-max((r[1] - t[1]).days, 0) / 365), 12), -t[1].toordinal(), t[7], t[0], cos))
        votes = {}
        for adj, day, label, _, cos in sorted(near)[:k]:
            v, m, d = votes.get(label, (0, 0, -9e9))
            votes[label] = (v - adj, max(m, cos), max(d, -day))
        ranked = sorted(votes.items(), key=lambda x: (-x[1][0], -x[1][2], x[0]))
        if ranked:
            v, conf, _ = ranked[0][1]
            margin = 1.0 if len(ranked) == 1 else (v - ranked[1][1][0]) / v
            if conf >= 0.3 and margin >= 0.1:
                out[r[0]] = (ranked[0][0], round(conf, 6), round(margin, 6))
    return out


def test_predict_is_that_of_all_pairs(spark):
    rng = random.Random(7)

    def row(n):
        kind = rng.randrange(4)
        label = f"Expenses:{kind if rng.random() < 0.7 else rng.randrange(4)}"
        return (n, date(2023, 1, 1) + timedelta(days=rng.randrange(400)), ("shop", "shop two", "bank", "rail")[kind], rng.choice(["buy", "sell", None]), "Assets:Cash", Decimal(rng.choice([-5, 5, 6, 7, 8, 9, 10, 11])), rng.choice(["USD", "EUR"]), label)

    rows = [row(n) for n in range(360)]
    df = spark.createDataFrame(rows, "seq long, date date, payee string, narration string, account string, number decimal(18,8), currency string, label string")
    got = {r["seq"]: (r["label"], round(r["confidence"], 6), round(r["margin"], 6)) for r in predict.predict(df.where("seq < 300"), df.where("seq >= 300").drop("label")).collect()}
    assert got == brute_predict(rows[:300], rows[300:]) and len(got) > 30


@pytest.mark.parametrize("name", ["a4_sum_position_lots", "f_value", "f_getprice", "q17_balances_at_cost", "b1_weight", "j6_fifo_overlap"])
def test_all_parts_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    whole = db.execute(queries.ORACLE[name])
    names = [x[0] for x in whole.description]
    want = sorted(map(str, whole.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*names).collect()) == want
