import datetime
from decimal import ROUND_HALF_UP, Decimal, getcontext

import pytest

from ledgerlake.operators import booking, passes, plugins, validate
from ledgerlake.plans.compiler import query
from ledgerlake.plans.syntax import QueryError, parse
from ledgerlake.sources import text

D = datetime.date
SAMPLE = """
option "title" "Home"
option "operating_currency" "USD"
2020-01-01 open Assets:Cash USD
2020-01-01 open Expenses:Food
2020-01-01 open Income:Salary
2020-01-01 commodity USD
  name: "Dollar"

2020-01-15 * "Shop" "Grocery" #food #weekly ^r1
  category: "groceries"
  Expenses:Food  10.00 USD
    category: "groceries"
  Assets:Cash

2021-06-01 * "Cafe" #food
  Expenses:Food  (2 + 3) * 1.5 USD
  Assets:Cash

2022-03-10 * "Work" "Salary"
  Assets:Cash  1,000.00 USD
  Income:Salary

2020-02-01 price EUR 1.10 USD
2020-03-01 price EUR 1.20 USD
2022-04-01 balance Assets:Cash 982.50 USD
2022-04-02 note Assets:Cash "a note"
2022-04-03 event "location" "Paris"
"""


@pytest.fixture(scope="module")
def ledger(spark):
    return booking.book(text.load_text(spark, SAMPLE))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_parse_and_book(ledger):
    got = rows(ledger.postings.orderBy("seq", "idx").select("account", "number", "currency"))
    assert got[:2] == [("Expenses:Food", Decimal(10), "USD"), ("Assets:Cash", Decimal(-10), "USD")]
    assert got[2][1] == Decimal("7.5") and got[5] == ("Income:Salary", Decimal(-1000), "USD")
    assert ledger.diagnostics.count() == 0 and ledger.options.title == "Home"


def test_queries(ledger):
    q = lambda s: rows(query(ledger, s))
    assert q("SELECT account, number(only('USD', sum(position))) AS n GROUP BY account ORDER BY account") == [("Assets:Cash", Decimal("982.5")), ("Expenses:Food", Decimal("17.5")), ("Income:Salary", Decimal(-1000))]
    assert q("SELECT date WHERE 'weekly' IN tags AND account ~ 'Food'") == [(D(2020, 1, 15),)]
    assert q("SELECT narration, payee WHERE year = 2021 AND number > 0") == [("Cafe", None)]
    assert q("SELECT str(meta('category')) AS c, str(any_meta('nope', 'dflt')) AS d WHERE account ~ 'Food' ORDER BY date LIMIT 1") == [("groceries", "dflt")]
    assert q("SELECT getprice('EUR', 'USD') AS a, getprice('USD', 'EUR', 2020-02-15) AS b, getprice('EUR', 'USD', 2019-01-01) AS c LIMIT 1") == [(Decimal("1.2"), Decimal("0.90909091"), None)]
    assert q("SELECT number(only('USD', balance)) AS b WHERE account = 'Assets:Cash' ORDER BY date") == [(Decimal(-10),), (Decimal("-17.5"),), (Decimal("982.5"),)]
    assert q("SELECT sum(number) AS s, count(number) AS n WHERE year = 1900") == [(Decimal(0), 0)]
    assert q("SELECT currency FROM commodities") == [("USD",)]
    assert q("SELECT type, description FROM events") == [("location", "Paris")]
    assert q("SELECT account, open.date AS o FROM accounts ORDER BY account LIMIT 1") == [("Assets:Cash", D(2020, 1, 1))]
    assert q("SELECT discrepancy, number(amount) AS n FROM balances") == [(None, Decimal("982.5"))]
    assert q("SELECT comment FROM notes") == [("a note",)]
    assert q("SELECT date_bin('1 month', 2020-03-31, 2020-01-31) AS a, date_bin('1 month', 2020-02-10, 2020-01-31) AS b, date_bin('0 days', 2020-02-10, 2020-01-31) AS c LIMIT 1") == [(D(2020, 3, 29), D(2020, 1, 31), None)]
    assert q("SELECT interval('12 months') = interval('1 year') AS e LIMIT 1") == [(False,)]
    assert q("SELECT maxwidth('aa bb  cc dd', 8) AS a, maxwidth('aa bb', 10) AS b, findfirst('w', tags) AS f WHERE 'weekly' IN tags LIMIT 1") == [("aa [...]", "aa bb", "weekly")]
    assert q("SELECT payee FROM transactions ORDER BY payee DESC LIMIT 2") == [(None,), ("Work",)]
    assert q("SELECT count(account) AS n FROM OPEN ON 2021-01-01 CLOSE ON 2022-01-01") == [(6,)]


@pytest.mark.parametrize("bad", ["SELECT", "SELECT a FROM", "SELECT account = 1 = 2", "SELECT nope", "SELECT account + 1", "SELECT sum(sum(number))", "SELECT date LIMIT x", "SELECT account, number GROUP BY account", "SELECT upper(1)", "SELECT 2020-13-01", "SELECT account WHERE sum(number) > 1", "SELECT account WHERE balance = balance"])
def test_bad_queries(ledger, bad):
    with pytest.raises(QueryError):
        query(ledger, bad)


def test_sugar():
    s = parse("BALANCES AT cost FROM year = 2020 WHERE account ~ 'x'")
    assert s.targets[1].expr.args[0].name == "cost" and len(s.group_by) == 2
    assert len(parse('JOURNAL "A" FROM CLOSE ON 2020-01-01').targets) == 7


def test_recovery_and_headers():
    p = text.parse_text('2020-01-01 open Assets:Cash\n2020-01-01 opne X\npushtag #t\n2020-01-02 * "n"\n  Assets:Cash 1 USD @@ 2 EUR\n  Assets:Cash -1 USD {1.5 # 2 EUR, 2020-01-01, "l"}\npoptag #t\n2020-13-01 close Assets:Cash\n2020-01-05 balance Assets:Cash 5.00 ~ 0.02 USD\n')
    assert [d["type"] for d in p.directives] == ["open", "transaction", "balance"] and len(p.diagnostics) == 2
    t = p.directives[1]
    assert t["tags"] == ["t"] and t["postings"][0]["price"]["is_total"] and t["postings"][1]["cost_spec"]["total"] == 2
    assert p.directives[2]["tolerance"] == Decimal("0.02") and p.directives[2]["scale"] == 2
    assert [d["type"] for d in text.parse_text(text.commented('; 2020-01-01 * "x"\n;   Assets:A 1 USD\n;   Assets:B\n')).directives] == ["transaction"]


def test_includes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "main.ledger").write_text('include "sub/*.ledger"\ninclude "none*.ledger"\n2020-01-01 open Assets:A\n')
    (tmp_path / "sub/a.ledger").write_text("2020-01-02 open Assets:B\n")
    got = text.gather(str(tmp_path / "main.ledger"))
    assert len(got) == 2 and [d["code"] for d in got[0].diagnostics] == ["include"]
    over = text.gather(str(tmp_path / "main.ledger"), {str(tmp_path / "sub/a.ledger"): "2020-01-02 open Assets:C\n2020-01-03 open Assets:D\n"})
    assert len(over[1].directives) == 2
    (tmp_path / "sub/a.ledger").write_text('include "../main.ledger"\n')
    with pytest.raises(text.LoadError):
        text.gather(str(tmp_path / "main.ledger"))
    (tmp_path / "sub/a.ledger").write_text("2020-01-02 open Assets:B\n2020-01-03 * \"x\"\n  Assets:B 1 USD\n  Assets:A -1 USD\n")
    assert text.read_files(spark, f"file://{tmp_path}/sub/*.ledger").count() == 3
    loaded = text.load_file(spark, str(tmp_path / "main.ledger"))
    assert loaded.postings.count() == 2 and loaded.diagnostics.where("code <> 'include'").count() == 0


LOTS = """
2020-01-01 open Assets:Stock STOCK "FIFO"
2020-01-01 open Assets:Strict
2020-01-01 open Assets:Cash
2020-01-01 open Income:Gains
2020-01-02 * "buy"
  Assets:Stock  10 STOCK {5.00 USD}
  Assets:Cash
2020-01-03 * "buy"
  Assets:Stock  10 STOCK {6.00 USD}
  Assets:Cash  -60.00 USD
2020-01-04 * "sell"
  Assets:Stock  -15 STOCK {} @ 7.00 USD
  Assets:Cash  105.00 USD
  Income:Gains
2020-01-05 * "deferred"
  Assets:Strict  4 ABC {}
  Assets:Cash  -100.00 USD
2020-01-06 * "none"
  Assets:Strict  -9 ABC {}
  Assets:Cash  1.00 USD
2020-01-07 * "total"
  Assets:Strict  4 ABC {{120.00 USD}}
  Assets:Cash
2020-01-08 * "ambiguous"
  Assets:Strict  -1 ABC {}
  Assets:Cash  1.00 USD
2020-01-09 * "both"
  Assets:Strict  -8 ABC {}
  Assets:Cash  220.00 USD
"""


def test_booking(spark):
    ledger = booking.book(text.load_text(spark, LOTS))
    codes = sorted(r[0] for r in ledger.diagnostics.select("code").collect())
    assert codes == ["ambiguous-lot", "exceeds-lots"]
    p = rows(ledger.postings.orderBy("seq", "idx").select("account", "number", "cost.number"))
    assert ("Assets:Stock", Decimal(-10), Decimal(5)) in p and ("Assets:Stock", Decimal(-5), Decimal(6)) in p
    assert ("Income:Gains", Decimal(-25), None) in p and ("Assets:Strict", Decimal(4), Decimal(25)) in p
    assert ("Assets:Strict", Decimal(-4), Decimal(25)) in p and ("Assets:Strict", Decimal(-4), Decimal(30)) in p
    gains = rows(booking.realised_gains(ledger.postings).select("gain"))
    assert sum(g[0] for g in gains) == Decimal(25)
    again = booking.book(ledger)
    assert sorted(map(str, rows(again.postings.select("seq", "account", "number")))) == sorted(map(str, rows(ledger.postings.select("seq", "account", "number"))))
    seq = ledger.postings.where("number = -15 or number = -10").agg({"seq": "max"}).first()[0]
    assert (Decimal(10), Decimal(0)) in [(r["before"], r["after"]) for r in booking.inspect(ledger, seq).collect() if r["currency"] == "STOCK"]


BAD = """
2024-01-01 open Assets:Cash USD
2024-01-01 open Assets:Cash
2024-01-01 open Equity:Open
2024-01-01 open Assets:Unused
2024-01-02 pad Assets:Cash Equity:Open
2024-01-10 * "mid"
  Assets:Cash  200.00 USD
  Equity:Open  -200.00 USD
2024-02-01 balance Assets:Cash 1000.00 USD
2024-02-02 * "bad"
  Assets:Cash  10.00 USD
  Equity:Open  -9.00 USD
2024-02-03 * "eur"
  Assets:Cash  1.00 EUR
  Equity:Open  -1.00 EUR
2024-02-04 * "never"
  Assets:Never  1.00 USD
  Equity:Open  -1.00 USD
2024-03-01 balance Assets:Cash 5.00 USD
2024-03-01 balance Assets:Cash 6.00 USD
"""


def test_validation(spark):
    got = passes.run(booking.book(text.load_text(spark, BAD)), [("x.nounused", None), ("nope", None)])
    pads = rows(got.postings.where("flag = 'P'").orderBy("idx").select("account", "number"))
    assert pads == [("Assets:Cash", Decimal(800)), ("Equity:Open", Decimal(-800))]
    codes = sorted(r[0] for r in got.diagnostics.select("code").collect())
    assert codes == ["balance-mismatch", "balance-mismatch", "currency-constraint", "duplicate-balance", "duplicate-open", "inactive-account", "transaction-unbalanced", "unknown-plugin", "unused-account"]


PLUG = """
option "operating_currency" "USD"
2020-01-01 open Assets:A
  region: "eu"
2020-01-01 open Assets:A:B
2020-01-01 open Assets:A:B:C
2020-01-02 * "t" #virtual
  Assets:A:B:C  1.00 USD
  Assets:A  -1.00 USD
2020-01-03 * "x"
  Assets:A:B:C  2 STOCK {10.00 USD}
  Assets:New  -20.00 USD
2020-01-04 * "x"
  Assets:A:B:C  3 STOCK @ 11.00 USD
  Assets:New  -33.00 USD
2020-01-04 * "again"
  Assets:New  -33.00 USD
  Assets:A:B:C  3 STOCK @ 11.00 USD
2020-01-05 price EUR 1.10 USD
2020-01-05 price EUR 1.20 USD
2020-01-05 price CHF 0.9 EUR
2020-02-01 close Assets:A
"""


def test_plugins(spark):
    led = booking.book(text.load_text(spark, PLUG))
    p = lambda name, config=None: plugins.PLUGINS[name](led, config)
    n = lambda name, config=None: p(name, config)[1].count()
    kinds = lambda r, kind: rows(r[0].of(kind).orderBy("account", "name").select("account"))
    assert kinds(p("autoaccounts"), "open")[-1] == ("Assets:New",)
    assert kinds(p("closetree"), "close") == [("Assets:A",), ("Assets:A:B",), ("Assets:A:B:C",)]
    assert p("excludetag")[0].postings.count() == 6
    assert n("leafonly") == 1 and n("noduplicates") == 1 and n("nounused") == 1 and n("uniqueprices") == 1
    assert n("coherentcost") == 1 and n("onecommodity") == 1 and n("checkcommodity") == 4
    assert p("implicitprices")[0].of("price").count() == 5
    assert p("checkdrained")[0].of("balance").count() == 1
    inherited = p("inheritmetadata", "region")[0].of("open").where("meta['region'].s = 'eu'").count()
    assert inherited == 3
    assert p("infermetadata", "open leaf __account__")[0].of("open").where("meta['leaf'].s = 'C'").count() == 1
    assert n("checkmetadata", "account:region") == 1
    done = rows(p("pricecompletion")[0].of("price").where("name = 'CHF' and amount.currency = 'USD'").select("amount.number"))
    assert done == [(Decimal("1.08"),)]
    again = plugins.resequence(p("autoaccounts")[0])
    assert again.entries.select("seq").distinct().count() == again.entries.count() and again.postings.count() == led.postings.count()
    for name in ("checkclosing", "comprehensivebalance", "fiscalincomeexpense", "commoditypattern", "sellgains", "tradingvalidation"):
        r = p(name)
        assert r[0].entries.count() == led.entries.count() and (r[1] is None or r[1].count() == 0)


def test_tolerances_use_authored_digits(spark):
    led = text.load_text(spark, '2020-01-01 * "a"\n  Assets:A 1.000 USD\n  Assets:B -1.0 USD\n  Assets:C 0.049 USD\n')
    assert rows(validate.transaction_balances(led).select("residual", "ok")) == [(Decimal("0.049"), True)]


MIXED = """
2020-01-01 open Assets:A "STRICT"
2020-01-01 open Assets:C
2020-01-01 open Assets:Cash
2020-02-01 * "two unknown costs in JPY, and EUR legs"
  Assets:A  10 AAA {JPY}
  Assets:C  10 CCC {JPY}
  Assets:Cash  -100 JPY
  Assets:Cash  5 EUR
  Assets:C  -5 EUR
2020-02-02 * "buy"
  Assets:A  4 XX {2.00 USD}
  Assets:Cash  -8.00 USD
2020-02-03 * "buy"
  Assets:A  4 XX {3.00 USD}
  Assets:Cash  -12.00 USD
2020-02-04 * "one currency of the sale fails and gives back what it took"
  Assets:A  -1 XX {2.00 USD}
  Assets:A  -9 XX {3.00 USD}
  Assets:Cash  30.00 USD
  Assets:Cash  1 GBP
  Assets:C  -1 GBP
2020-02-05 * "all of both lots"
  Assets:A  -8 XX {}
  Assets:Cash
2020-02-06 * "no transaction"
  Assets:A  1 USD
  Assets:Cash
  Assets:C
"""


def test_a_failure_takes_its_currency_along(spark):
    got = booking.book(text.load_text(spark, MIXED))
    codes = sorted(r[0] for r in got.diagnostics.select("code").collect())
    assert codes == ["exceeds-lots", "multiple-auto", "unresolvable", "unresolvable"]
    by = {}
    for r in got.postings.orderBy("seq", "idx").collect():
        by.setdefault(str(r["date"]), []).append((r["account"], r["number"], r["currency"]))
    assert by["2020-02-01"] == [("Assets:Cash", 5, "EUR"), ("Assets:C", -5, "EUR")]
    assert by["2020-02-04"] == [("Assets:Cash", 1, "GBP"), ("Assets:C", -1, "GBP")]
    assert by["2020-02-05"][-1] == ("Assets:Cash", 20, "USD") and len(by["2020-02-05"]) == 3
    assert "2020-02-06" not in by and got.of("transaction").count() == 5


def test_sums_beyond_ten_digits(spark):
    made = "2024-01-01 open Assets:A\n" + "".join(f'2024-01-{d:02d} * "x"\n  Assets:A  9000000000.25 USD\n  Income:F\n' for d in range(2, 29) for _ in range(6))
    led = booking.book(text.load_text(spark, made))
    total = Decimal("9000000000.25") * 27 * 6
    q = lambda s: rows(query(led, s))
    assert q("SELECT number(only('USD', sum(position))) AS n, sum(number) AS s WHERE account = 'Assets:A'") == [(total, total)]
    assert q("SELECT number(only('USD', sum(position))) AS n FROM OPEN ON 2024-01-20 WHERE account = 'Assets:A'") == [(total,)]
    assert q("SELECT number(only('USD', balance)) AS b WHERE account = 'Assets:A' ORDER BY b DESC LIMIT 1") == [(total,)]
    assert q("SELECT balance WHERE account = 'Assets:A' ORDER BY date DESC LIMIT 1")[0][0][0]["units"]["number"] in {total - k * Decimal("9000000000.25") for k in range(6)}
    assert q("SELECT sum(number) / 2 AS h WHERE account = 'Income:F'") == [(-total / 2,)]


def test_products_keep_eight_digits(spark):
    from pyspark.sql import functions as F

    from ledgerlake.operators.inventory import times

    pairs = [("123456789012.12345678", "3.00000001"), ("-1.5", "0.00000001"), ("0.5", "-0.00000001"), ("9999999999999999999.00000001", "1"), ("0", "5")]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.col("a").cast("decimal(36,8)").alias("a"), F.col("b").cast("decimal(18,8)").alias("b"))
    getcontext().prec = 60
    for a, b, n in df.select("a", "b", times(F.col("a"), F.col("b")).alias("n")).collect():
        assert n == (a * b).quantize(Decimal("1e-8"), ROUND_HALF_UP)


def test_month_bins_against_a_walk(spark):
    import calendar
    import random

    from pyspark.sql import functions as F

    from ledgerlake.functions.scalars import date_bin

    def add(d, k):
        y, m = divmod(d.year * 12 + d.month - 1 + k, 12)
        return D(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))

    def walk(a, b, k):
        while a < b:
            b = add(b, -k)
        while (after := add(b, k)) < a:
            b = after
        return b

    rng = random.Random(1)
    day = lambda: D(2000, 1, 1) + datetime.timedelta(days=rng.randrange(2000))
    made = [(day(), day(), rng.choice([1, 2, 3, 5, 12, 24])) for _ in range(800)] + [(D(y, m, 28), D(2001, 1, 31), k) for y in (1999, 2001, 2003) for m in range(1, 13) for k in (1, 2, 3)]
    stride = F.struct(F.lit(0).alias("years"), F.col("k").alias("months"), F.lit(0).alias("days"))
    for r in spark.createDataFrame(made, "a date, o date, k int").withColumn("b", date_bin(stride, F.col("a"), F.col("o"))).collect():
        assert r["b"] == walk(r["a"], r["o"], r["k"])
