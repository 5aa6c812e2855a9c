import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import dedup, importing, predict, route
from ledgerlake.operators.booking import book
from ledgerlake.plans.compiler import query
from ledgerlake.sources import sinks, statements, text
from ledgerlake.streaming import events

D = datetime.date
CSV = 'Bank of X\nAccount 12;\n\nDate,Payee,Description,Amount\n2024-01-02,"Shop, Inc",Food,"-1,012.50"\n2024-01-03,Work,"Pay ""May""",2000.00\n2024-01-04,Pending,x,-\nbad,Shop,y,1.00\n2024-01-05,Skip me,z,5.00\n'


def test_statement(spark, tmp_path):
    (tmp_path / "s.csv").write_text("\ufeff" + CSV)
    p = importing.from_config({"name": "x", "date": "Date", "amount": "Amount", "payee": "Payee", "narration": "Description", "currency": "USD", "account": "Assets:Bank", "counter": "Expenses:Unknown", "exclude": [{"column": "Payee", "regex": "^Skip"}]})
    tx, diag = p.run(p.read(spark, f"file://{tmp_path}/s.csv"))
    got = tx.orderBy("date").collect()
    assert [(r["date"], r["payee"], r["narration"]) for r in got] == [(D(2024, 1, 2), "Shop, Inc", "Food"), (D(2024, 1, 3), "Work", 'Pay "May"')]
    assert [(q["account"], q["amount"]["number"]) for q in got[0]["postings"]] == [("Assets:Bank", Decimal("-1012.5")), ("Expenses:Unknown", Decimal("1012.5"))]
    assert sorted(r["message"] for r in diag.collect()) == ["no date", "no value"]
    again = book(text.load_text(spark, "".join(r["text"] for r in importing.printed(tx).collect())))
    assert again.postings.count() == 4 and all(len(r["row_hash"]) == 16 for r in got)
    hooked = importing.chain(importing.stamp_metadata(source="x"), importing.balance_with("Equity:X"))(tx)
    assert hooked.first()["meta"] == {"source": "x"}
    rules = predict.classify(tx, [("payee", "(?i)shop", "Expenses:Food")])
    assert rules.where("counter = 'Expenses:Food'").count() == 1
    assert importing.dispatch("a/s.csv", [("q", None), (r"s\.csv$", p)]) is p


def test_debit_credit_and_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text("02.01.2024;5,00;;A\n03.01.2024;;1.007,25;B\n", encoding="latin-1")
    p = importing.from_config({"columns": ["d", "out", "in", "k"], "delimiter": ";", "charset": "ISO-8859-1", "date": "d", "date_format": "%d.%m.%Y", "debit": "out", "credit": "in", "thousands": ".", "decimal": ",", "currency": "EUR", "account_column": "k", "accounts": {"A": "Assets:A", "B": "Assets:B"}, "counter": "Equity:X"})
    tx, _ = p.run(p.read(spark, f"file://{tmp_path}/t.csv"))
    assert [(r["postings"][0]["account"], r["postings"][0]["amount"]["number"]) for r in tx.orderBy("date").collect()] == [("Assets:A", Decimal(-5)), ("Assets:B", Decimal("1007.25"))]


PROGRAM = """
; amounts under one are left out
(let* ((d (parse-date (column "Date") "%Y-%m-%d"))
       (a (parse-amount (column "Amount") (or-else (hint "currency") (const "USD"))))
       (who (split (column "Payee") (regex "^(?P<name>[A-Z][a-z]+)")))
       (acct (map-value (group who "name") (dict "Shop" "Expenses:Food" "Work" "Income:Work"))))
  (when (and (not (zero? a)) (not (amount<? (abs-amount a) (amount 1 (const "USD")))))
    (emit-transaction :date d :narration (template "{n}!" (bindings (n (group who "name"))))
      :tags (tags "imported") :meta (meta "src" (column "Date"))
      :postings (postings (posting "Assets:Bank" a) (posting (coalesce acct "Expenses:Other") (negate-amount a))))))
"""


def test_program(spark):
    rows = spark.createDataFrame([("2024-01-02", "Shop 1", "3.00"), ("2024-01-03", "Work", "-4"), ("2024-01-03", "Zed", "9"), ("2024-01-04", "Shop", "0.5")], "Date string, Payee string, Amount string")
    got = importing.Program(PROGRAM).run(rows).orderBy("date", "narration").collect()
    assert [(r["narration"], r["postings"][1]["account"], r["postings"][1]["amount"]["number"]) for r in got] == [("Shop!", "Expenses:Food", Decimal(-3)), ("Work!", "Income:Work", Decimal(4)), ("Zed!", "Expenses:Other", Decimal(-9))]
    assert got[0]["tags"] == ["imported"] and got[0]["meta"] == {"src": "2024-01-02"}
    for bad in ("(", "(nope 1)", "(column \"x\")", "1 2"):
        with pytest.raises(importing.ProgramError):
            importing.Program(bad).run(rows)


def test_steps(spark):
    a = lambda n: importing.amount(F.lit(n).cast("decimal(18,8)"), F.lit("USD"))
    row = spark.range(1).select(importing.round_(a("2.345"), 2)["number"].alias("r"), importing.floor(a("-2.341"), 2)["number"].alias("f"), importing.ceil(a("2.341"), 2)["number"].alias("c"), importing.divide(a("10"), "3", 2)["number"].alias("d"), importing.scale(a("2"), "1.5")["number"].alias("s"), importing.add(a("1"), a("2"))["number"].alias("p"), importing.subtract(a("1"), importing.amount(F.lit(1), F.lit("EUR"))).alias("x"), statements.number(F.lit("(1,5)"), ".", ",").alias("n"), *[c.alias(k) for k, c in zip("tu", statements.split_currency(F.lit("12.50 USD")), strict=True)]).first()
    assert (row["r"], row["f"], row["c"], row["d"], row["s"], row["p"], row["x"], row["n"], row["t"], row["u"]) == (Decimal("2.34"), Decimal("-2.35"), Decimal("2.35"), Decimal("3.33"), 3, 3, None, Decimal("-1.5"), "12.50", "USD")


def test_rates(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<e:Envelope xmlns:e="g" xmlns="x"><Cube><Cube time="2024-01-02"><Cube currency="USD" rate="1.09"/></Cube><Cube time="2024-01-03"><Cube currency="USD" rate="1.1"/></Cube></Cube></e:Envelope>')
    q = statements.ecb_quotes(spark, f"file://{tmp_path}/r.xml")
    assert statements.quotes(q).first()["rate"] == Decimal("1.1") and statements.quotes(q, "at", "2024-01-02").first()["rate"] == Decimal("1.09")
    assert statements.quotes(q, "range", "2024-01-03", "2024-01-01").count() == 2
    req = route.price_requests(spark.createDataFrame([("ABC", {"price": ("USD:one/A,two/^B")})], "name string, m map<string,string>").selectExpr("name", "transform_values(m, (k, v) -> named_struct('s', v)) as meta"))
    assert [(r["level"], r["source"], r["symbol"], r["inverted"]) for r in req.orderBy("level").collect()] == [(0, "one", "A", False), (1, "two", "B", True)]
    none = lambda df, mode: df.where("false").selectExpr("currency", "quote", "current_date() as date", "1.0 as rate")
    some = lambda df, mode: df.selectExpr("currency", "quote", "current_date() as date", "1.0 as rate")
    assert route.fetch(req, {"one": none, "two": some}).count() == 1


LEDGER = '2024-01-01 open Assets:A\n2024-01-01 open Expenses:F\n2024-01-02 * "Shop" "food and wine" #t ^l\n  Expenses:F  5.25 USD\n  Assets:A  -5.25 USD\n2024-01-03 price EUR 1.1 USD\n2024-01-05 * "Shop" "food again"\n  Expenses:F  6 USD\n  Assets:A  -6 USD\n'


def test_sinks(spark, tmp_path):
    led = text.load_text(spark, LEDGER)
    table = sinks.text_table(query(led, "SELECT account, sum(position) AS s, sum(number) AS n GROUP BY account ORDER BY account"))
    assert table.splitlines()[2].split() == ["Assets:A", "(-11.25", "USD)", "-11.25"]
    rows = query(led, "SELECT date, tags, position, payee AS p, posting_flag AS z WHERE number = 5.25")
    sinks.write_csv(rows, f"file://{tmp_path}/c")
    assert spark.read.text(f"file://{tmp_path}/c").count() == 2
    assert sinks.json_rows(rows).first()[0] == '{"date":"2024-01-02","tags":["t"],"position":{"units":{"number":"5.25","currency":"USD"},"cost":null},"p":"Shop","z":null}'
    sinks.write_ledger(led, f"file://{tmp_path}/l")
    back = text.load_text(spark, "\n".join(r["text"] for r in sinks.entry_text(led).orderBy("seq").collect()))
    assert back.entries.select("type", "date", "id").orderBy("seq").collect() == led.entries.select("type", "date", "id").orderBy("seq").collect()
    sinks.write_prices(led.prices, f"file://{tmp_path}/p")
    assert spark.read.text(f"file://{tmp_path}/p").first()[0] == "2024-01-03 price EUR 1.1 USD"
    routed = route.route(led.postings.select("seq", "account", "date"), "{root}")
    sinks.write_routed(routed, f"file://{tmp_path}/r")
    assert {r[0] for r in spark.read.parquet(f"file://{tmp_path}/r").select("path").distinct().collect()} == {"Assets", "Expenses"}


def test_predict_and_dedup(spark):
    led = text.load_text(spark, LEDGER)
    train = predict.training_rows(led.postings, led.opens, led.closes)
    asked = spark.createDataFrame([(9, D(2024, 2, 1), "Shop", "food", "Assets:A", Decimal("-5.25"), "USD"), (8, D(2024, 2, 1), "Zzz", "qqq", "Assets:B", Decimal(1), "EUR")], "seq long, date date, payee string, narration string, account string, number decimal(18,8), currency string")
    got = {r["seq"]: r["label"] for r in predict.predict(train, asked).collect()}
    assert got == {9: "Expenses:F"}
    assert predict.tokenize("Café 12 日本") == ["café", "<n>", "日", "本", "日本"]
    moved = led.postings.withColumn("date", F.date_add("date", 1)).withColumn("narration", F.lit("other"))
    assert {r["kind"] for r in dedup.match(led.postings, led.postings).collect()} == {"exact"}
    acts = dedup.decide(dedup.match(moved, led.postings, window=2)).collect()
    assert {(r["kind"], r["action"]) for r in acts} == {("structural", "comment")}
    assert {r["kind"] for r in dedup.match(moved, led.postings).collect()} == {"none"}


def test_streams(spark):
    path = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{path}/events.parquet")
    for build, name in ((events.binned, "bins"), (events.sessions, "sess")):
        src = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(path)
        q = build(src).writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() > 0
