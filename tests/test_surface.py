import types

import pytest
from pyspark.sql import functions as F

from ledgerlake.__main__ import main
from ledgerlake.functions import loading, registry
from ledgerlake.operators import inventory, prices
from ledgerlake.plans.compiler import query
from ledgerlake.plans.syntax import QueryError
from ledgerlake.sources import text
from ledgerlake.sources.session import Session, cancellable

TEXT = '2024-01-01 open Assets:A\n2024-01-01 open Expenses:F\n2024-01-02 * "x"\n  Expenses:F  5.25 USD\n  Assets:A\n'


def test_overloads_and_user_functions(spark):
    module = types.ModuleType("mine")
    module.MANIFEST = {"name": "mine"}
    module.register_functions = lambda register: register("twice", "decimal", "decimal", lambda x: (x * 2).cast("decimal(18,8)"))
    loading.load(module)
    with pytest.raises(ValueError):
        loading.load(module)
    assert registry.resolve("twice", ["int"]).ins == ("decimal",)
    with pytest.raises(QueryError):
        registry.resolve("twice", ["string"])
    led = text.load_text(spark, TEXT)
    assert query(led, "SELECT twice(3) AS x LIMIT 1").first()["x"] == 6
    registry.unregister("twice", "decimal")
    with pytest.raises(loading.PluginError):
        loading.load(types.ModuleType("none"))
    assert len(registry.names()) >= 66


def test_session(spark, tmp_path):
    f = tmp_path / "m.ledger"
    f.write_text(TEXT)
    s, seen = Session(spark, str(f)), []
    end = s.subscribe(seen.append)
    assert s.snapshot() is s.snapshot() and len(seen) == 1
    s.set_overlay(str(f), TEXT + '2024-01-03 note Assets:A "n"\n')
    assert s.snapshot().of("note").count() == 1
    end()
    s.set_overlay(str(f), None)
    assert s.reload().of("note").count() == 0 and len(seen) == 2
    with cancellable(spark, "g") as cancel:
        assert spark.range(3).count() == 3
        cancel()


@pytest.mark.parametrize(("fmt", "want"), [("csv", "account,n\nAssets:A,-5.25\nExpenses:F,5.25\n"), ("json", '[{"account":"Assets:A","n":"-5.25"},\n {"account":"Expenses:F","n":"5.25"}]\n')])
def test_command(spark, tmp_path, capsys, fmt, want):
    f = tmp_path / "m.ledger"
    f.write_text(TEXT)
    assert main([str(f), "SELECT account, sum(number) AS n GROUP BY account ORDER BY account", "--format", fmt]) == 0
    assert capsys.readouterr().out == want
    assert main([str(f), "SELECT nope"]) == 1


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.col("id").alias("seq"), F.lit(0).alias("idx"), (F.col("id") % 7).cast("decimal(18,8)").alias("n"), F.when(F.col("id") % 3 == 0, "EUR").otherwise("USD").alias("k"))
    run = lambda d: sorted(map(tuple, inventory.running_sum(d, ["k"], ["seq", "idx"], "n", "s", 9).select("seq", "s").collect()))
    assert run(df) == run(df.repartition(13))
    total, want = {"EUR": 0, "USD": 0}, []
    for i in range(200):
        k = "USD" if i % 3 else "EUR"
        total[k] += i % 7
        want.append((i, total[k]))
    assert run(df) == want


def test_rates_direct_before_inverse(spark):
    p = spark.createDataFrame([(1, "2024-01-31", "A", "B", "2"), (2, "2024-03-01", "B", "A", "0.25"), (3, "2024-03-01", "C", "B", "0")], "seq long, date string, base string, quote string, rate string").withColumns({"date": F.to_date("date"), "rate": F.col("rate").cast("decimal(18,8)")})
    ask = spark.createDataFrame([(1, "A", "B", "2024-05-01"), (2, "b", "a", "2024-02-10"), (3, "B", "C", "2024-05-01"), (4, "A", "B", "2024-01-30"), (5, "A", "A", "2000-01-01")], "i int, b string, q string, d string").withColumn("d", F.to_date("d"))
    got = {r["i"]: r["r"] for r in prices.attach_rate(ask, p, F.col("b"), F.col("q"), F.col("d"), "r").collect()}
    assert [None if v is None else float(v) for _, v in sorted(got.items())] == [2.0, 0.5, None, None, 1.0]


def test_command_prints_every_row(spark, tmp_path, capsys):
    f = tmp_path / "many.ledger"
    f.write_text("2024-01-01 open Assets:A\n" + "".join(f'2024-01-02 event "e{k}" "日本 {k}"\n' for k in range(1500)))
    assert main([str(f), "SELECT type, description FROM events"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 1502 and sum("日本" in x for x in lines) == 1500
