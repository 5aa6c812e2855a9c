"""What an account opens, clears or pads beyond 10^10 is one posting."""

from decimal import Decimal

from ledgerlake.operators import booking, scope, validate
from ledgerlake.plans.compiler import query
from ledgerlake.sources import text

BIG = "9000000000.25"


def made(more=""):
    head = "2024-01-01 open Assets:A\n2024-01-01 open Assets:B\n2024-01-01 open Equity:E\n"
    return head + "".join(f'2024-01-{d:02d} * "x"\n  Assets:A  {BIG} USD\n  Income:F\n' for d in range(2, 9)) + '2024-01-03 * "y"\n  Assets:B  7 P {2 USD}\n  Assets:A\n' + more


def test_pad_beyond_ten_digits(spark):
    """the fill is one posting, and the account then holds what is asserted."""
    led = booking.book(text.load_text(spark, made("2024-02-01 pad Assets:A Equity:E\n2024-02-02 balance Assets:A 5000000 USD\n")))
    padded, diag = validate.pad(led)
    want = Decimal(5000000) - 7 * Decimal(BIG) + 14
    assert sorted((r["account"], r["number"]) for r in padded.postings.where("flag = 'P'").collect()) == [("Assets:A", want), ("Equity:E", -want)]
    assert diag.count() == 0 and validate.failed_balances(padded).count() == 0 and validate.unbalanced(padded).count() == 0


def test_opening_and_clearing_beyond_ten_digits(spark):
    """two postings for each account, as the ledger's own size doesn't change what a period makes."""
    led = booking.book(text.load_text(spark, made()))
    q = lambda s: sorted(tuple(r) for r in query(led, s).collect())
    total = 7 * Decimal(BIG)
    marks = "SELECT str(entry_meta('__synthetic__')) AS m, account, count(date) AS n, sum(number) AS s FROM {} WHERE str(entry_meta('__synthetic__')) IS NOT NULL GROUP BY str(entry_meta('__synthetic__')), account"
    assert q(marks.format("OPEN ON 2024-02-01")) == [("opening", "Assets:A", 1, total - 14), ("opening", "Assets:B", 1, 7), ("opening", "Equity:Earnings:Previous", 1, -total), ("opening", "Equity:Opening-Balances", 3, 14 - 7)]
    assert q(marks.format("CLOSE ON 2024-02-01 CLEAR")) == [("clearing", "Equity:Earnings:Current", 1, -total), ("clearing", "Income:F", 1, total)]
    on = "FROM OPEN ON 2024-02-01 WHERE account = 'Assets:A'"
    assert q(f"SELECT number * 3 AS a, number % 10 AS b, number / 2 AS c, number(only('USD', balance)) AS d, number(weight) AS w {on}") == [(3 * total - 42, (total - 14) % 10, (total - 14) / 2, total - 14, total - 14)]
    assert q("SELECT number(weight) AS w FROM OPEN ON 2024-02-01 WHERE account = 'Assets:B'") == [(14,)]
    assert scope.opened(led, __import__("datetime").date(2024, 2, 1)).of("transaction").count() == 3
