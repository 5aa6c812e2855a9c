"""Period scoping: OPEN ON, CLOSE ON, CLEAR as ledger rewrites.

Opening and clearing entries are group sums per account and lot, exploded into two legs; rewritten
ledgers keep canonical order by giving the synthetic transactions numbers of their own range.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.model import ENTRIES, NUM, SUM, WIDE_POSTINGS, Ledger, conform

SYNTHETIC = "__synthetic__"
#: Number ranges below and above all others.
OPENING_SEQ, CLEARING_SEQ = -(1 << 62), (1 << 62)


def _mark(kind: str):
    return F.create_map(F.lit(SYNTHETIC), F.struct(F.lit("string").alias("kind"), F.lit(kind).alias("s"), F.lit(None).cast(NUM).alias("n"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("currency")))


def _held(postings: DataFrame) -> DataFrame:
    """account, currency, cost, number of what is not zero."""
    return postings.where("number is not null").groupBy("account", "currency", "cost").agg(F.sum("number").alias("number")).where("number <> 0")


def _transactions(legs: DataFrame, when, kind: str, text: str, base: int) -> tuple[DataFrame, DataFrame]:
    """(entries, postings) from legs (owner, idx, account, number, currency, cost)."""
    owner = F.col("owner")
    seq = F.lit(base) + F.pmod(F.xxhash64(owner), F.lit(1 << 60))
    legs = legs.withColumns({"seq": seq, "date": when, "flag": F.lit("*"), "narration": F.concat(F.lit(f"{text} balance for '"), owner, F.lit("'")), "entry_meta": _mark(kind), "id": F.md5(F.concat(F.lit(kind + ":"), owner))})
    entries = legs.groupBy("seq", "date", "flag", "narration", "id").agg(F.lit("transaction").alias("type")).withColumn("meta", _mark(kind))
    return conform(entries, ENTRIES), conform(legs, WIDE_POSTINGS)


def _legs(held: DataFrame, first_account, first_sign: int, keep_cost, second_account) -> DataFrame:
    n = F.col("number")
    leg = lambda i, account, sign, cost: F.struct(F.lit(i).alias("i"), account.alias("account"), (n if sign > 0 else -n).cast(SUM).alias("number"), cost.alias("cost"))
    none = F.when(F.lit(False), F.col("cost"))
    rows = held.withColumn("x", F.explode(F.array(leg(0, first_account, first_sign, F.when(keep_cost, F.col("cost"))), leg(1, second_account, -first_sign, none))))
    place = F.pmod(F.xxhash64("currency", F.col("cost"), F.lit(1)), F.lit(1 << 29)).cast("int") * 2
    return rows.select(F.col("account").alias("owner"), (place + F.col("x.i")).cast("int").alias("idx"), F.col("x.account").alias("account"), F.col("x.number").alias("number"), "currency", F.col("x.cost").alias("cost"))


def opened(ledger: Ledger, day: datetime.date) -> Ledger:
    """OPEN ON: what was held before ``day`` as opening transactions; earlier Opens stay, other earlier entries go."""
    o = ledger.options
    held = _held(ledger.postings.where(F.col("date") < F.lit(day)))
    flow = F.substring_index("account", ":", 1).isin(o.name_income, o.name_expenses)
    previous, earnings = F.lit(o.equity("account_previous_balances")), F.lit(o.equity("account_previous_earnings"))
    legs = _legs(held, F.when(flow, earnings).otherwise(F.col("account")), 1, ~flow, previous)
    entries, postings = _transactions(legs, F.lit(day), "opening", "Opening", OPENING_SEQ)
    keep = ledger.entries.where((F.col("date") >= F.lit(day)) | F.col("date").isNull() | (F.col("type") == "open"))
    return Ledger(ledger.spark, keep.unionByName(entries), ledger.postings.where((F.col("date") >= F.lit(day)) | F.col("date").isNull()).unionByName(postings), o, ledger.diagnostics)


def closed(ledger: Ledger, day: datetime.date) -> Ledger:
    """CLOSE ON: entries before ``day`` and undated ones."""
    early = F.col("date").isNull() | (F.col("date") < F.lit(day))
    return Ledger(ledger.spark, ledger.entries.where(early), ledger.postings.where(early), ledger.options, ledger.diagnostics)


def cleared(ledger: Ledger, close: datetime.date | None = None) -> Ledger:
    """CLEAR: income and expenses transferred to current earnings, dated the day before ``close`` or the last kept date."""
    o = ledger.options
    flow = ledger.postings.where(F.substring_index("account", ":", 1).isin(o.name_income, o.name_expenses))
    last = close - datetime.timedelta(days=1) if close else ledger.entries.agg(F.max("date")).first()[0] or datetime.date.today()
    legs = _legs(_held(flow), F.col("account"), -1, F.lit(True), F.lit(o.equity("account_current_earnings")))
    entries, postings = _transactions(legs, F.lit(last), "clearing", "Clear", CLEARING_SEQ)
    return Ledger(ledger.spark, ledger.entries.unionByName(entries), ledger.postings.unionByName(postings), o, ledger.diagnostics)



def scoped(ledger: Ledger, open_on: datetime.date | None = None, close_on: datetime.date | None = None, clear: bool = False) -> Ledger:
    if open_on:
        ledger = opened(ledger, open_on)
    if close_on:
        ledger = closed(ledger, close_on)
    return cleared(ledger, close_on) if clear else ledger
