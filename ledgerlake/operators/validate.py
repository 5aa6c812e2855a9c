"""Validation passes: each gives diagnostics, or the entries that a pass adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.model import DIAGNOSTIC, ENTRIES, NUM, SUM, WIDE_POSTINGS, Ledger, Options, conform
from ledgerlake.operators.hierarchy import with_ancestors
from ledgerlake.operators.inventory import running_sum
from ledgerlake.plans.tables import weight

REFERENCING = ("open", "close", "balance", "pad", "note", "document")


def diagnostics(df: DataFrame, code: str, message: Column, severity: str = "error") -> DataFrame:
    return conform(df.withColumns({"code": F.lit(code), "severity": F.lit(severity), "message": message}), DIAGNOSTIC)


# --- tolerance ------------------------------------------------------------------------------------


def tolerance_of(scale: Column, options: Options, times: int = 1) -> Column:
    """multiplier x 10^-scale; null for integers (scale 0)."""
    return F.when(scale > 0, (F.lit(options.tolerance_multiplier).cast("decimal(9,4)") * times * F.pow(F.lit(10.0), -scale).cast("decimal(20,10)")).cast("decimal(28,10)"))


def default_tolerance(currency: Column, options: Options) -> Column:
    out = F.lit(options.inferred_tolerance_default.get("*", "0")).cast("decimal(28,10)")
    for c, n in options.inferred_tolerance_default.items():
        if c != "*":
            out = F.when(currency == c, F.lit(n).cast("decimal(28,10)")).otherwise(out)
    return out


def transaction_tolerances(ledger: Ledger) -> DataFrame:
    """seq, currency, tolerance: the largest authored exponent of the transaction's fractional amounts in each currency."""
    return _sums_and_tolerances(ledger).select("seq", "currency", "tolerance")


def _sums_and_tolerances(ledger: Ledger) -> DataFrame:
    """seq, currency, residual, date (null without a weight in the currency), tolerance: one aggregation.

    A posting gives its weight to one currency, the digits of its units to another, and at cost those of its cost.
    """
    o = ledger.options
    n, c = weight()
    part = lambda cur, w, t, at: F.struct(cur.alias("currency"), w.cast(SUM).alias("w"), t.cast("decimal(28,10)").alias("t"), at.cast("decimal(28,10)").alias("at"))
    none = F.lit(None)
    t = tolerance_of(F.col("scale"), o)
    parts = [F.when(c.eqNullSafe(F.col("currency")), part(c, n, t, none)).otherwise(part(c, n, none, none)), F.when(~c.eqNullSafe(F.col("currency")), part(F.col("currency"), none, t, none))]
    if o.infer_tolerance_from_cost:
        # half a unit of the amount's last digit, at cost: summed over the postings held at cost
        parts.append(F.when(F.col("cost.number").isNotNull(), part(F.col("cost.currency"), none, none, t.cast(NUM) * F.col("cost.number"))))
    rows = ledger.postings.where("number is not null").select("seq", "date", F.explode(F.array_compact(F.array(*parts))).alias("x"))
    got = rows.groupBy("seq", "x.currency").agg(F.sum("x.w").alias("residual"), F.min(F.when(F.col("x.w").isNotNull(), F.col("date"))).alias("date"), F.max("x.t").alias("t"), F.sum("x.at").cast("decimal(28,10)").alias("at"))
    return got.select("seq", "currency", "residual", "date", F.greatest("t", "at").alias("tolerance"))


def transaction_balances(ledger: Ledger) -> DataFrame:
    """V7: a row per transaction and weight currency: residual, tolerance, ok."""
    got = _sums_and_tolerances(ledger).where("date is not null")
    limit = F.coalesce("tolerance", default_tolerance(F.col("currency"), ledger.options))
    return got.withColumn("tolerance", limit).withColumn("ok", F.abs("residual") <= F.col("tolerance"))


def unbalanced(ledger: Ledger) -> DataFrame:
    bad = transaction_balances(ledger).where("not ok")
    return diagnostics(bad, "transaction-unbalanced", F.concat(F.lit("does not balance: "), F.col("residual").cast("string"), F.lit(" "), F.col("currency")))


# --- balance assertions ---------------------------------------------------------------------------


def check_balances(ledger: Ledger) -> DataFrame:
    """V2: seq, account, currency, expected, actual, discrepancy, tolerance, ok of every assertion.

    Postings explode into the ancestors of their account, but only those that are asserted; a range-cut
    running sum over postings and assertions together gives the subtree's units before each assertion.
    """
    b = ledger.of("balance").select("seq", "date", "account", F.col("amount.currency").alias("currency"), F.col("amount.number").alias("expected"), "scale", "tolerance")
    asserted = b.select("account", "currency").distinct()
    p = with_ancestors(ledger.postings.where("number is not null").select("seq", "account", "number", "currency")).select("seq", F.col("ancestor").alias("account"), "currency", F.col("number").cast(SUM).alias("n"), F.lit(0).alias("ask"))
    p = p.join(asserted, ["account", "currency"], "left_semi")
    asks = b.select("seq", "account", "currency", F.lit(0).cast(SUM).alias("n"), F.lit(1).alias("ask"))
    run = running_sum(p.unionByName(asks), ["account", "currency"], ["seq", "ask"], "n", "actual").where("ask = 1").select("seq", "actual").groupBy("seq").agg(F.max("actual").alias("actual"))
    o = ledger.options
    limit = F.coalesce(F.col("tolerance").cast("decimal(28,10)"), tolerance_of(F.col("scale"), o, 2), default_tolerance(F.col("currency"), o))
    got = b.join(run, "seq", "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast(SUM)))
    got = got.withColumn("discrepancy", (F.col("actual") - F.col("expected")).cast(SUM)).withColumn("tolerance", limit)
    return got.withColumn("ok", F.abs("discrepancy") <= F.col("tolerance"))


def failed_balances(ledger: Ledger) -> DataFrame:
    bad = check_balances(ledger).where("not ok")
    return diagnostics(bad, "balance-mismatch", F.concat(F.lit("expected "), F.col("expected").cast("string"), F.lit(", is "), F.col("actual").cast("string"), F.lit(" "), F.col("currency")))


def duplicate_balances(ledger: Ledger) -> DataFrame:
    """V3: assertions of an (account, date, currency) that differ from the first one."""
    w = Window.partitionBy("account", "date", "amount.currency").orderBy("seq")
    b = ledger.of("balance").withColumn("_first", F.first("amount.number").over(w)).where(F.col("_first") != F.col("amount.number"))
    return diagnostics(b, "duplicate-balance", F.lit("differs from an earlier assertion of the day"))


# --- open, close, currencies ----------------------------------------------------------------------


def duplicate_opens(ledger: Ledger) -> DataFrame:
    """V4: every Open of an account after its first; likewise Close."""
    w = Window.partitionBy("type", "account").orderBy("seq")
    again = ledger.entries.where(F.col("type").isin("open", "close")).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return diagnostics(again, "duplicate-open", F.concat(F.lit("second "), F.col("type"), F.lit(" of "), F.col("account")))


def references(ledger: Ledger) -> DataFrame:
    """seq, date, type, account: every use of an account."""
    e = ledger.entries.where(F.col("type").isin(*REFERENCING)).select("seq", "date", "type", "account")
    pads = ledger.of("pad").select("seq", "date", "type", F.col("pad_account").alias("account"))
    return e.unionByName(pads).unionByName(ledger.postings.select("seq", "date", F.lit("transaction").alias("type"), "account")).where("account is not null")


def inactive_accounts(ledger: Ledger) -> DataFrame:
    """V5: uses of an account before its Open, after its Close, or without any Open; Balance, Note and Document tolerate a closed one."""
    r = references(ledger).where(~F.col("type").isin("open", "close")).distinct()
    r = r.join(ledger.opens.select("account", "open_date"), "account", "left").join(ledger.closes.select("account", "close_date"), "account", "left")
    state = F.when(F.col("open_date").isNull(), "was never opened").when(F.col("date") < F.col("open_date"), "is not open yet").when((F.col("date") > F.col("close_date")) & ~F.col("type").isin("balance", "note", "document"), "is closed")
    return diagnostics(r.withColumn("_s", state).where("_s is not null"), "inactive-account", F.concat("account", F.lit(" "), F.col("_s")))


def disallowed_currencies(ledger: Ledger) -> DataFrame:
    """V6: postings in a currency that their account's Open does not list."""
    p = ledger.postings.where("currency is not null").join(ledger.opens.where(F.size("open_currencies") > 0).select("account", "open_currencies"), "account").where(~F.array_contains("open_currencies", F.col("currency")))
    return diagnostics(p, "currency-constraint", F.concat(F.col("currency"), F.lit(" is not allowed in "), F.col("account")))


def missing_documents(ledger: Ledger, existing: DataFrame) -> DataFrame:
    """V9: Document entries whose file is not among ``existing`` (path)."""
    d = ledger.of("document").join(existing.select(F.col("path").alias("value")), "value", "left_anti")
    return diagnostics(d, "document-missing", F.concat(F.lit("no such file: "), F.col("value")))


# --- pad ------------------------------------------------------------------------------------------


def pad(ledger: Ledger) -> tuple[Ledger, DataFrame]:
    """V1: transactions that bring padded accounts to their next assertion.

    Each assertion belongs to the latest pad of its account before it (a window over pads and
    assertions alone); the first of a currency is filled. The running amount counts earlier
    insertions, as the difference of consecutive fills does, so pads of one account need no loop. Pads
    that draw on another padded account are filled after it, by rounds over the pads' dependencies.
    """
    diag: list[DataFrame] = []
    rounds = _pad_rounds(ledger)
    for accounts in rounds:
        entries, postings, d = _fill(ledger, accounts)
        diag.append(d)
        ledger = Ledger(ledger.spark, ledger.entries.unionByName(entries), ledger.postings.unionByName(postings), ledger.options, ledger.diagnostics)
    out = diag[0] if diag else ledger.spark.createDataFrame([], DIAGNOSTIC)
    for d in diag[1:]:
        out = out.unionByName(d)
    return ledger, out


def _pad_rounds(ledger: Ledger) -> list[list[str]]:
    """Padded accounts, those that others draw on after those that draw on them. Pads are authored by hand: few."""
    pairs = {(r[0], r[1]) for r in ledger.of("pad").select("account", "pad_account").distinct().toLocalIterator()}
    targets, rounds = {a for a, _ in pairs}, []
    while targets:
        free = {a for a in targets if not any(b == a and x in targets and x != a for x, b in pairs)} or set(targets)
        rounds.append(sorted(free))
        targets -= free
    return rounds


def _fill(ledger: Ledger, accounts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    mine = F.col("account").isin(*accounts)
    pads = ledger.of("pad").where(mine).select("seq", "date", "account", "pad_account")
    asks = ledger.of("balance").where(mine).select("seq", "account", F.col("amount.currency").alias("currency"), F.col("amount.number").alias("expected"), "scale", "tolerance")
    both = pads.select("account", "seq", F.col("seq").alias("pad")).unionByName(asks.select("account", "seq", F.lit(None).cast("long").alias("pad")))
    w = Window.partitionBy("account").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = both.withColumn("owner", F.last("pad", ignorenulls=True).over(w)).where("pad is null").select("account", "seq", "owner").distinct()
    p = ledger.postings.join(pads.select("account").distinct(), "account", "left_semi")
    moves = p.where("number is not null").select("account", "currency", "seq", F.col("number").cast(SUM).alias("n"), F.lit(0).alias("ask"))
    marks = asks.select("account", "currency", "seq", F.lit(0).cast(SUM).alias("n"), F.lit(1).alias("ask"))
    actual = running_sum(moves.unionByName(marks), ["account", "currency"], ["seq", "ask"], "n", "actual").where("ask = 1").groupBy("account", "currency", "seq").agg(F.max("actual").alias("actual"))
    at_cost = p.where("cost is not null").select("account", F.col("currency")).distinct().withColumn("lots", F.lit(True))
    first = Window.partitionBy("owner", "account", "currency").orderBy("seq")
    got = asks.join(owner, ["account", "seq"]).where("owner is not null").join(actual, ["account", "currency", "seq"], "left").join(at_cost, ["account", "currency"], "left")
    got = got.withColumn("actual", F.coalesce("actual", F.lit(0).cast(SUM))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    # an earlier fill has brought the account to that fill's assertion: what is missing now is the change since
    before = Window.partitionBy("account", "currency").orderBy("seq")
    gap = F.col("expected") - F.col("actual")
    got = got.withColumn("_gap", gap).withColumn("number", F.col("_gap") - F.coalesce(F.lag("_gap").over(before), F.lit(0)))
    o = ledger.options
    limit = F.coalesce(F.col("tolerance").cast("decimal(28,10)"), tolerance_of(F.col("scale"), o, 2), default_tolerance(F.col("currency"), o))
    need = got.where(F.abs("number") > limit)
    refused = need.where("lots")
    fill = need.where("lots is null").join(pads.select(F.col("seq").alias("owner"), "date", "pad_account"), "owner")
    number = F.col("number").cast(SUM)
    base = fill.withColumns({"seq": F.col("owner"), "type": F.lit("transaction"), "flag": F.lit("P"), "narration": F.concat(F.lit("(Padding inserted for balance of "), F.col("expected").cast("string"), F.lit(" "), F.col("currency"), F.lit(")")), "id": F.md5(F.concat_ws("|", F.lit("pad"), F.col("owner").cast("string"), "currency"))})
    legs = base.withColumn("x", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("account").alias("a"), number.alias("n")), F.struct(F.lit(1).alias("i"), F.col("pad_account").alias("a"), (-number).cast(SUM).alias("n")))))
    legs = legs.withColumns({"account": F.col("x.a"), "number": F.col("x.n"), "idx": (F.pmod(F.xxhash64("currency"), F.lit(1 << 29)).cast("int") * 2 + F.col("x.i")).cast("int")})
    entries = conform(base.drop("account", "tolerance", "scale"), ENTRIES)
    return entries, conform(legs, WIDE_POSTINGS), diagnostics(refused, "pad-at-cost", F.concat(F.lit("can't pad an account with lots: "), F.col("account")))


def validate(ledger: Ledger) -> DataFrame:
    """All checks' diagnostics."""
    out = unbalanced(ledger)
    for check in (failed_balances, duplicate_balances, duplicate_opens, inactive_accounts, disallowed_currencies):
        out = out.unionByName(check(ledger))
    return out
