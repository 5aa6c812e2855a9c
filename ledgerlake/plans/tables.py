"""The ten virtual tables over a ledger, with their typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.model import NUM, SUM, Ledger
from ledgerlake.operators import inventory as inv


def weight(p: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """(number, currency) that a posting adds to its transaction's balance: cost, then price, then units."""
    n, cost, price = p("number"), p("cost"), p("price")
    times = lambda a, b: F.coalesce((a.try_cast(NUM) * b.cast(NUM)).cast(SUM), inv.times(a, b))
    at_price = F.when(price["is_total"], F.signum(n).cast("decimal(2,0)") * F.abs(price["number"])).otherwise(times(n, price["number"])).cast(SUM)
    number = F.when(cost["number"].isNotNull(), times(n, cost["number"])).when(price["number"].isNotNull(), at_price).otherwise(n.cast(SUM))
    currency = F.when(cost["number"].isNotNull(), cost["currency"]).when(price["number"].isNotNull(), price["currency"]).otherwise(p("currency"))
    return number, currency


def per_unit(p: Callable[[str], Column] = F.col) -> Column:
    """The price per unit as an amount; a total is divided by the units."""
    price, n = p("price"), p("number")
    each = F.when(price["is_total"], F.try_divide(F.abs(price["number"]).cast(NUM), F.abs(n)).cast(NUM)).otherwise(price["number"])
    return inv.amount(each, price["currency"])


def _sorted(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def _common(location: bool = False) -> dict[str, tuple[Column, str]]:
    d = F.col("date")
    out = {
        "date": (d, "date"),
        "year": (F.year(d).cast("bigint"), "int"),
        "month": (F.month(d).cast("bigint"), "int"),
        "day": (F.day(d).cast("bigint"), "int"),
        "filename": (F.col("filename"), "string"),
        "lineno": (F.col("lineno").cast("bigint"), "int"),
        "payee": (F.nullif(F.col("payee"), F.lit("")), "string"),
        "narration": (F.col("narration"), "string"),
        "tags": (_sorted(F.col("tags")), "set"),
        "links": (_sorted(F.col("links")), "set"),
        "id": (F.col("id"), "string"),
        "description": (F.nullif(F.concat_ws(" | ", F.nullif(F.col("payee"), F.lit("")), F.nullif(F.col("narration"), F.lit(""))), F.lit("")), "string"),
    }
    if location:
        out["location"] = (F.concat(F.col("filename"), F.lit(":"), F.col("lineno").cast("string"), F.lit(":")), "string")
    return out


def _entry(ledger: Ledger) -> Column:
    """The directive as a value: its attributes."""
    return F.struct("type", "id", "date", "filename", "lineno", "meta", "account", "currencies", "amount", "narration", "payee", "flag", "tags", "links")


#: Types of entry attributes.
ENTRY_ATTRIBUTES = {"type": "string", "id": "string", "date": "date", "filename": "string", "lineno": "int", "meta": "dict", "account": "string", "accounts": "set", "currencies": "set", "amount": "amount", "narration": "string", "payee": "string", "flag": "string", "tags": "set", "links": "set", "description": "string"}


class Table:
    """A scan and its columns: name -> (Column over the scan, type)."""

    def __init__(self, df: DataFrame, columns: dict[str, tuple[Column, str]], order: list[str], star: list[str] | None = None):
        self.df, self.columns, self.order, self.star = df, columns, order, star or list(columns)


def postings(ledger: Ledger) -> Table:
    df = ledger.postings
    c = F.col
    position = inv.position(c("number"), c("currency"), c("cost"))
    w, w_currency = weight()
    cols = _common(location=True) | {
        "type": (F.lit("transaction"), "string"),
        "flag": (F.coalesce(c("posting_flag"), c("flag")), "string"),
        "posting_flag": (c("posting_flag"), "string"),
        "account": (c("account"), "string"),
        "number": (c("number"), "decimal"),
        "currency": (c("currency"), "string"),
        "cost_number": (c("cost.number"), "decimal"),
        "cost_currency": (c("cost.currency"), "string"),
        "cost_date": (c("cost.date"), "date"),
        "cost_label": (c("cost.label"), "string"),
        "position": (position, "position"),
        "weight": (inv.amount(w, w_currency), "amount"),
        "price": (per_unit(), "amount"),
        "meta": (c("meta"), "dict"),
        "entry_meta": (c("entry_meta"), "dict"),
        "any_meta": (F.when(c("meta").isNull(), c("entry_meta")).when(c("entry_meta").isNull(), c("meta")).otherwise(F.map_concat(F.map_filter(c("entry_meta"), lambda k, v: ~F.map_contains_key(c("meta"), k)), c("meta"))), "dict"),
        "accounts": (c("_accounts"), "set"),
        "other_accounts": (c("_others"), "set"),
        "entry": (F.struct(F.lit("transaction").alias("type"), "id", "date", "filename", "lineno", c("entry_meta").alias("meta"), F.lit(None).cast("string").alias("account"), F.lit(None).cast("array<string>").alias("currencies"), F.lit(None).cast("struct<number:decimal(36,8),currency:string>").alias("amount"), "narration", "payee", "flag", "tags", "links"), "entry"),
        "balance": (None, "inventory"),
    }
    star = ["date", "flag", "payee", "narration", "account", "position"]
    return Table(df, cols, ["seq", "idx"], star)


def with_accounts(df: DataFrame, others: bool) -> DataFrame:
    """The accounts of each posting's transaction, and those of its other postings (by place, not by name)."""
    per = df.groupBy("seq").agg(F.collect_list(F.struct("idx", "account")).alias("_all"))
    df = df.join(per, "seq").withColumn("_accounts", F.array_sort(F.array_distinct(F.transform("_all", lambda x: x["account"]))))
    if others:
        df = df.withColumn("_others", F.array_sort(F.array_distinct(F.transform(F.filter("_all", lambda x: x["idx"] != F.col("idx")), lambda x: x["account"]))))
    return df.drop("_all")


def entries(ledger: Ledger) -> Table:
    df = ledger.entries
    own = F.array_compact(F.array("account", F.when(F.col("type") == "pad", F.col("pad_account"))))
    cols = _common() | {
        "type": (F.col("type"), "string"),
        "flag": (F.col("flag"), "string"),
        "meta": (F.col("meta"), "dict"),
        "entry_meta": (F.col("meta"), "dict"),
        "any_meta": (F.col("meta"), "dict"),
        "accounts": (F.coalesce(F.col("_accounts"), _sorted(own)), "set"),
        "entry": (_entry(ledger), "entry"),
    }
    return Table(df, cols, ["seq"])


def _balances(ledger: Ledger) -> Table:
    from ledgerlake.operators.validate import check_balances

    df = ledger.of("balance").join(check_balances(ledger).select("seq", "discrepancy"), "seq", "left")
    c = F.col
    return Table(df, {"date": (c("date"), "date"), "account": (c("account"), "string"), "amount": (c("amount"), "amount"), "tolerance": (c("tolerance"), "decimal"), "discrepancy": (inv.amount(F.nullif(c("discrepancy"), F.lit(0)), c("amount.currency")), "amount"), "meta": (c("meta"), "dict")}, ["seq"])


def _accounts(ledger: Ledger) -> Table:
    o = ledger.of("open").groupBy("account").agg(F.min_by(_entry(ledger), F.col("seq")).alias("_open"))
    x = ledger.of("close").groupBy("account").agg(F.min_by(_entry(ledger), F.col("seq")).alias("_close"))
    df = o.join(x, "account", "full_outer")
    return Table(df, {"account": (F.col("account"), "string"), "open": (F.col("_open"), "entry"), "close": (F.col("_close"), "entry")}, ["account"])


TABLES: dict[str, Callable[[Ledger], Table]] = {
    "postings": postings,
    "entries": entries,
    "balances": _balances,
    "accounts": _accounts,
}


def _plain() -> None:
    _c, _m = F.col, lambda: (F.col("meta"), "dict")
    sets = lambda: {"tags": (_sorted(_c("tags")), "set"), "links": (_sorted(_c("links")), "set")}
    d = lambda: {"date": (_c("date"), "date")}
    TABLES.update(
        {
            "transactions": lambda led: Table(led.of("transaction"), {k: v for k, v in _common().items() if k in ("date", "payee", "narration", "description", "tags", "links")} | {"flag": (_c("flag"), "string"), "accounts": (_c("_accounts"), "set"), "meta": _m()}, ["seq"]),
            "prices": lambda led: Table(led.of("price"), d() | {"currency": (_c("name"), "string"), "amount": (_c("amount"), "amount"), "meta": _m()}, ["seq"]),
            "commodities": lambda led: Table(led.of("commodity"), d() | {"currency": (_c("name"), "string"), "meta": _m()}, ["seq"]),
            "notes": lambda led: Table(led.of("note"), d() | {"account": (_c("account"), "string"), "comment": (_c("comment"), "string"), "meta": _m()} | sets(), ["seq"]),
            "events": lambda led: Table(led.of("event"), d() | {"type": (_c("name"), "string"), "description": (_c("value"), "string"), "meta": _m()}, ["seq"]),
            "documents": lambda led: Table(led.of("document"), d() | {"account": (_c("account"), "string"), "filename": (_c("value"), "string"), "meta": _m()} | sets(), ["seq"]),
        }
    )


_plain()


def table(ledger: Ledger, name: str, used: set[str]) -> Table:
    """The named table; columns that need more than its scan (accounts of a transaction) only if used."""
    t = TABLES[name](ledger)
    if name == "postings" and used & {"accounts", "other_accounts"}:
        t.df = with_accounts(t.df, "other_accounts" in used)
    if name in ("transactions", "entries") and "accounts" in used:
        per = ledger.postings.groupBy("seq").agg(F.array_sort(F.collect_set("account")).alias("_accounts"))
        t.df = t.df.join(per, "seq", "left")
    return t
