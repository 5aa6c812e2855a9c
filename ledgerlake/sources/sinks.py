"""Sinks: text table, CSV and JSON with nested values, ledger text, price files, routed files."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.scalars import display
from ledgerlake.plans.compiler import plain


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


@F.pandas_udf(T.IntegerType())
def _widths(s: pd.Series) -> pd.Series:
    return s.map(lambda x: 0 if x is None else _width(x)).astype("int32")


def text_lines(df: DataFrame) -> Iterator[str]:
    """The lines of an aligned table for people. Widths are an aggregate and rows stream, so the driver never holds all. Numbers and amounts stand right."""
    right = [t.startswith(("decimal", "bigint", "int", "struct<number")) for _, t in df.dtypes]
    shown = plain(df)
    cells = [(display(F.col(f"`{n}`"), "decimal") if t.startswith("decimal") else F.col(f"`{n}`").cast("string")) for n, t in shown.dtypes]
    shown = shown.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    most = shown.select(*[_widths(c).alias(c) for c in shown.columns]).agg(*[F.max(c) for c in shown.columns]).first()
    widths = [max(_width(n), w or 0) for n, w in zip(df.columns, most, strict=True)]
    pad = lambda s, i: " " * (widths[i] - _width(s)) + s if right[i] else s + " " * (widths[i] - _width(s))
    line = lambda r: "  ".join(pad(s, i) for i, s in enumerate(r)).rstrip()
    yield line(df.columns)
    yield "  ".join("-" * w for w in widths)
    for r in shown.toLocalIterator():
        yield line(["" if v is None else v for v in r])


def text_table(df: DataFrame, limit: int | None = None) -> str:
    """The table as one text; ``limit`` rows of it at most, where given."""
    return "\n".join(text_lines(df if limit is None else df.limit(limit))) + "\n"


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as CSV text: NULL is empty, inventories and sets are records of their own, dicts ``k:v`` lists."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if t.startswith("array<struct<units"):
            v = F.array_join(F.transform(c, lambda p: _quoted(display(p, "position"))), ",")
        elif t == "array<string>":
            v = F.array_join(F.transform(c, _quoted), ",")
        elif t.startswith("map"):
            v = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(display(e["value"], "meta"), F.lit("")))), ",")
        elif t.startswith("struct<units"):
            v = display(c, "position")
        elif t.startswith("struct<number"):
            v = display(c, "amount")
        elif t.startswith("decimal"):
            v = display(c, "decimal")
        elif t == "boolean":
            v = display(c, "bool")
        else:
            v = c.cast("string")
        out.append(F.coalesce(v, F.lit("")).alias(n))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, columns in order, decimals as strings, nulls kept."""

    def tree(c: Column, t: str) -> Column:
        if t.startswith("decimal"):
            return display(c, "decimal")
        if t.startswith("struct<number"):
            return F.when(c.isNotNull(), F.struct(display(c["number"], "decimal").alias("number"), c["currency"].alias("currency")))
        if t.startswith("struct<units"):
            return F.when(c.isNotNull(), F.struct(tree(c["units"], "struct<number").alias("units"), F.when(c["cost"].isNotNull(), F.struct(display(c["cost"]["number"], "decimal").alias("number"), c["cost"]["currency"].alias("currency"), c["cost"]["date"].alias("date"), c["cost"]["label"].alias("label"))).alias("cost")))
        if t.startswith("array<struct<units"):
            return F.transform(c, lambda p: tree(p, "struct<units"))
        return c

    return df.select(F.to_json(F.struct(*[tree(F.col(f"`{n}`"), t).alias(n) for n, t in df.dtypes]), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.text(path)


def _string(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '(["\\\\])', r"\\\\$1"), F.lit('"'))


def posting_lines(postings: DataFrame) -> DataFrame:
    """seq, idx, line: postings as ledger text."""
    cost = F.when(F.col("cost").isNotNull(), F.concat(F.lit(" {"), display(F.col("cost.number"), "decimal"), F.lit(" "), F.col("cost.currency"), F.coalesce(F.concat(F.lit(", "), F.col("cost.date").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(', "'), F.col("cost.label"), F.lit('"')), F.lit("")), F.lit("}"))).otherwise("")
    price = F.when(F.col("price.number").isNotNull(), F.concat(F.when(F.col("price.is_total"), " @@ ").otherwise(" @ "), display(F.col("price.number"), "decimal"), F.lit(" "), F.col("price.currency"))).otherwise("")
    amount = F.when(F.col("number").isNotNull(), F.concat(F.lit("  "), display(F.col("number"), "decimal"), F.lit(" "), F.col("currency"))).otherwise("")
    flag = F.coalesce(F.concat("posting_flag", F.lit(" ")), F.lit(""))
    return postings.select("seq", "idx", F.concat(F.lit("  "), flag, F.col("account"), amount, cost, price).alias("line"))


def entry_text(ledger) -> DataFrame:
    """seq, date, text: every directive printed as ledger text."""
    e, c = ledger.entries, F.col
    tags = F.concat(F.array_join(F.transform(F.coalesce(c("tags"), F.array().cast("array<string>")), lambda t: F.concat(F.lit(" #"), t)), ""), F.array_join(F.transform(F.coalesce(c("links"), F.array().cast("array<string>")), lambda t: F.concat(F.lit(" ^"), t)), ""))
    amount = display(c("amount"), "amount")
    head = F.date_format("date", "yyyy-MM-dd")
    kinds = {
        "transaction": F.concat(head, F.lit(" "), c("flag"), F.when(c("payee").isNotNull(), F.concat(F.lit(" "), _string(c("payee")))).otherwise(""), F.lit(" "), _string(c("narration")), tags),
        "open": F.concat(head, F.lit(" open "), c("account"), F.when(F.size("currencies") > 0, F.concat(F.lit(" "), F.array_join("currencies", ","))).otherwise(""), F.when(c("booking").isNotNull(), F.concat(F.lit(" "), _string(c("booking")))).otherwise("")),
        "close": F.concat(head, F.lit(" close "), c("account")),
        "commodity": F.concat(head, F.lit(" commodity "), c("name")),
        "balance": F.concat(head, F.lit(" balance "), c("account"), F.lit(" "), display(c("amount.number"), "decimal"), F.when(c("tolerance").isNotNull(), F.concat(F.lit(" ~ "), display(c("tolerance"), "decimal"))).otherwise(""), F.lit(" "), c("amount.currency")),
        "pad": F.concat(head, F.lit(" pad "), c("account"), F.lit(" "), c("pad_account")),
        "note": F.concat(head, F.lit(" note "), c("account"), F.lit(" "), _string(c("comment")), tags),
        "document": F.concat(head, F.lit(" document "), c("account"), F.lit(" "), _string(c("value")), tags),
        "event": F.concat(head, F.lit(" event "), _string(c("name")), F.lit(" "), _string(c("value"))),
        "query": F.concat(head, F.lit(" query "), _string(c("name")), F.lit(" "), _string(c("value"))),
        "price": F.concat(head, F.lit(" price "), c("name"), F.lit(" "), amount),
        "custom": F.concat(head, F.lit(" custom "), _string(c("name"))),
    }
    first = F.lit(None).cast("string")
    for k, v in kinds.items():
        first = F.when(c("type") == k, v).otherwise(first)
    legs = posting_lines(ledger.postings).groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("_legs"))
    return e.join(legs, "seq", "left").select("seq", "date", F.concat(first, F.coalesce(F.concat(F.lit("\n"), c("_legs")), F.lit("")), F.lit("\n")).alias("text"))


def write_ledger(ledger, path: str) -> None:
    """Range-sorted ledger text, a file per range."""
    entry_text(ledger).orderBy("seq").select("text").write.text(path)


def write_prices(prices: DataFrame, path: str) -> None:
    """One price directive per day and pair, in order."""
    once = prices.groupBy("date", "base", "quote").agg(F.max_by("rate", "seq").alias("rate")).orderBy("date", "base", "quote")
    once.select(F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.lit("price"), F.col("base"), display(F.col("rate"), "decimal"), F.col("quote"))).write.text(path)


def write_routed(df: DataFrame, path: str, column: str = "path") -> None:
    """One folder per value of ``column``."""
    from ledgerlake.operators.route import merged

    merged(df).write.partitionBy(column).parquet(path)
