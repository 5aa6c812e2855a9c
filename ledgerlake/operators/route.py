"""Routing of directives to files, ordered merging, and display precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.hierarchy import with_ancestors


def path_of(account: Column, date: Column, template: str) -> Column:
    """``{account}`` with slashes, ``{root}``, ``{yyyy}``, ``{mm}``, ``{yyyymm}`` filled in."""
    parts = {"account": F.regexp_replace(account, ":", "/"), "root": F.substring_index(account, ":", 1), "yyyy": F.date_format(date, "yyyy"), "mm": F.date_format(date, "MM"), "yyyymm": F.date_format(date, "yyyyMM")}
    out = F.lit(template)
    for k, v in parts.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v, F.lit("none")))
    return out


def transaction_account(postings: DataFrame, strategy: str = "first-posting", key: str = "route-account") -> DataFrame:
    """seq, account that decides where a transaction goes: its metadata, a marked posting, the strategy, the first posting."""
    mark = F.try_element_at("entry_meta", F.lit(key))["s"]
    chosen = F.when(F.coalesce(F.try_element_at("meta", F.lit(key))["b"], F.lit(False)), F.col("idx"))
    sign = {"first-debit": F.col("number") > 0, "first-credit": F.col("number") < 0}.get(strategy, F.lit(True))
    ranked = F.when(sign, F.col("idx"))
    pick = F.max_by("account", "idx") if strategy == "last-posting" else F.min_by("account", ranked)
    return postings.groupBy("seq").agg(F.coalesce(F.min(mark), F.min_by("account", chosen), pick, F.min_by("account", "idx")).alias("account"))


def route(directives: DataFrame, template: str, overrides: DataFrame | None = None) -> DataFrame:
    """``directives`` (seq, account, date, ...) with ``path``; the longest matching account prefix of
    ``overrides`` (account, template) replaces the template."""
    df = directives.withColumn("path", path_of(F.col("account"), F.col("date"), template))
    if overrides is None:
        return df
    keys = with_ancestors(directives.select("account").distinct()).join(overrides.select(F.col("account").alias("ancestor"), F.col("template")), "ancestor")
    best = keys.groupBy("account").agg(F.max_by("template", "ancestor_depth").alias("_t"))
    named = F.col("_t")
    for k, v in {"account": F.regexp_replace("account", ":", "/"), "root": F.substring_index("account", ":", 1), "yyyy": F.date_format("date", "yyyy"), "mm": F.date_format("date", "MM"), "yyyymm": F.date_format("date", "yyyyMM")}.items():
        named = F.replace(named, F.lit("{" + k + "}"), F.coalesce(v, F.lit("none")))
    return df.join(best, "account", "left").withColumn("path", F.coalesce(named, F.col("path"))).drop("_t")


def merged(routed: DataFrame, descending: bool = False) -> DataFrame:
    """Rows range-sorted by path and date, ready to be written with ``partitionBy('path')``."""
    day = F.col("date").desc() if descending else F.col("date").asc()
    return routed.repartition("path").sortWithinPartitions("path", day, "seq")


def display_precision(postings: DataFrame) -> DataFrame:
    """currency, digits: the most common number of fraction digits, the larger of equally common ones."""
    n = postings.where("scale is not null and currency is not null").groupBy("currency", "scale").count()
    return n.groupBy("currency").agg(F.max_by("scale", F.struct("count", "scale")).alias("digits"))


def price_requests(commodities: DataFrame, key: str = "price") -> DataFrame:
    """currency, quote, level, source, symbol from metadata like ``USD:src/SYM,other/SYM2 EUR:src/^SYM3`` (^: inverted)."""
    text = F.try_element_at("meta", F.lit(key))["s"]
    spec = commodities.select(F.col("name").alias("currency"), F.explode(F.split(text, r"\s+")).alias("x")).where("x <> ''")
    chain = spec.select("currency", F.substring_index("x", ":", 1).alias("quote"), F.posexplode(F.split(F.regexp_replace("x", "^[^:]*:", ""), ",")).alias("level", "y"))
    symbol = F.regexp_replace("y", "^[^/]*/", "")
    return chain.select("currency", "quote", "level", F.substring_index("y", "/", 1).alias("source"), F.regexp_replace(symbol, r"^\^", "").alias("symbol"), F.startswith(symbol, F.lit("^")).alias("inverted"))


def fetch(requests: DataFrame, sources: dict, mode: str = "latest") -> DataFrame:
    """Level by level: what a level's sources don't answer goes to the next. A source is a function
    (requests, mode) -> quotes (currency, quote, date, rate)."""
    found, level = None, 0
    open_ = requests
    top = requests.agg(F.max("level")).first()[0]
    while top is not None and level <= top:
        for name, source in sources.items():
            got = source(open_.where((F.col("level") == level) & (F.col("source") == name)), mode)
            found = got if found is None else found.unionByName(got)
        if found is not None:
            open_ = open_.join(found.select("currency", "quote").distinct(), ["currency", "quote"], "left_anti")
        level += 1
    return found


def merge_prices(old: DataFrame, new: DataFrame, keep: str = "first") -> DataFrame:
    """One price per (date, base, quote): of the first (old before new) or the last."""
    every = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    order = F.struct("_n", "seq")
    pick = F.min_by if keep == "first" else F.max_by
    return every.groupBy("date", "base", "quote").agg(pick("rate", order).alias("rate"), pick("seq", order).alias("seq"))
