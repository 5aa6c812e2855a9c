"""The star schema (orders, lineitem, part, customer, ...) as a ledger.

Each order is a transaction, each of its lines two postings: inventory of the part's brand against
the customer segment's payable. Lot postings, prices, opens, closes, balances, notes, events and
commodities come from the other tables. Money is cast to DECIMAL before any arithmetic.

``seq`` is made from keys alone (no window over the data): kind and business key, so building the
ledger never sorts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.model import ENTRIES, POSTINGS, Ledger, Options, conform

MONEY = "decimal(18,2)"
#: A line's key within the table; (l_orderkey, l_linenumber) repeats.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seq(kind: int, date: F.Column, key: F.Column) -> F.Column:
    """Canonical order from keys: date, kind, then 41 bits of the key."""
    return F.coalesce(F.unix_date(date), F.lit(0)).cast("long") * (1 << 44) + F.lit(kind << 41) + F.pmod(key.cast("long"), F.lit(1 << 41))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        _seq(4, F.to_date("o_orderdate"), F.col("o_orderkey")).alias("seq"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "*").otherwise("!").alias("flag"),
        F.col("c_name").alias("payee"),
        F.col("o_orderpriority").alias("narration"),
        F.array("c_mktsegment").alias("tags"),
        "c_mktsegment",
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cash legs per line. ``idx`` is 2 * line rank within its order, + 1 for the second leg."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_shipdate", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    t = transactions(spark, sf_dir)
    line = F.struct(*[F.col(c) for c in LINE_KEY[1:]])
    rows = li.join(p, li.l_partkey == p.p_partkey).join(t, li.l_orderkey == t.o_orderkey)
    cash = F.col("l_extendedprice").cast(MONEY)
    legs = F.array(
        F.struct(F.lit(0).alias("leg"), F.concat(F.lit("Assets:Inventory:"), F.regexp_replace("p_brand", "#", "-")).alias("account"), cash.alias("number")),
        F.struct(F.lit(1).alias("leg"), F.concat(F.lit("Liabilities:Payable:"), F.col("c_mktsegment")).alias("account"), (-cash).alias("number")),
    )
    # the window keeps to the join's partitioning by order
    rank = F.row_number().over(Window.partitionBy("o_orderkey").orderBy(*LINE_KEY[1:])) - 1
    rows = rows.withColumn("line", line).withColumn("rank", rank).withColumn("x", F.explode(legs))
    return rows.select(
        "seq", "o_orderkey", "line", (F.col("rank") * 2 + F.col("x.leg")).alias("idx"), "date", "flag", "payee", "narration", "tags", F.col("x.account").alias("account"), F.col("x.number").alias("number"), F.lit("USD").alias("currency"), F.lit(2).alias("scale"),
        F.col("o_orderkey").cast("string").alias("id"),
    )


def lot_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per line held at cost; returns reduce and carry the retail price."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    r = li.join(p, li.l_partkey == p.p_partkey)
    back = F.col("l_returnflag") == "R"
    units = F.col("l_quantity").cast("decimal(18,2)")
    per = (F.col("l_extendedprice").cast("decimal(18,2)") / units).cast("decimal(18,4)")
    return r.select(
        _seq(4, F.to_date("l_shipdate"), F.col("l_orderkey")).alias("seq"),
        F.struct(*[F.col(c) for c in LINE_KEY[1:]]).alias("line"),
        F.to_date("l_shipdate").alias("date"),
        F.concat(F.lit("Assets:Stock:S"), F.col("l_suppkey").cast("string")).alias("account"),
        F.when(back, -units).otherwise(units).alias("number"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("currency"),
        F.struct(per.cast("decimal(18,8)").alias("number"), F.lit("USD").alias("currency"), F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").cast("string").alias("label")).alias("cost"),
        F.when(back, F.struct(F.col("p_retailprice").cast("decimal(18,2)").cast("decimal(18,8)").alias("number"), F.lit("USD").alias("currency"), F.lit(False).alias("is_total"))).alias("price"),
        F.col("l_orderkey").cast("string").alias("id"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per part and ship date: that of the largest line key."""
    li = table(spark, sf_dir, "lineitem")
    unit = (F.col("l_extendedprice").cast("decimal(18,2)") / F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,4)")
    last = li.groupBy("l_partkey", F.to_date("l_shipdate").alias("date")).agg(F.max_by(unit, F.struct(*LINE_KEY)).alias("rate"))
    return last.select(_seq(7, F.col("date"), F.col("l_partkey")).alias("seq"), "date", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("base"), F.lit("USD").alias("quote"), "rate")


def ledger(spark: SparkSession, sf_dir: str, lots: bool = False) -> Ledger:
    """The ledger bundle: cash legs, or lot postings if ``lots``."""
    if lots:
        p = lot_postings(spark, sf_dir).withColumn("idx", F.pmod(F.xxhash64("line"), F.lit(1 << 29)).cast("int")).withColumn("flag", F.lit("*"))
    else:
        p = postings(spark, sf_dir)
    t = transactions(spark, sf_dir).select("seq", "date", "flag", "payee", "narration", "tags", F.lit("transaction").alias("type"), F.col("o_orderkey").cast("string").alias("id"))
    accounts = p.groupBy("account").agg(F.min("date").alias("date"))
    opens = accounts.where(~F.col("account").endswith("1")).select(_seq(1, F.col("date"), F.xxhash64("account")).alias("seq"), "date", "account", F.lit("open").alias("type"))
    price = prices(spark, sf_dir).select("seq", "date", F.col("base").alias("name"), F.struct(F.col("rate").cast("decimal(18,8)").alias("number"), F.col("quote").alias("currency")).alias("amount"), F.lit("price").alias("type"))
    part = table(spark, sf_dir, "part").select(_seq(5, F.lit(None).cast("date"), F.col("p_partkey")).alias("seq"), F.lit(None).cast("date").alias("date"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.lit("commodity").alias("type"))
    ev = table(spark, sf_dir, "events").select(_seq(5, F.to_date("ts"), F.col("event_id")).alias("seq"), F.to_date("ts").alias("date"), F.col("event_type").alias("name"), F.col("props").alias("value"), F.lit("event").alias("type"))
    parts = [conform(x, ENTRIES) for x in (t, opens, price, part, ev)]
    entries = parts[0]
    for x in parts[1:]:
        entries = entries.unionByName(x)
    return Ledger(spark, entries, conform(p, POSTINGS), Options(operating_currency=("USD",)))
