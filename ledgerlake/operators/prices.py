"""As-of price lookup as equi-joins.

Prices are folded to the last of each day, then to one row per pair and month that holds the month's
days (31 at most) and the value carried in from before. A lookup joins on (base, quote, month) and
takes the last day not after its date. No window runs over the prices or the lookups: the carry is a
window over the months of one pair. A direct price wins over an inverse one, whatever their dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE = "decimal(18,8)"


def latest(prices: DataFrame) -> DataFrame:
    """base, quote, rate: the last price of each pair in (date, seq) order."""
    return prices.groupBy("base", "quote").agg(F.max_by("rate", F.struct("date", "seq")).alias("rate"))


def daily(prices: DataFrame) -> DataFrame:
    """base, quote, date, rate: the last price of each pair and day."""
    return prices.groupBy("base", "quote", "date").agg(F.max_by("rate", "seq").alias("rate"))


def inverted(prices: DataFrame) -> DataFrame:
    """Prices read the other way round; a price of 0 has no inverse."""
    inverse = (F.lit(1).cast(RATE) / F.col("rate").cast(RATE)).cast(RATE)
    return prices.where("rate <> 0").select("seq", "date", F.col("quote").alias("base"), F.col("base").alias("quote"), inverse.alias("rate"))


def asof(df: DataFrame, values: DataFrame, keys: list[str], date: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: for each row the ``value`` of the last row of ``values`` (one per keys and day)
    with equal keys and a date not after ``date``; null if there is none. Both sides name keys and date alike."""
    month = F.trunc(date, "MM").alias("_month")
    days = values.groupBy(*keys, month).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).alias("v")))).alias("_days"))
    asked = df.where(F.col(date).isNotNull()).select(*keys, month).distinct()
    months = asked.join(days, [*keys, "_month"], "full_outer")
    before = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_carry", F.last(F.element_at("_days", -1), ignorenulls=True).over(before))
    got = df.withColumn("_month", F.trunc(date, "MM")).join(months, [*keys, "_month"], "left")
    hit = F.filter("_days", lambda x: x["d"] <= F.col(date))
    return got.withColumn(out, F.coalesce(F.when(F.size(hit) > 0, F.element_at(hit, -1)["v"]), F.col("_carry")["v"])).drop("_month", "_days", "_carry")


def attach_rate(df: DataFrame, prices: DataFrame, base: Column, quote: Column, date: Column | None, out: str) -> DataFrame:
    """``df`` with the rate base -> quote at ``date`` (the latest of all if None) in column ``out``."""
    cols = df.columns
    df = df.withColumns({"_base": F.upper(base), "_quote": F.upper(quote)})
    names = {"base": "_base", "quote": "_quote"}
    p = prices.withColumns({"base": F.upper("base"), "quote": F.upper("quote")})
    for flip, name in ((False, "_direct"), (True, "_inverse")):
        side = inverted(p) if flip else p
        if date is None:
            df = df.join(latest(side).withColumnsRenamed(names | {"rate": name}), ["_base", "_quote"], "left")
        else:
            df = asof(df.withColumn("_at", date), daily(side).withColumnsRenamed(names | {"date": "_at"}), ["_base", "_quote"], "_at", "rate", name).drop("_at")
    rate = F.when(F.col("_base") == F.col("_quote"), F.lit(1).cast(RATE)).otherwise(F.coalesce("_direct", "_inverse").cast(RATE))
    return df.withColumn(out, rate).select(*cols, out)
