"""Positions and inventories as column expressions, and the running inventory.

An inventory is an array of positions, canonically sorted, without zero positions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.model import INVENTORY, NUM, SUM


def times(a: Column, b: Column) -> Column:
    """a * b to 8 digits, for a of up to 19 digits before the point and b an authored number.

    Spark's product of two wide decimals loses digits, so the whole part and the rest of ``a`` are multiplied apart.
    """
    size, b = F.abs(a.cast(SUM)), b.cast(NUM)
    whole = F.floor(size).cast("decimal(19,0)")
    rest = (size - whole).cast("decimal(9,8)")
    got = (whole * b).cast(SUM) + (rest * b).cast("decimal(28,8)")
    return F.when(a < 0, -got).otherwise(got).cast(SUM)


def amount(number: Column, currency: Column) -> Column:
    return F.when(number.isNotNull() & currency.isNotNull(), F.struct(number.cast(SUM).alias("number"), currency.alias("currency")))


def position(number: Column, currency: Column, cost: Column) -> Column:
    return F.when(number.isNotNull(), F.struct(F.struct(number.cast(SUM).alias("number"), currency.alias("currency")).alias("units"), cost.alias("cost")))


def cost_of(p: Column) -> Column:
    """units x cost of a position; null without a lot."""
    return F.when(p["cost"].isNotNull(), F.struct(times(p["units"]["number"], p["cost"]["number"]).alias("number"), p["cost"]["currency"].alias("currency")))


def bare(a: Column) -> Column:
    """An amount as a position without a lot."""
    none = F.lit(None).cast("struct<number:decimal(18,8),currency:string,date:date,label:string>")
    return F.when(a.isNotNull(), F.struct(F.struct(a["number"].cast(SUM).alias("number"), a["currency"].alias("currency")).alias("units"), none.alias("cost")))


def regroup(inv: Column) -> Column:
    """Equal (currency, lot) merged, zeros dropped, sorted; for arrays of a few positions."""
    key = lambda p: F.struct(p["units"]["currency"].alias("c"), p["cost"].alias("l"))
    keys = F.array_sort(F.array_distinct(F.transform(inv, key)))

    def total(k):
        mine = F.filter(inv, lambda p: key(p).eqNullSafe(k))
        n = F.aggregate(mine, F.lit(0).cast(SUM), lambda a, p: (a + p["units"]["number"]).cast(SUM))
        return F.struct(F.struct(n.cast(SUM).alias("number"), k["c"].alias("currency")).alias("units"), k["l"].alias("cost"))

    return F.filter(F.transform(keys, total), lambda p: p["units"]["number"] != 0)


def map_units(inv: Column, f) -> Column:
    return F.transform(inv, lambda p: F.struct(F.struct(f(p["units"]["number"]).cast(SUM).alias("number"), p["units"]["currency"].alias("currency")).alias("units"), p["cost"].alias("cost")))


def only(currency: Column, inv: Column) -> Column:
    n = F.aggregate(F.filter(inv, lambda p: p["units"]["currency"] == currency), F.lit(0).cast(SUM), lambda a, p: (a + p["units"]["number"]).cast(SUM))
    return F.when(inv.isNotNull() & currency.isNotNull(), F.struct(n.cast(SUM).alias("number"), currency.alias("currency")))


def sum_positions(df: DataFrame, keys: list[str], pos: str, out: str) -> DataFrame:
    """One row per ``keys`` with the inventory of column ``pos``: sums per lot first, then one array per group."""
    lots = df.groupBy(*keys, F.col(f"{pos}.units.currency").alias("_c"), F.col(f"{pos}.cost").alias("_l")).agg(F.sum(f"{pos}.units.number").alias("_n"))
    return lots.groupBy(*keys).agg(_whole("_c", "_l", "_n").alias(out))


def _whole(c: str, lot: str, n: str, mine: Column | None = None) -> Column:
    """The inventory of a group's lots, of those that are ``mine``."""
    some = F.col(n) != 0 if mine is None else mine & (F.col(n) != 0)
    one = F.when(some, F.struct(F.col(c).alias("c"), F.col(lot).alias("l"), F.col(n).cast(SUM).alias("n")))
    return F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(F.struct(x["n"].alias("number"), x["c"].alias("currency")).alias("units"), x["l"].alias("cost")))


def sums_beside(df: DataFrame, keys: list[str], aggs: dict[str, Column], wholes: dict[str, str]) -> DataFrame:
    """``aggs`` of each group of ``keys`` (there is one at least) and ``sum_positions`` of each position column of ``wholes``, under its name there.

    Groups and their lots are sets of one grouping, so that ``df`` is computed once.
    """
    cols = [f"_{x}{i}" for i in range(len(wholes)) for x in "cl"]
    df = df.withColumns({f"_{x}{i}": F.col(f"{pos}.{of}") for i, pos in enumerate(wholes) for x, of in (("c", "units.currency"), ("l", "cost"), ("n", "units.number"))})
    sets = [keys, *[[*keys, f"_c{i}", f"_l{i}"] for i in range(len(wholes))]]
    got = df.groupingSets(sets, *keys, *cols).agg(F.grouping_id().alias("_id"), *[a.alias(k) for k, a in aggs.items()], *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(wholes))])
    none = (1 << len(cols)) - 1  # a bit for each column that a set leaves out, the last one's lowest
    mine = lambda i: F.col("_id") == none - (3 << (len(cols) - 2 - 2 * i))
    first = F.first(F.when(F.col("_id") == none, F.struct(*aggs)), ignorenulls=True).alias("_s")
    return got.groupBy(*keys).agg(first, *[_whole(f"_c{i}", f"_l{i}", f"_n{i}", mine(i)).alias(out) for i, out in enumerate(wholes.values())]).select(*keys, "_s.*", *wholes.values())


#: Rows of a range of the order, about; there are at least ``RANGES``.
RANGE_ROWS, RANGES = 200_000, 64


def _ranges(df: DataFrame, first: str, buckets: int | None) -> tuple[DataFrame, float] | None:
    """``df`` with its ``_range`` of the first order column, and how many there are; None if there are no rows."""
    low, high, n = df.agg(F.min(first).cast("double"), F.max(first).cast("double"), F.count("*")).first()
    if low is None:
        return None
    buckets = buckets or max(RANGES, -(-n // RANGE_ROWS))
    width = max(1.0, (high - low + 1) / buckets)
    # Spark may compute it for rows that a filter takes out, whose numbers are anywhere
    return df.withColumn("_range", F.floor((F.col(first).cast("double") - low) / width).try_cast("int")), buckets


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """``out``: the sum of ``value`` up to and including each row, in ``order`` within ``keys``.

    The first order column (a number) is cut into ranges; sums of earlier ranges come from a small
    table, so a window holds one range of one key, not the whole key.
    """
    cut = _ranges(df, order[0], buckets)
    if cut is None:
        return df.withColumn(out, F.lit(None).cast(SUM))
    df, _ = cut
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = df.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_inner", F.sum(value).over(inner)).join(ahead, [*keys, "_range"]).withColumn(out, F.col("_inner") + F.col("_ahead")).drop("_range", "_inner", "_ahead")


def fifo_overlap(lines: DataFrame, key: str, order: list[str], width: int = 64, buckets: int = 64) -> DataFrame:
    """``key``, lot, sale, units: FIFO matching of sales to lots as an overlap of cumulative ranges, joined on the units' buckets.

    lines: ``key``, sale (boolean), q (whole units) and the ``order`` columns, the first a number. As in ``running_sum``
    the order is cut into ranges, so a window holds one range of one key; places and sums come from the same window.
    """
    first = order[0]
    edge = lines.agg(F.min(first).cast("double"), F.max(first).cast("double")).first()
    lo, step = edge[0] or 0.0, max(1.0, ((edge[1] or 0.0) - (edge[0] or 0.0) + 1) / buckets)
    keys = [key, "sale"]
    li = lines.withColumn("_range", F.floor((F.col(first).cast("double") - lo) / step).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = li.groupBy(*keys, "_range").agg(F.count("*").alias("_c"), F.sum("q").alias("_s"))
    ahead = ahead.select(*keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_q0"))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order)
    li = li.withColumns({"_n": F.row_number().over(inner), "_hi": F.sum("q").over(inner.rowsBetween(Window.unboundedPreceding, 0))}).join(ahead, [*keys, "_range"])
    li = li.select(key, "sale", "q", (F.col("_n") + F.col("_n0")).alias("n"), (F.col("_hi") + F.col("_q0")).alias("hi"))
    li = li.withColumn("b", F.explode(F.sequence(F.floor((F.col("hi") - F.col("q")) / width), F.floor((F.col("hi") - 1) / width))))
    lots = li.where("not sale").select(key, "b", F.col("n").alias("lot"), (F.col("hi") - F.col("q")).alias("lo1"), F.col("hi").alias("hi1"))
    sales = li.where("sale").select(key, "b", F.col("n").alias("sale_"), (F.col("hi") - F.col("q")).alias("lo2"), F.col("hi").alias("hi2"))
    j = lots.join(sales, [key, "b"]).where("hi1 > lo2 and hi2 > lo1").drop("b").distinct()
    return j.select(key, "lot", F.col("sale_").alias("sale"), (F.least("hi1", "hi2") - F.greatest("lo1", "lo2")).alias("units"))


def running_inventory(df: DataFrame, order: list[str], pos: str, out: str, buckets: int | None = None) -> DataFrame:
    """``out``: the inventory of all rows up to and including each row.

    Ranges of the first order column are folded apart, each from the inventory that the ranges before it leave (a row
    per range and lot held then); within a range the fold is one pass.
    """
    cut = _ranges(df, order[0], buckets)
    if cut is None:
        return df.withColumn(out, F.lit(None).cast(INVENTORY))
    df, n_ranges = cut
    lots = df.groupBy("_range", F.col(f"{pos}.units.currency").alias("c"), F.col(f"{pos}.cost").alias("l")).agg(F.sum(f"{pos}.units.number").alias("n")).where("n is not null")
    # a lot's sum up to a range holds for the ranges after it, as far as the next one that changes it
    of_lot = Window.partitionBy("c", "l").orderBy("_range")
    start = lots.withColumns({"n": F.sum("n").over(of_lot), "_next": F.coalesce(F.lead("_range").over(of_lot), F.lit(int(n_ranges) + 1))}).where("n <> 0")
    start = start.withColumn("_range", F.explode(F.sequence(F.col("_range") + 1, "_next"))).select("_range", "c", "l", "n")
    schema = T.StructType([*df.schema.fields, T.StructField(out, INVENTORY)])

    def lot_key(c, lot):
        return (c, None if lot is None else (lot["number"], lot["currency"], lot["date"], lot["label"]))

    def sort_key(k):
        c, lot = k
        return (c or "", lot is not None, tuple((x is not None, str(x)) for x in lot) if lot else ())

    def fold(rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        have = {lot_key(c, lot): n for c, lot, n in zip(begin["c"], begin["l"], begin["n"], strict=True) if n}
        out_col = []
        rows = rows.sort_values(order, kind="stable")
        for p in rows[pos]:
            if p is not None:
                k = lot_key(p["units"]["currency"], p["cost"])
                n = have.get(k, 0) + p["units"]["number"]
                if n:
                    have[k] = n
                else:
                    have.pop(k, None)
            out_col.append([{"units": {"number": n, "currency": k[0]}, "cost": None if k[1] is None else dict(zip(("number", "currency", "date", "label"), k[1], strict=True))} for k, n in sorted(have.items(), key=lambda x: sort_key(x[0]))])
        rows[out] = out_col
        return rows

    start = start.join(df.select("_range").distinct(), "_range", "left_semi")  # ranges without rows need none
    return df.groupBy("_range").cogroup(start.groupBy("_range")).applyInPandas(fold, schema).drop("_range")


