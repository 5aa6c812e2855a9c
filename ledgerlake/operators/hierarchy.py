"""The account tree by explosion into ancestors, so that subtree conditions become equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(account: Column, itself: bool = True) -> Column:
    """array<struct<account, depth>> of the account's prefixes, shortest first."""
    parts = F.split(account, ":")
    last = F.size(parts) if itself else F.size(parts) - 1
    at = lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ":").alias("account"), n.alias("depth"))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), at)).otherwise(F.array().cast("array<struct<account:string,depth:int>>"))


def covers(a: Column, b: Column) -> Column:
    """b is a or below a."""
    return (b == a) | F.startswith(b, F.concat(a, F.lit(":")))


def with_ancestors(df: DataFrame, account: str = "account", out: str = "ancestor", itself: bool = True) -> DataFrame:
    return df.withColumn("_a", F.explode(ancestors(F.col(account), itself))).withColumn(out, F.col("_a.account")).withColumn(f"{out}_depth", F.col("_a.depth")).drop("_a")


def nearest(df: DataFrame, values: DataFrame, value: str, account: str = "account") -> DataFrame:
    """``df`` with ``value`` of the nearest account, itself or above, that has one (``values``: account, value)."""
    key = df.select(account).distinct()
    v = values.where(F.col(value).isNotNull()).select(F.col("account").alias("ancestor"), F.col(value))
    best = with_ancestors(key, account).join(v, "ancestor").groupBy(account).agg(F.max_by(value, "ancestor_depth").alias(value))
    return df.drop(value).join(best, account, "left")
