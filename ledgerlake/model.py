"""Schemas, options and the ledger bundle.

A ledger is two tables: ``entries`` (one row per directive) and ``postings`` (one row per posting,
with its transaction's columns). ``seq`` is the canonical order of directives; DataFrames have none.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Authored numbers; sums of them, and the numbers of amounts, positions and inventories.
NUM = T.DecimalType(18, 8)
SUM = T.DecimalType(36, 8)


def struct(text: str) -> T.StructType:
    """A flat struct type from ``name type, ...`` (without a session, unlike fromDDL)."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "date": T.DateType(), "boolean": T.BooleanType(), "decimal(18": NUM, "decimal(36": SUM}
    out = []
    for f in text.replace("(18,8)", "(18").replace("(36,8)", "(36").split(","):
        name, kind = f.split()
        out.append(T.StructField(name, kinds[kind]))
    return T.StructType(out)


META_VALUE = struct("kind string, s string, n decimal(18,8), d date, b boolean, currency string")
META = T.MapType(T.StringType(), META_VALUE)
AMOUNT = struct("number decimal(36,8), currency string")
COST = struct("number decimal(18,8), currency string, date date, label string")
COST_SPEC = struct("per_unit decimal(18,8), total decimal(18,8), currency string, date date, label string")
PRICE = struct("number decimal(18,8), currency string, is_total boolean")
POSITION = T.StructType([T.StructField("units", AMOUNT), T.StructField("cost", COST)])
INVENTORY = T.ArrayType(POSITION)

#: Same-day order of directive kinds.
KIND_ORDER = {"option": 0, "plugin": 0, "include": 0, "open": 1, "balance": 2, "pad": 3, "transaction": 4, "close": 6, "price": 7}
OTHER_KIND = 5

ENTRIES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("filename", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("flag", T.StringType()),
        T.StructField("payee", T.StringType()),
        T.StructField("narration", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("account", T.StringType()),
        T.StructField("currencies", T.ArrayType(T.StringType())),
        T.StructField("booking", T.StringType()),
        T.StructField("amount", AMOUNT),
        T.StructField("scale", T.IntegerType()),
        T.StructField("tolerance", NUM),
        T.StructField("pad_account", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("meta", META),
        T.StructField("id", T.StringType()),
    ]
)
POSTINGS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("filename", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("flag", T.StringType()),
        T.StructField("posting_flag", T.StringType()),
        T.StructField("payee", T.StringType()),
        T.StructField("narration", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("account", T.StringType()),
        T.StructField("number", NUM),
        T.StructField("scale", T.IntegerType()),
        T.StructField("currency", T.StringType()),
        T.StructField("cost", COST),
        T.StructField("cost_spec", COST_SPEC),
        T.StructField("price", PRICE),
        T.StructField("meta", META),
        T.StructField("entry_meta", META),
        T.StructField("id", T.StringType()),
    ]
)
#: Postings that the engine makes of sums: one with a ledger's own gives both wide numbers.
WIDE_POSTINGS = T.StructType([T.StructField(f.name, SUM if f.name == "number" else f.dataType) for f in POSTINGS.fields])
DIAGNOSTIC = struct("code string, severity string, seq long, date date, account string, message string")


@dataclass(frozen=True)
class Options:
    """Ledger options that queries and passes use."""

    name_assets: str = "Assets"
    name_liabilities: str = "Liabilities"
    name_equity: str = "Equity"
    name_income: str = "Income"
    name_expenses: str = "Expenses"
    account_previous_balances: str = "Opening-Balances"
    account_previous_earnings: str = "Earnings:Previous"
    account_current_earnings: str = "Earnings:Current"
    tolerance_multiplier: str = "0.5"
    infer_tolerance_from_cost: bool = False
    inferred_tolerance_default: dict[str, str] = field(default_factory=dict)
    booking_method: str = "STRICT"
    operating_currency: tuple[str, ...] = ()
    title: str = ""
    plugin_processing_mode: str = "default"
    other: dict[str, str] = field(default_factory=dict)

    @property
    def roots(self) -> list[str]:
        return [self.name_assets, self.name_liabilities, self.name_equity, self.name_income, self.name_expenses]

    def equity(self, which: str) -> str:
        return f"{self.name_equity}:{getattr(self, which)}"

    def with_option(self, name: str, value: str) -> Options:
        if name == "operating_currency":
            return replace(self, operating_currency=(*self.operating_currency, value))
        if name == "inferred_tolerance_default":
            currency, _, number = value.partition(":")
            return replace(self, inferred_tolerance_default={**self.inferred_tolerance_default, currency: number})
        if name == "infer_tolerance_from_cost":
            return replace(self, infer_tolerance_from_cost=value.upper() == "TRUE")
        if name in self.__dataclass_fields__ and name != "other":
            return replace(self, **{name: value})
        return replace(self, other={**self.other, name: value})


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    entries: DataFrame
    postings: DataFrame
    options: Options = Options()
    diagnostics: DataFrame | None = None

    def of(self, kind: str) -> DataFrame:
        return self.entries.where(F.col("type") == kind)

    @cached_property
    def prices(self) -> DataFrame:
        """seq, date, base, quote, rate."""
        return self.of("price").select("seq", "date", F.col("account").alias("_"), F.col("name").alias("base"), F.col("amount.currency").alias("quote"), F.col("amount.number").alias("rate")).drop("_")

    @cached_property
    def opens(self) -> DataFrame:
        """The first Open of each account."""
        return _first(self.of("open"), "account", ["date", "currencies", "booking", "meta"], "open")

    @cached_property
    def closes(self) -> DataFrame:
        return _first(self.of("close"), "account", ["date", "meta"], "close")

    @cached_property
    def commodities(self) -> DataFrame:
        return _first(self.of("commodity").withColumn("currency", F.col("name")), "currency", ["date", "meta"], "commodity")


def _first(df: DataFrame, key: str, cols: list[str], name: str) -> DataFrame:
    """One row per key, the first in canonical order; columns are ``name``_column."""
    got = df.groupBy(key).agg(F.min_by(F.struct("seq", *cols), F.col("seq")).alias("x"))
    return got.select(key, F.col("x.seq").alias(f"{name}_seq"), *[F.col(f"x.{c}").alias(f"{name}_{c}") for c in cols])


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def kind_order(kind) -> F.Column:
    out = F.lit(OTHER_KIND)
    for k, n in KIND_ORDER.items():
        out = F.when(kind == k, n).otherwise(out)
    return out
