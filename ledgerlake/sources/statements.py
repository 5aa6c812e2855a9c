"""CSV statements as DataFrames: reading with banners, number and row helpers, saved rate files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reader:
    """How a statement is laid out.

    ``header``: column names that the header line must hold (it is searched past a banner of any
    length); ``columns``: names for a file without one; ``skip``: lines to leave out first.
    """

    delimiter: str = ","
    charset: str = "UTF-8"
    quote: str = '"'
    header: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    skip: int = 0

    def records(self, spark: SparkSession, path: str) -> DataFrame:
        """A row per record: ``_file``, ``_line`` and the named columns as text. A statement is one task's file."""
        lines = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), F.posexplode(F.split(F.regexp_replace(F.decode("content", self.charset), "^\ufeff", ""), "\r?\n")).alias("_line", "_text"))
        lines = lines.where((F.col("_line") >= self.skip) & (F.trim("_text") != ""))
        cells = lines.withColumn("_cells", self._split(F.col("_text")))
        if self.columns:
            return cells.select("_file", "_line", *[F.get("_cells", k).alias(c) for k, c in enumerate(self.columns)])
        if not self.header:
            raise ValueError("a reader needs header or columns")
        want = F.array(*[F.lit(h) for h in self.header])
        is_header = F.size(F.array_except(want, F.transform("_cells", F.trim))) == 0
        heads = cells.where(is_header).groupBy("_file").agg(F.min_by("_cells", "_line").alias("_names"), F.min("_line").alias("_at"))
        body = cells.join(heads, "_file").where("_line > _at")
        pick = lambda h: F.get("_cells", F.array_position(F.transform("_names", F.trim), h).cast("int") - 1)
        return body.select("_file", "_line", *[pick(h).alias(h) for h in self.header])

    def _split(self, text: Column) -> Column:
        """Cells of a line, quotes honoured (a quote inside quotes is doubled)."""
        d, q = self.delimiter, self.quote
        rx = rf"(?:^|\Q{d}\E)(\Q{q}\E(?:[^{q}]|{q}{q})*\Q{q}\E|[^{d}]*)"
        raw = F.regexp_extract_all(text, F.lit(rx), F.lit(1))
        return F.transform(raw, lambda x: F.when(F.startswith(x, F.lit(q)), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(q + q), F.lit(q))).otherwise(x))


def exclude(df: DataFrame, column: str | None, regex: str) -> DataFrame:
    """Rows whose column (any column if None) matches go."""
    cols = [column] if column else [c for c in df.columns if not c.startswith("_")]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).rlike(regex), F.lit(False))
    return df.where(~hit)


def number(c: Column, thousands: str = ",", decimal: str = ".", placeholders: tuple[str, ...] = ("", "-")) -> Column:
    """A number as banks write it; placeholders and what is no number give NULL. (1.00) and 1.00- are negative."""
    s = F.trim(c)
    sign = F.when(s.rlike(r"^\(.*\)$") | s.endswith("-"), -1).otherwise(1)
    bare = F.regexp_replace(F.regexp_replace(s, r"[()\s]", ""), "-$", "")
    plain = F.replace(F.replace(bare, F.lit(thousands), F.lit("")), F.lit(decimal), F.lit("."))
    return F.when(~s.isin(*placeholders), plain.try_cast("decimal(18,8)") * sign).cast("decimal(18,8)")


def split_currency(c: Column) -> tuple[Column, Column]:
    """(number text, currency) of ``12.50 USD`` or ``12.50USD``."""
    rx = r"^\s*(.*?)\s*([A-Z]{3})?\s*$"
    return F.regexp_extract(c, rx, 1), F.nullif(F.regexp_extract(c, rx, 2), F.lit(""))


def row_hash(name: str, *cols: Column) -> Column:
    """16 hex digits that tell a row again: importer name and trimmed fields."""
    return F.substring(F.sha2(F.concat_ws("\x1e", F.lit(name), *[F.trim(F.coalesce(c, F.lit(""))) for c in cols]), 256), 1, 16)


def ecb_quotes(spark: SparkSession, path: str) -> DataFrame:
    """seq, date, base (EUR), quote, rate from saved daily or historical rate files of the central bank."""

    def rows(content: bytes) -> list[tuple]:
        out = []
        for day in ET.fromstring(content).findall('.//{*}Cube[@time]'):
            for c in day.findall("{*}Cube"):
                if c.get("currency"):
                    out.append((day.get("time"), c.get("currency"), c.get("rate")))
        return out

    import pandas as pd

    def run(batches):
        for pdf in batches:
            got = [r for x in pdf["content"] for r in rows(bytes(x))]
            yield pd.DataFrame(got, columns=["date", "quote", "rate"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "date string, quote string, rate string")
    return raw.select(F.xxhash64("date", "quote").alias("seq"), F.to_date("date").alias("date"), F.lit("EUR").alias("base"), "quote", F.col("rate").cast("decimal(18,8)").alias("rate"))


def quotes(prices: DataFrame, mode: str = "latest", at: str | None = None, since: str | None = None) -> DataFrame:
    """latest, at (the last not after a day), or range (since..at) of a saved price table."""
    if mode == "range":
        return prices.where(F.col("date").between(F.lit(since).cast("date"), F.lit(at).cast("date")))
    p = prices if mode == "latest" else prices.where(F.col("date") <= F.lit(at).cast("date"))
    return p.groupBy("base", "quote").agg(F.max_by(F.struct("date", "rate"), F.struct("date", "seq")).alias("x")).select("base", "quote", "x.*")
