"""Duplicate detection between new and existing transactions: by id, exactly, or by structure.

Each level is an equi-join on a hash of the normalised transaction; the structural level joins on the
posting multiset and buckets of dates, so a window of days costs two bucket rows per transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, ID, EXACT, STRUCTURAL = "none", "id", "exact", "structural"


def normal_text(c: Column) -> Column:
    """NFKC is left to the source; case is kept; all white space goes."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def keyed(postings: DataFrame, id_keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per transaction: seq, date, exact, structure (hashes), ids."""
    n = F.coalesce(F.col("number").cast("string"), F.lit("?"))
    legs = F.array_sort(F.collect_list(F.struct("account", n.alias("n"), F.coalesce("currency", F.lit("?")).alias("c"))))
    shape = F.array_sort(F.collect_list(F.struct("account", F.abs("number").cast("string").alias("n"), F.coalesce("currency", F.lit("?")).alias("c"))))
    head = F.concat_ws("\x1f", F.col("date").cast("string"), F.coalesce("flag", F.lit("")), normal_text(F.col("payee")), normal_text(F.col("narration")), F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ","))
    ids = [F.first(F.try_element_at("entry_meta", F.lit(k))["s"], ignorenulls=True).alias(f"id_{k}") for k in id_keys]
    t = postings.groupBy("seq", "date").agg(F.min(head).alias("head"), legs.alias("legs"), shape.alias("shape"), *ids)
    return t.select("seq", "date", F.sha2(F.concat_ws("\x1e", "head", F.to_json("legs")), 256).alias("exact"), F.sha2(F.to_json("shape"), 256).alias("structure"), *[f"id_{k}" for k in id_keys])


def match(new: DataFrame, old: DataFrame, id_keys: tuple[str, ...] = (), window: int = 0) -> DataFrame:
    """seq of ``new`` -> (kind, match): the strongest match and the smallest matching seq.

    An id that both have and that differs vetoes a match; window 0 means no structural level. Both sides are keyed
    once: a transaction gives a row per level, and one join serves all levels. Of the old side's rows that agree in
    level, key, date and ids only the smallest seq goes on, so a transaction that recurs costs a row a day.
    """
    ids = [f"id_{k}" for k in id_keys]
    bucket = lambda d: F.floor(F.unix_date(d) / (2 * window + 1)).cast("long")
    level = lambda rank, key, b: F.struct(F.lit(rank).alias("rank"), key.alias("key"), b.alias("b"))
    none = F.lit(0).cast("long")
    always = [level(0, F.concat(F.lit(f"{k}="), F.col(k)), none) for k in ids] + [level(1, F.col("exact"), none)]
    near = [level(2, F.col("structure"), bucket(F.date_sub("date", window))), level(2, F.col("structure"), bucket(F.date_add("date", window)))] if window else []
    a = keyed(new, id_keys).withColumn("x", F.explode(F.array(*always, *([level(2, F.col("structure"), bucket("date"))] if window else []))))
    b = keyed(old, id_keys).withColumn("x", F.explode(F.array_distinct(F.array(*always, *near)))).where("x.key is not null")
    b = b.groupBy("x", F.col("date").alias("o_date"), *[F.col(k).alias(f"o_{k}") for k in ids]).agg(F.min("seq").alias("o_seq"))
    fits = (F.col("x.rank") < 2) | (F.abs(F.datediff("date", "o_date")) <= window)
    for k in ids:
        fits = fits & ~F.coalesce(F.col(k) != F.col(f"o_{k}"), F.lit(False))
    found = F.when(F.col("o_seq").isNotNull() & fits, F.struct(F.col("x.rank").alias("rank"), "o_seq"))
    best = a.join(b, "x", "left").groupBy("seq").agg(F.min(found).alias("m"))
    kind = F.when(F.col("m.rank") == 0, ID).when(F.col("m.rank") == 1, EXACT).when(F.col("m.rank") == 2, STRUCTURAL).otherwise(NONE)
    return best.select("seq", kind.alias("kind"), F.col("m.o_seq").alias("match"))


def decide(matched: DataFrame) -> DataFrame:
    """write new transactions, comment out structural matches, skip the others."""
    return matched.withColumn("action", F.when(F.col("kind") == NONE, "write").when(F.col("kind") == STRUCTURAL, "comment").otherwise("skip"))
