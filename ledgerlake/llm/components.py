"""Connected components of an undirected link table, by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and an equi-join back; each round is
written to the shared folder, which cuts lineage. A node that has more than a ``HOT``-th of all links
(there are at most 2 x ``HOT`` such nodes, whatever the input) is salted in the join: its minimum is
repeated ``SALTS`` times, once for each part that its links are dealt into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import scratch

HOT, SALTS = 256, 64
#: Nodes with at most so many links are never split.
FEW = 1000


def _joined(links: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``links`` with the column m that ``low`` (u, m, k links) has for their u."""
    if total <= FEW:
        return links.join(low.drop("k"), "u")
    hot = [r["u"] for r in low.where(F.col("k") > max(FEW, total // HOT)).select("u").collect()]
    if not hot:
        return links.join(low.drop("k"), "u")
    salted = F.col("u").isin(hot)
    links = links.withColumn("s", F.when(salted, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    low = low.withColumn("s", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return links.join(low.drop("k"), ["u", "s"]).drop("s")


def _kept(low: DataFrame, total: int) -> DataFrame:
    return low if total <= FEW else scratch.materialize(low, "low")


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _kept(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k"), total)
    return _joined(both.where("v > u"), low, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _kept(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), total)
    near = _joined(down, low, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node that can be reached.

    Self-links and links with a null end are ignored; an empty table gives no rows.
    """
    edges = scratch.materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        starred = scratch.materialize(_large(edges, state[0]), "links")
        edges = scratch.materialize(_small(starred, state[0]), "links")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
