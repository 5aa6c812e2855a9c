"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source's documents are put into a fixed pseudo-random order; a document's virtual finish time
is the source's cumulative tokens up to and including it, divided by the source's target. A second
lap over the same order serves targets above the source's size. All entries are cut, in the order
of virtual finish time, at the total budget.

Prefix sums do not gather a source in one task: documents fall into buckets by their order key,
bucket totals are summed up in a small table (a row per source and bucket, about
``BUCKET_ROWS`` documents each), and only the inside of a bucket is summed by a window. The cut at
the budget works alike over ranges of the finish time.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating; together they ask for
150 % of all sizes; a target stops at twice its source's size, and the excess is shared again by
weight among the others until none is above.

Inputs and defined results
- null or empty texts: size 0, taken 0. A source without words: target 0, nothing taken. Very long texts are whole.
- null source: a source of its own. Null doc_id: ordered as the text 'null'.
- repeated rows: each is a row of its own. Rows that agree in doc_id, source and text are interchangeable: ``plan`` cuts
  them in one order, and ``mix`` returns as many of them as the plan takes in all, with the other columns of one of them.
- empty tables: no rows. Extra columns of any name are ignored by ``plan`` and kept by ``mix``.
Sizes, totals and the order depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm import scratch

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
REPEATS = 2
SEED = "mix-1"
BUCKET_ROWS = 2000
_STEPS = 4096


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """A row per source: source, source_size, n_docs, target. Sources are few: one row each is summed in order."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats).withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    s = s.withColumns(
        {
            "budget": F.sum("source_size").over(every) * share / F.lit(100.0),
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("budget") - F.col("before")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(every)
    return s.withColumn("water", level).select("source", "rank", "source_size", "n_docs", F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def _before(totals: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Sum of ``value`` over the earlier ``step``s of each key; the table of totals is small."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("ahead", F.coalesce(F.sum(value).over(w), F.lit(0))).drop(value)


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document row: doc_id, source, text_key, size, source_size, target, times (0, 1 or 2), taken."""
    sized = docs.select(F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sized = scratch.materialize(sized.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))), "sized")
    per = targets(sized).withColumn("buckets", F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.ceil(F.col("n_docs") / BUCKET_ROWS))).cast("long"))
    per = scratch.materialize(per, "targets")
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(per["source"]).withColumn("bucket", F.shiftright(spot * F.col("buckets"), 32))
    rows = scratch.materialize(rows, "queued")
    ahead = _before(rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum")), ["source"], "bucket", "sum").withColumnsRenamed({"source": "s", "bucket": "b"})
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inner", F.sum("size").over(inner)).join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("done", F.col("inner") + F.col("ahead"))
    rows = scratch.materialize(rows.select("doc_id", "source", "text_key", "rank", "size", "source_size", "target", "done"), "finish")
    finish = lambda k: (F.col("done") + F.col("source_size") * k) / F.col("target")
    laps = rows.where("size > 0 and target > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    laps = laps.select("size", "rank", "lap", finish(F.col("lap")).alias("finish"))
    cut = _cut(laps, (per.agg(F.sum("source_size")).first()[0] or 0) * SHARE_PERCENT / 100.0)
    if cut is None:
        times = F.lit(0)
    else:
        within = lambda k: F.struct(finish(k), F.col("rank"), F.lit(k)) <= F.struct(F.lit(cut[0]), F.lit(cut[1]), F.lit(cut[2]))
        times = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & within(k), 1).otherwise(0) for k in range(1, REPEATS)), F.when((F.col("size") > 0) & (F.col("target") > 0) & within(0), 1).otherwise(0))
    return rows.withColumn("times", times).select("doc_id", "source", "text_key", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def _cut(laps: DataFrame, budget: float) -> tuple[float, int, int] | None:
    """(finish, rank, lap) of the last entry that the budget admits, in that order; None: it admits none.

    No two entries share all three: within a source every entry with words has a finish of its own.
    The range that holds the budget's edge is narrowed by sums over ``_STEPS`` ranges (so many rows
    reach the driver, whatever the input) until few entries are left, which are summed exactly.
    """
    last = laps.agg(F.max("finish")).first()[0]
    if last is None:
        return None
    low, width, ahead = 0.0, (last + 1.0), 0
    for _ in range(4):
        step = F.least(F.floor((F.col("finish") - low) / width * _STEPS), F.lit(_STEPS - 1)).cast("long")
        sums = laps.where((F.col("finish") >= low) & (F.col("finish") < low + width)).groupBy(step.alias("step")).agg(F.sum("size"), F.count("*"))
        for k, size, n in sorted(map(tuple, sums.collect())):
            if ahead + size > budget:
                break
            ahead += size
        else:
            break
        low, width = low + k * (width / _STEPS) * (1 - 1e-12), width / _STEPS * (1 + 1e-9)
        ahead = laps.where(F.col("finish") < low).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if n <= BUCKET_ROWS:
            break
    order = Window.orderBy("finish", "rank", "lap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = laps.where((F.col("finish") >= low) & (F.col("finish") < low + width)).withColumn("cum", F.sum("size").over(order) + F.lit(ahead)).where(F.col("cum") <= budget)
    top = edge.agg(F.max(F.struct("finish", "rank", "lap"))).first()[0]
    if top is None:
        top = laps.where(F.col("finish") < low).agg(F.max(F.struct("finish", "rank", "lap"))).first()[0]
    return tuple(top) if top else None


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents that the mix takes, with all their columns, each as often as the plan takes it."""
    p = plan(docs, seed).groupBy("doc_id", "source", "text_key").agg(F.sum("times").alias("_times"), F.count("*").alias("_n")).where("_times > 0")
    p = scratch.materialize(p.withColumnsRenamed({"doc_id": "_d", "source": "_s", "text_key": "_t"}), "taken")
    matched = lambda some: docs.join(some, docs["doc_id"].eqNullSafe(some["_d"]) & docs["source"].eqNullSafe(some["_s"]) & (F.xxhash64(docs["text"]) == some["_t"]))
    laps = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
    taken = matched(p.where("_n = 1")).withColumn("_lap", laps).select(*docs.columns)
    again = p.where("_n > 1")
    if again.isEmpty():
        return taken
    whole = F.struct(*docs.columns)  # a row for all that are interchangeable, before they meet
    one = matched(again).groupBy("_d", "_s", "_t").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_row"), F.first("_times").alias("_times"))
    return taken.unionByName(one.withColumn("_lap", laps).select("_row.*"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight FROM s1),
s3 AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / weight AS lift FROM s2),
s4 AS (SELECT *, ((sum(source_size) OVER ()) * 150)::DOUBLE / 100.0::DOUBLE AS budget,
         coalesce(sum(cap) OVER (ORDER BY lift, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY lift, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s3),
s5 AS (SELECT *, (budget - before::DOUBLE) / open::DOUBLE AS level FROM s4),
s6 AS (SELECT *, max(CASE WHEN level <= lift THEN level END) OVER () AS water FROM s5),
per AS (SELECT source, rank, source_size, budget, coalesce(least(cap::DOUBLE, water * weight), cap::DOUBLE) AS target FROM s6),
rows_ AS (
  SELECT z.doc_id, z.source, z.size, p.rank, p.source_size, p.target, p.budget,
         sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done,
         row_number() OVER () AS rid
  FROM sized z JOIN per p ON z.source IS NOT DISTINCT FROM p.source),
laps AS (
  SELECT rid, size, rank, lap, budget, (done + source_size * lap)::DOUBLE / target AS finish
  FROM rows_, (VALUES (0), (1)) AS l(lap) WHERE size > 0 AND target > 0),
cut AS (
  SELECT rid, size, sum(size) OVER (ORDER BY finish, rank, lap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, budget FROM laps),
got AS (SELECT rid, sum(size) AS taken FROM cut WHERE cum <= budget GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM rows_ LEFT JOIN got USING (rid)
"""
