"""Line dedup by content-defined chunks of lines (DataFrame functions only).

Every line gets a hash; a polynomial hash rolls over each ``WINDOW`` consecutive line hashes, and a
line ends a chunk where that hash is 0 modulo ``DIVISOR``. Boundaries depend on nearby lines alone,
so an insertion shifts none of the others. Chunks of at least ``MIN_LINES`` lines that come more
than once in the corpus are kept where they come first (by doc_id, then place) and removed elsewhere,
after their bytes have been compared: chunks that share a hash and length but not their text are grouped by text.

A repeated passage that holds no whole chunk stays, and so do the partial chunks at its ends; ``dedupe_passages``
removes repeated runs of 2 lines or more whole. It compares every two neighbouring lines instead of chunks.

Inputs and defined results
- null text: stays null, no lines. Empty text: one empty line, no chunk of several lines. Very long texts are whole.
- null doc_id: sorts after all others; such rows are told apart by their text's hash.
- repeated rows (equal doc_id and text): the same chunk in each; the rows are alike in everything,
  so all of them keep or lose a chunk together. Equal doc_ids with different texts are ordered by the text's hash.
- a chunk repeated within its own document counts like one in another.
- empty tables: no rows. Extra columns of any name are ignored by ``dedupe``.

Scale: the chunk groups carry one text per group and task (combined before the shuffle), never a
list of members; the way back to the members is an equi-join on light rows that adaptive execution
splits where one chunk is hot; the texts move once more, to their removal lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import scratch

WINDOW = 2
DIVISOR = 4
MIN_LINES = 2
#: Modulus and factor of the rolling hash.
MODULUS, FACTOR = 2147483647, 1000003

_KEY = ["doc_id", "text_key"]


def chunk_array(text: Column | str) -> Column:
    """array<struct<idx, n_lines, body>>: the text's chunks in order; joined by newlines they are the text."""
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    at = lambda h, i: F.when(i >= 0, F.get(h, i)).otherwise(F.lit(0))

    def ends(h):
        n = F.size(h)

        def rolled(i):
            out = F.lit(0).cast("long")
            for k in range(WINDOW - 1, -1, -1):
                out = F.pmod(out * FACTOR + at(h, i - k), F.lit(MODULUS))
            return out

        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.pmod(rolled(i), F.lit(DIVISOR)) == 0))

    # the hashes and the chunk ends are arrays of their own, so that each is computed once
    def build(pack):
        stop = pack["stop"]
        start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(stop, j - 1) + 1)
        return F.transform(
            stop,
            lambda e, j: F.struct(j.alias("idx"), (e - start(j) + 1).alias("n_lines"), F.array_join(F.slice(pack["lines"], start(j) + 1, e - start(j) + 1), "\n").alias("body")),
        )

    first = F.transform(F.array(F.struct(lines.alias("lines"), hashes.alias("h"))), lambda p: F.struct(p["lines"].alias("lines"), ends(p["h"]).alias("stop")))
    return F.flatten(F.transform(first, build))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, idx, n_lines, body of every chunk."""
    base = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(chunk_array("text")).alias("c"))
    return base.select("doc_id", "text_key", "c.idx", "c.n_lines", "c.body")


def _hashed(docs: DataFrame) -> DataFrame:
    """The chunks of several lines with their hash and length."""
    return chunks(docs).where(F.col("n_lines") >= MIN_LINES).withColumns({"h": F.xxhash64("body"), "len": F.octet_length("body")})


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "idx")


def repeated(docs: DataFrame) -> DataFrame:
    """The groups of multi-line chunks of one hash and length: first place, number of places, and whether their bytes are all equal."""
    groups = _hashed(docs).groupBy("h", "len").agg(F.min(_place()).alias("first"), F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"))
    return groups.where("n > 1").select("h", "len", "first", "n", (F.col("low") == F.col("high")).alias("equal"))


def _later(hit: DataFrame) -> DataFrame:
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("idx") == F.col("first.idx"))
    return hit.where(~first).select("doc_id", "text_key", "idx")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, gone (the places of the chunks to remove), one row per document that loses any."""
    groups = scratch.materialize(repeated(docs), "chunks")
    light = _hashed(docs).select("doc_id", "text_key", "idx", "h", "len")
    hit = _later(light.join(groups.where("equal"), ["h", "len"]))
    unlike = groups.where("not equal").select("h", "len")
    if not unlike.isEmpty():
        mixed = scratch.materialize(_hashed(docs).join(unlike, ["h", "len"], "left_semi").select("doc_id", "text_key", "idx", "body"), "mixed")
        hit = hit.unionByName(_later(mixed.join(mixed.groupBy("body").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1"), "body")))
    return hit.groupBy(*_KEY).agg(F.collect_set("idx").alias("gone"))  # a document's own chunks at most


def dedupe(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_lines, n_chunks, removed_chunks, removed_lines, text (what is left; null where it was)."""
    gone = scratch.materialize(removals(docs), "gone").withColumnsRenamed({"doc_id": "g_id", "text_key": "g_key"})
    rows = docs.select("doc_id", F.col("text").alias("whole"), F.xxhash64("text").alias("text_key"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    parts = chunk_array("whole")
    # array_except hashes, so that a long text's places are not searched through once per chunk
    stay = F.array_except(F.sequence(F.lit(0), F.size("c") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("c")).otherwise(F.transform(stay, lambda i: F.get(F.col("c"), i)))
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x["n_lines"])
    rows = rows.withColumn("c", F.when(F.col("whole").isNotNull(), parts)).withColumn("kept", kept)
    return rows.select(
        "doc_id",
        F.coalesce(size("c"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("c").isNull(), 0).otherwise(F.size("c")).cast("long").alias("n_chunks"),
        F.when(F.col("c").isNull(), 0).otherwise(F.size("c") - F.size("kept")).cast("long").alias("removed_chunks"),
        F.coalesce(size("c") - size("kept"), F.lit(0)).cast("long").alias("removed_lines"),
        F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(F.transform("kept", lambda x: x["body"]), "\n")).alias("text"),
    )


def _pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, idx, h, len of every two neighbouring lines (idx: the first of them, from 0)."""
    lines = F.split("text", "\n", -1)
    two = lambda p: F.transform(
        F.slice(p, F.lit(1), F.size(p) - 1),
        lambda x, i: F.struct(i.alias("idx"), F.xxhash64(x, F.get(p, i + 1)).alias("h"), (F.octet_length(x) + F.octet_length(F.get(p, i + 1))).alias("len")),
    )
    base = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.flatten(F.transform(F.array(lines), two))).alias("p"))
    return base.select("doc_id", "text_key", "p.idx", "p.h", "p.len")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, whole, hits of every row; hits (idx, h, len, later): its repeated pairs of lines, later if not the first place (null: none)."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "idx")
    groups = _pairs(docs).groupBy("h", "len").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.materialize(groups.select("h", "len", "first"), "pairs")
    hit = _pairs(docs).join(groups, ["h", "len"])
    same_text = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    later = ~(same_text & (F.col("idx") - F.col("first.idx")).isin(0, 1))  # at a distance of 1 they overlap: one line, three times
    # a set: rows that repeat have the same pairs
    hits = hit.groupBy(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")).agg(F.collect_set(F.struct("idx", "h", "len", later.alias("later"))).alias("hits"))
    rows = docs.select("doc_id", F.col("text").alias("whole"), F.xxhash64("text").alias("text_key"))
    # the texts move once, for the comparison and the result alike
    rows = rows.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    return scratch.materialize(rows.select("doc_id", "text_key", "whole", "hits"), "marked")


def _confirmed(marked: DataFrame) -> DataFrame:
    """``marked`` with ``hits`` that are later ones only, without the groups whose bytes are not all equal."""
    body = lambda p, x: F.struct(x["h"].alias("h"), x["len"].alias("len"), F.concat(F.get(p, x["idx"]), F.lit("\n"), F.get(p, x["idx"] + 1)).alias("body"))
    bodies = marked.where("hits is not null").select(F.explode(F.flatten(F.transform(F.array(F.split("whole", "\n", -1)), lambda p: F.transform("hits", lambda x: body(p, x))))).alias("b"))
    unlike = bodies.groupBy("b.h", "b.len").agg(F.min("b.body").alias("low"), F.max("b.body").alias("high")).where("low <> high").select("h", "len")
    unlike = scratch.materialize(unlike, "unlike")
    if unlike.isEmpty():
        return marked.withColumn("hits", F.filter("hits", lambda x: x["later"]))
    each = marked.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), F.explode("hits").alias("x")).where("x.later")
    each = each.join(unlike, (F.col("x.h") == F.col("h")) & (F.col("x.len") == F.col("len")), "left_anti")
    hits = each.groupBy("g_id", "g_key").agg(F.collect_set("x").alias("hits"))
    return marked.drop("hits").join(hits, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")


def dedupe_passages(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_lines, removed_lines, text (what is left; null where it was, empty where every line went).

    Chunk edges play no part: a line is removed where it and a neighbour of it come earlier as two neighbouring
    lines, so every repeated run of 2 or more lines goes whole, wherever it begins. Of each removed line an earlier
    equal one stays. Inputs are treated as by ``dedupe``.
    """
    rows = _confirmed(_marked(docs))
    rows = rows.withColumn("gone", F.array_distinct(F.flatten(F.transform("hits", lambda x: F.array(x["idx"], x["idx"] + 1)))))
    rows = rows.withColumn("gone", F.when(F.size("gone") > 0, F.col("gone")))
    # array_except hashes, so that a long text's places are not searched through once per line
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))
    kept = F.transform(F.array(F.split("whole", "\n", -1)), lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n"))
    return rows.select(
        "doc_id",
        F.when(F.col("whole").isNull(), 0).otherwise(F.size(F.split("whole", "\n", -1))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("removed_lines"),
        F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.get(kept, 0)).alias("text"),
    )


def report(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn("text_md5", F.md5("text")).drop("text")


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, n,
         ('0x' || md5(line)[1:7])::BIGINT AS h
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)),
e AS (
  SELECT *, coalesce(lag(h) OVER w, 0) AS h1 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (
  SELECT *, (i = n OR ((h1 % {MODULUS}) * {FACTOR} + h) % {MODULUS} % {DIVISOR} = 0)::INT AS stop FROM e),
k AS (
  SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM b),
c AS (
  SELECT doc_id, idx, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY doc_id, idx),
d AS (
  SELECT *, n_lines >= {MIN_LINES} AND row_number() OVER (PARTITION BY body ORDER BY doc_id, idx) > 1 AS gone FROM c),
t AS (
  SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, count(*) FILTER (WHERE gone)::BIGINT AS removed_chunks,
         coalesce(sum(n_lines) FILTER (WHERE gone), 0)::BIGINT AS removed_lines,
         md5(coalesce(string_agg(body, chr(10) ORDER BY idx) FILTER (WHERE NOT gone), '')) AS text_md5
  FROM d GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(removed_chunks, 0) AS removed_chunks,
       coalesce(removed_lines, 0) AS removed_lines, text_md5
FROM documents x LEFT JOIN t USING (doc_id)
"""
