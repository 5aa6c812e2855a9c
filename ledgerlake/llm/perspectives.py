"""Chat formatting by rotating the perspective of multi-party dialogues (DataFrame functions only).

For every participant of a conversation the whole dialogue is rendered once, with that participant's
turns as the assistant's and everybody else's as a named user's; the mask marks the characters of the
assistant's turns, which a trainer learns from. Turns of ``CONTEXT_ROLES`` (system) belong to no
participant: they are rendered as they are in every perspective and never marked.

A turn is rendered as ``<|role|>\\ntext<|end|>\\n`` or ``<|user name=NAME|>\\ntext<|end|>\\n``. A text cannot
forge a mark: ``<|`` (with any backslashes between) gets one more backslash; in names ``%``, ``|`` and
newlines are percent-encoded. Both can be undone.

Inputs and defined results
- null text: an empty turn. Very long texts are whole. null role: a participant named ``unknown``.
- turns are in the order of turn (null last), then role, then text; repeated rows are repeated turns.
- null conv_id: one conversation of its own.
- a conversation of context turns alone has no perspective and gives no row; empty tables: no rows.
- extra columns of any name are ignored.

Scale: turns are gathered in parts (``PART_TURNS`` turn numbers; turns without a number by role) that are
rendered apart, for each participant; the ready parts of one participant's dialogue, which is one row of the
result, are then joined in order and their masks moved by the length of the parts before them. So a
conversation with a third of all rows is rendered by many tasks, and no task holds more than the result row
it makes. Masks are folded over ``FOLD`` turns at a time, so the work follows the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
PART_TURNS = 512
FOLD = 256
END = "<|end|>\n"
_MARK, _ESCAPED = r"<(\\*)\|", r"<$1\\|"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _text(t: Column) -> Column:
    return F.regexp_replace(F.coalesce(t, F.lit("")), _MARK, _ESCAPED)


def _name(n: Column) -> Column:
    return F.replace(F.replace(F.replace(n, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("\n"), F.lit("%0A"))


def _moved(mask: Column, by: Column) -> Column:
    return F.transform(mask, lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end")))


def _starts(sizes: Column) -> Column:
    """Where each of some consecutive stretches begins; the last value is the whole length."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(sizes, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _joined(parts: Column) -> Column:
    """One struct (size, mask) of consecutive structs (size, mask)."""
    with_starts = F.transform(F.array(parts), lambda p: F.struct(p.alias("p"), _starts(F.transform(p, lambda x: x["size"])).alias("at")))
    return F.get(F.transform(with_starts, lambda w: F.struct(F.element_at(w["at"], -1).alias("size"), F.flatten(F.transform(w["p"], lambda x, i: _moved(x["mask"], F.get(w["at"], i)))).alias("mask"))), 0)


def _groups(items: Column) -> Column:
    """Slices of ``FOLD`` items."""
    n = F.ceil(F.size(items) / FOLD).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(items, k * FOLD + 1, F.lit(FOLD)))


def _stretch(items: Column) -> Column:
    """``_joined`` of any number of items, ``FOLD`` at a time."""
    return _joined(F.transform(_groups(items), _joined))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, n_turns, n_marked, text, mask (array of start and end, 0-based character offsets): a row per participant."""
    turn = F.struct(F.col("turn").isNull().alias("no"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", turn.alias("t"))
    part = F.struct(F.col("t.no"), F.floor(F.col("t.turn") / part_turns).alias("k"), F.when(F.col("t.no"), F.col("t.role")).alias("role"))
    rows = rows.withColumn("part", part)
    who = F.collect_set(F.when(~F.col("t.role").isin(*CONTEXT_ROLES), F.col("t.role")))
    people = rows.groupBy("conv_id").agg(who.alias("people")).withColumnRenamed("conv_id", "p_id")
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    rows = parts.join(people, F.col("conv_id").eqNullSafe(F.col("p_id"))).withColumn("perspective", F.explode("people"))

    def render(t):
        me = t["role"] == F.col("perspective")
        head = F.when(me, F.lit("<|assistant|>\n")).when(t["role"].isin(*CONTEXT_ROLES), F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), _name(t["role"]), F.lit("|>\n")))
        return F.struct(me.alias("me"), F.char_length(head).cast("long").alias("head"), F.concat(head, _text(t["text"]), F.lit(END)).alias("piece"))

    def spans(x):
        n = F.char_length(x["piece"]).cast("long")
        mine = F.array(F.struct(x["head"].alias("start"), (n - len(END)).alias("end")))
        return F.struct(n.alias("size"), F.when(x["me"], mine).otherwise(F.expr(f"cast(array() as {_SPANS})")).alias("mask"))

    rows = rows.select("conv_id", "perspective", "part", F.transform("turns", render).alias("pieces"))
    rows = rows.select(
        "conv_id",
        "perspective",
        F.struct(
            "part",
            F.size("pieces").cast("long").alias("n"),
            F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("text"),
            _stretch(F.transform("pieces", spans)).alias("spans"),
        ).alias("x"),
    )
    whole = rows.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list("x")).alias("all"))
    whole = whole.withColumn("mask", _stretch(F.transform("all", lambda x: x["spans"]))["mask"])
    return whole.select(
        "conv_id",
        "perspective",
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"),
        F.size("mask").cast("long").alias("n_marked"),
        F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"),
        "mask",
    )


def report(rotated: DataFrame) -> DataFrame:
    """The mask as text: start-end, comma-joined."""
    mask = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rotated.withColumn("mask", mask)


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, role, raw, text, role = perspective AS me,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A') || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base,
         row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, raw) AS k FROM r)
SELECT conv_id, perspective, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE me)::BIGINT AS n_marked,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg((base + length(head))::VARCHAR || '-' || (base + length(head) + length(text))::VARCHAR, ',' ORDER BY k) FILTER (WHERE me), '') AS mask
FROM o GROUP BY conv_id, perspective
"""
