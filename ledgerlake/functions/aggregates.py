"""Aggregate functions: each builds a Column for ``agg``; sums of positions are done by the compiler in two levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.registry import register
from ledgerlake.model import SUM

for _t in ("bool", "int", "decimal", "string", "date", "amount", "position", "inventory", "set", "dict"):
    register("count", _t, "int", lambda x, order: F.count(x), aggregate=True)
register("sum", "int", "int", lambda x, order: F.coalesce(F.sum(x), F.lit(0).cast("bigint")), aggregate=True)
register("sum", "decimal", "decimal", lambda x, order: F.coalesce(F.sum(x), F.lit(0)).cast(SUM), aggregate=True)
register("sum", "position", "inventory", None, aggregate=True)
register("sum", "amount", "inventory", None, aggregate=True)

#: Amounts and positions are ordered by currency first.
_rank = {"amount": lambda x: F.struct(x["currency"], x["number"]), "position": lambda x: F.struct(x["units"]["currency"], x["cost"], x["units"]["number"])}
for _t in ("int", "decimal", "string", "date", "amount", "position", "bool"):
    _key = _rank.get(_t, lambda x: x)
    register("min", _t, _t, lambda x, order, k=_key: F.min_by(x, F.when(x.isNotNull(), k(x))), aggregate=True)
    register("max", _t, _t, lambda x, order, k=_key: F.max_by(x, F.when(x.isNotNull(), k(x))), aggregate=True)
    register("first", _t, _t, lambda x, order: F.min_by(x, F.when(x.isNotNull(), order)), aggregate=True)
    register("last", _t, _t, lambda x, order: F.max_by(x, F.when(x.isNotNull(), order)), aggregate=True)
