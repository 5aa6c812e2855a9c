"""Typed compilation of a query to one DataFrame; Catalyst does the rest.

Order of analysis: table, predicate, GROUP BY, targets, ORDER BY, HAVING. Lookups that a function
needs (account and currency dimensions, as-of rates) become joins of the rows or groups they are
asked on, and only those that are asked for.
"""

from __future__ import annotations

import dataclasses
import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import aggregates, registry, scalars
from ledgerlake.model import NUM, SUM, Ledger
from ledgerlake.operators import inventory as inv
from ledgerlake.operators import prices as price_ops
from ledgerlake.operators.scope import scoped
from ledgerlake.plans import tables
from ledgerlake.plans.syntax import Attribute, Binary, Call, Column, Expr, Index, IsNull, ListOf, Literal, QueryError, Select, Target, Unary, parse

_ = (aggregates, scalars)  # importing them fills the registry
META_SUGAR = {"meta": "meta", "entry_meta": "entry_meta", "any_meta": "any_meta"}


@dataclass
class Typed:
    col: SparkColumn
    type: str
    value: object = None  # of a literal


@dataclass
class Slot:
    kind: str
    arg: SparkColumn
    agg: SparkColumn | None


def key(e: object) -> object:
    """An expression without its positions, to compare."""
    if isinstance(e, Expr):
        return (type(e).__name__, *[key(getattr(e, f.name)) for f in dataclasses.fields(e) if f.name != "pos"])
    if isinstance(e, list):
        return tuple(map(key, e))
    return e


def walk(e: object):
    if isinstance(e, Expr):
        yield e
        for f in dataclasses.fields(e):
            yield from walk(getattr(e, f.name))
    elif isinstance(e, list):
        for x in e:
            yield from walk(x)


class Phase:
    """Rows or groups while they are compiled: the joins they need."""

    def __init__(self, ledger: Ledger, name: str):
        self.ledger, self.options, self.name = ledger, ledger.options, name
        self.today = datetime.date.today()
        self.joins: list = []
        self.made: dict = {}

    def constant(self, col: SparkColumn) -> object:
        got = self.literals.get(id(col))
        if got is None:
            raise QueryError("this argument must be a literal")
        return got[1]

    literals: dict = {}

    def dimension(self, name: str, on: SparkColumn, column: str) -> SparkColumn:
        """``column`` of the dimension row that ``on`` names, null if there is none."""
        mark = (name, str(on._jc) if hasattr(on, "_jc") else repr(on))
        if mark not in self.made:
            k = f"_{self.name}{len(self.joins)}"

            def join(df: DataFrame) -> DataFrame:
                if name == "known_accounts":
                    dim = self.ledger.entries.where("account is not null").select("account").union(self.ledger.postings.select("account")).distinct().withColumn("known", F.lit(True))
                else:
                    dim = getattr(self.ledger, name)
                dim = dim.withColumnsRenamed({c: f"{k}_{c}" for c in dim.columns})
                return df.join(dim, on == F.col(dim.columns[0]), "left")

            self.joins.append(join)
            self.made[mark] = k
        return F.col(f"{self.made[mark]}_{column}")

    def rate(self, base: SparkColumn, quote: SparkColumn, date: SparkColumn | None) -> SparkColumn:
        mark = ("rate", str(base), str(quote), str(date))
        if mark not in self.made:
            k = f"_{self.name}{len(self.joins)}_rate"
            self.joins.append(lambda df: price_ops.attach_rate(df, self.ledger.prices, base, quote, date, k))
            self.made[mark] = k
        return F.col(self.made[mark])

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, j: j(d), self.joins, df)


@dataclass
class Compiler:
    ledger: Ledger
    select: Select
    slots: list[Slot] = field(default_factory=list)

    def __post_init__(self):
        self.rows, self.groups = Phase(self.ledger, "r"), Phase(self.ledger, "g")
        self.rows.literals = self.groups.literals = {}
        self.group_keys: dict = {}
        self.grouped = False
        self.in_aggregate = False
        self.running: dict[str, str] = {}
        self.whole_balance = False

    # --- expressions ------------------------------------------------------------------------------

    def expr(self, e: Expr) -> Typed:
        if self.grouped and not self.in_aggregate and (k := key(e)) in self.group_keys:
            i, t = self.group_keys[k]
            return Typed(F.col(f"_g{i}"), t)
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def _literal(self, e: Literal) -> Typed:
        if e.type == "decimal":
            col = F.lit(e.value).cast(NUM)
        elif e.type == "int":
            col = F.lit(e.value).cast("bigint")
        else:
            col = F.lit(e.value)
        self.rows.literals[id(col)] = (col, e.value)
        return Typed(col, e.type, e.value)

    def _column(self, e: Column) -> Typed:
        name = e.name.lower()
        if name not in self.table.columns:
            raise QueryError(f"no column {e.name}", e.pos)
        if self.grouped and not self.in_aggregate:
            raise QueryError(f"{e.name} must be in GROUP BY or in an aggregate", e.pos)
        col, kind = self.table.columns[name]
        if name == "balance" and col is None:
            if not self.allow_balance:
                raise QueryError("balance is a running value of the selected rows; a predicate can't use it", e.pos)
            col, self.whole_balance = F.col("_balance"), True
        return Typed(col, kind)

    def _listof(self, e: ListOf) -> Typed:
        raise QueryError("a list is only allowed after IN", e.pos)

    def _call(self, e: Call) -> Typed:
        name = e.name
        if name in META_SUGAR and len(e.args) in (1, 2):
            return self._call(Call(e.pos, "getitem", [Column(e.pos, META_SUGAR[name]), *e.args]))
        if registry.is_aggregate(name):
            return self._aggregate(e)
        if name == "only" and self.allow_balance and len(e.args) == 2 and isinstance(e.args[0], Literal) and isinstance(e.args[0].value, str) and isinstance(e.args[1], Column) and e.args[1].name.lower() == "balance":
            # one currency of the running balance is a running sum: no inventory is carried along
            k = self.running.setdefault(e.args[0].value, f"_running{len(self.running)}")
            return Typed(inv.amount(F.col(k), F.lit(e.args[0].value)), "amount")
        if name in ("convert", "value") and e.args and isinstance(e.args[0], Call) and e.args[0].name == "sum":
            # conversion is linear: converting a sum of positions is summing converted positions
            return self._aggregate(Call(e.pos, "sum", [Call(e.pos, f"_{name}_each", [*e.args[0].args, *e.args[1:]])]))
        if name in ("_convert_each", "_value_each"):
            x = [self.expr(a) for a in e.args]
            if x[0].type == "amount":
                x[0] = Typed(inv.bare(x[0].col), "position")
            if x[0].type != "position":
                raise QueryError(f"{name[1:-5]} of a sum takes positions or amounts", e.pos)
            rest = x[1:]
            own = F.coalesce(x[0].col["cost"]["currency"], x[0].col["units"]["currency"])
            quote = rest.pop(0).col if name == "_convert_each" else own
            return Typed(scalars.convert_each(self.phase, x[0].col, quote, rest[0].col if rest else None), "position")
        args = [self.expr(a) for a in e.args]
        f = registry.resolve(name, [a.type for a in args], e.pos)
        cols = [self.widen(a, t) for a, t in zip(args, f.ins, strict=True)]
        got = f.build(self.phase, *cols) if f.context else f.build(*cols)
        return Typed(got, f.out)

    @property
    def phase(self) -> Phase:
        return self.groups if self.grouped and not self.in_aggregate else self.rows

    def widen(self, a: Typed, to: str) -> SparkColumn:
        col = a.col.cast(NUM) if a.type == "int" and to == "decimal" else a.col
        if a.value is not None:
            self.rows.literals[id(col)] = (col, a.value)
        return col

    def _aggregate(self, e: Call) -> Typed:
        if self.in_aggregate:
            raise QueryError("aggregates can't be nested", e.pos)
        if not self.grouped:
            raise QueryError(f"{e.name} is not allowed here", e.pos)
        self.in_aggregate = True
        args = [self.expr(a) for a in e.args]
        self.in_aggregate = False
        f = registry.resolve(e.name, [a.type for a in args], e.pos)
        arg = self.widen(args[0], f.ins[0])
        i = len(self.slots)
        if f.build is None:
            self.slots.append(Slot("inventory", inv.bare(arg) if f.ins[0] == "amount" else arg, None))
        else:
            order = F.struct(*[F.col(c) for c in self.table.order])
            self.slots.append(Slot("scalar", arg, f.build(F.col(f"_x{i}"), order)))
        return Typed(F.col(f"_a{i}"), f.out)

    def _unary(self, e: Unary) -> Typed:
        x = self.expr(e.x)
        if e.op == "NOT":
            if x.type not in ("bool", "null"):
                raise QueryError(f"NOT takes a bool, not {x.type}", e.pos)
            return Typed(~x.col, "bool")
        if x.type not in ("int", "decimal", "null"):
            raise QueryError(f"{e.op} takes a number, not {x.type}", e.pos)
        v = None if x.value is None else -x.value if e.op == "-" else x.value
        col = -x.col if e.op == "-" else x.col
        if v is not None:
            self.rows.literals[id(col)] = (col, v)
        return Typed(col, x.type, v)

    def _isnull(self, e: IsNull) -> Typed:
        x = self.expr(e.x).col
        return Typed(x.isNotNull() if e.negated else x.isNull(), "bool")

    def _attribute(self, e: Attribute) -> Typed:
        x = self.expr(e.x)
        kind = tables.ENTRY_ATTRIBUTES.get(e.name)
        if x.type != "entry" or kind is None or e.name == "accounts":
            raise QueryError(f"no attribute {e.name} of {x.type}", e.pos)
        if e.name == "description":
            return Typed(F.nullif(F.concat_ws(" | ", F.nullif(x.col["payee"], F.lit("")), F.nullif(x.col["narration"], F.lit(""))), F.lit("")), kind)
        return Typed(x.col[e.name].cast("bigint") if kind == "int" else x.col[e.name], kind)

    def _index(self, e: Index) -> Typed:
        return self._call(Call(e.pos, "getitem", [e.x, e.key]))

    def _binary(self, e: Binary) -> Typed:
        if e.op == "IN":
            return self._in(e)
        a, b = self.expr(e.left), self.expr(e.right)
        kinds = {a.type, b.type} - {"null"}
        if e.op in ("AND", "OR"):
            if kinds - {"bool"}:
                raise QueryError(f"{e.op} takes bools", e.pos)
            return Typed(a.col & b.col if e.op == "AND" else a.col | b.col, "bool")
        if e.op == "~":
            if kinds - {"string"}:
                raise QueryError("~ takes strings", e.pos)
            return Typed(F.regexp_like(a.col, b.col), "bool")
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(e, a, b, kinds)
        if kinds - {"int", "decimal"}:
            raise QueryError(f"{e.op} takes numbers, not {' and '.join(sorted(kinds))}", e.pos)
        if e.op == "/":
            narrow = a.col.try_cast(NUM) / b.col.try_cast(NUM)
            return Typed(F.coalesce(narrow, (a.col.cast(SUM) / b.col.cast(SUM)).try_cast("decimal(38,20)")), "decimal")
        if kinds == {"int"} or not kinds:
            return Typed({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col, "%": a.col % b.col}[e.op], "int")
        if e.op in "*%" and "number" in self.table.df.columns and self.table.df.schema["number"].dataType == SUM:
            return Typed(self.wide(e.op, a.col, b.col), "decimal")
        x, y = (c.col.cast(NUM) if c.type == "int" or e.op in "*%" else c.col for c in (a, b))
        return Typed({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[e.op], "decimal")

    @staticmethod
    def wide(op: str, a, b):
        """The product or remainder where postings hold more than authored numbers do."""
        if op == "%":
            return a.cast(SUM) % b.cast(SUM)
        x, y = a.try_cast(NUM), b.try_cast(NUM)
        return F.coalesce((x * y).cast("decimal(38,16)"), F.when(y.isNotNull(), inv.times(a, b)).otherwise(inv.times(b, a)).cast("decimal(38,16)"))

    def compare(self, e: Binary, a: Typed, b: Typed, kinds: set[str]) -> Typed:
        if len(kinds) > 1 and kinds != {"int", "decimal"}:
            raise QueryError(f"can't compare {a.type} with {b.type}", e.pos)
        x, y = a.col, b.col
        kind = next(iter(kinds), "null")
        if kind in ("interval", "dict", "inventory", "entry") and e.op not in ("=", "!="):
            raise QueryError(f"{kind} has no order", e.pos)
        if kind == "dict":
            x, y = (F.array_sort(F.map_entries(c)) for c in (x, y))
        if kind == "amount":
            x, y = (F.struct(c["currency"], c["number"]) for c in (x, y))
        if kind == "position":
            x, y = (F.struct(c["units"]["currency"], c["cost"], c["units"]["number"]) for c in (x, y))
        got = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op]
        if kind in ("amount", "position"):
            got = F.when(a.col.isNotNull() & b.col.isNotNull(), got)
        return Typed(got, "bool")

    def _in(self, e: Binary) -> Typed:
        a = self.expr(e.left)
        if isinstance(e.right, ListOf):
            items = [self.expr(x) for x in e.right.items]
        else:
            b = self.expr(e.right)
            if b.type == "set":
                if a.type not in ("string", "null"):
                    raise QueryError("only strings are in sets", e.pos)
                return Typed(F.array_contains(b.col, a.col), "bool")
            items = [b]  # one element in parentheses: accepted
        if any(len({a.type, x.type} - {"null"}) > 1 and {a.type, x.type} != {"int", "decimal"} for x in items):
            raise QueryError("IN takes values of one type", e.pos)
        return Typed(a.col.isin(*[x.col for x in items]), "bool")

    # --- the statement ----------------------------------------------------------------------------

    def run(self) -> DataFrame:
        s = self.select
        name, predicate = "postings", s.source.expr
        if isinstance(predicate, Column) and predicate.name.lower() in tables.TABLES:
            name, predicate = predicate.name.lower(), None
        ledger = scoped(self.ledger, s.source.open_on, s.source.close_on, s.source.clear)
        everything = [s.targets and [t.expr for t in s.targets], predicate, s.where, s.group_by, s.having, [o.expr for o in s.order_by]]
        used = {e.name.lower() for e in walk([x for x in everything if x]) if isinstance(e, Column)}
        if s.targets is None:
            used |= set(tables.table(ledger, name, set()).star)
        self.table = tables.table(ledger, name, used)
        self.allow_balance = False
        df = self.table.df
        tests = []
        for e in (predicate, s.where):
            if e is not None:
                t = self.expr(e)
                if t.type not in ("bool", "null"):
                    raise QueryError(f"a predicate must be a bool, not {t.type}", e.pos)
                tests.append(t.col)
        targets = s.targets or [Target(Column(0, c), c) for c in self.table.star]
        calls = [e for x in [*[t.expr for t in targets], s.having, *[o.expr for o in s.order_by]] if x is not None for e in walk(x)]
        aggregated = bool(s.group_by) or s.having is not None or any(isinstance(e, Call) and registry.is_aggregate(e.name) for e in calls)
        keys: list[Typed] = []
        aliases = {t.alias.lower(): t.expr for t in targets if t.alias}
        for g in s.group_by:
            keys.append(self.expr(g))
            self.group_keys[key(g)] = (len(keys) - 1, keys[-1].type)
        self.grouped, self.allow_balance = aggregated, not aggregated
        outs = [self.expr(t.expr) for t in targets]
        order = []
        for o in s.order_by:
            e = o.expr
            if isinstance(e, Column) and e.name.lower() in aliases:
                e = aliases[e.name.lower()]
            order.append((self.expr(e), o.desc, key(e)))
        having = self.expr(s.having) if s.having is not None else None
        if having is not None and having.type not in ("bool", "null"):
            raise QueryError("HAVING must be a bool", s.having.pos)

        if not self.grouped and len(self.rows.joins) == 0:
            df = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
        else:
            df = self.rows.apply(df)
            df = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
        for currency, name in self.running.items():
            value = F.when(F.col("currency") == currency, F.col("number")).otherwise(0).cast(df.schema["number"].dataType)
            df = inv.running_sum(df.withColumn("_value", F.coalesce(value, F.lit(0))), [], self.table.order, "_value", name).drop("_value")
        if self.whole_balance:
            df = df.withColumn("_pos", inv.position(F.col("number"), F.col("currency"), F.col("cost")))
            df = inv.running_inventory(df, self.table.order, "_pos", "_balance")
        if aggregated:
            df = self.groups.apply(self.aggregate(df, keys, with_seq=s.limit is not None and not order))
            if having is not None:
                df = df.where(having.col)
        names, taken = [], set()
        for i, t in enumerate(targets):
            n = t.alias or (t.expr.name if isinstance(t.expr, (Column, Call, Attribute)) else f"column{i}")
            while n.lower() in taken:
                n = f"{n}_{i}"
            taken.add(n.lower())
            names.append(n)
        scan = ["_seq"] if aggregated else self.table.order
        out = df.select(*[t.col.alias(n) for t, n in zip(outs, names, strict=True)], *[self.sortable(t).alias(f"_o{i}") for i, (t, _, _) in enumerate(order)], *([F.struct(*scan).alias("_scan")] if not aggregated or "_seq" in df.columns else []))
        if s.distinct:
            out = self.distinct(out, outs, names, len(order))
        by = [(F.col(f"_o{i}").desc_nulls_first() if desc else F.col(f"_o{i}").asc_nulls_last()) for i, (_, desc, _) in enumerate(order)]
        if "_scan" in out.columns and (order or s.limit is not None):
            by.append(F.col("_scan").asc())
        if by:
            out = out.orderBy(*by)
        if s.limit is not None:
            out = out.limit(s.limit)
        return out.select(*names)

    @staticmethod
    def sortable(t: Typed) -> SparkColumn:
        if t.type == "amount":
            return F.when(t.col.isNotNull(), F.struct(t.col["currency"], t.col["number"]))
        if t.type == "position":
            return F.when(t.col.isNotNull(), F.struct(t.col["units"]["currency"], t.col["cost"], t.col["units"]["number"]))
        if t.type == "dict":
            return F.array_sort(F.map_entries(t.col))
        if t.type == "inventory":
            return F.struct(F.size(t.col), t.col)
        return t.col

    @staticmethod
    def distinct(out: DataFrame, outs: list[Typed], names: list[str], n_order: int) -> DataFrame:
        """First row of each set of equal outputs."""
        plain = [n if t.type != "dict" else None for t, n in zip(outs, names, strict=True)]
        keyed = out.withColumns({f"_k{i}": F.array_sort(F.map_entries(n)) for i, (n, p) in enumerate(zip(names, plain, strict=True)) if p is None})
        ks = [p or f"_k{i}" for i, p in enumerate(plain)]
        rest = [c for c in out.columns if c not in ks]
        if not rest:
            return keyed.dropDuplicates(ks).select(out.columns)
        first = "_scan" if "_scan" in out.columns else None
        agg = F.min_by(F.struct(*rest), F.col(first)) if first else F.first(F.struct(*rest))
        return keyed.groupBy(*ks).agg(agg.alias("_r")).select(*[F.col(c) if c in ks else F.col(f"_r.{c}").alias(c) for c in out.columns])

    def aggregate(self, df: DataFrame, keys: list[Typed], with_seq: bool) -> DataFrame:
        """One row per group with _g0.. and _a0..; sums of positions are grouped by lot first."""
        gs = [f"_g{i}" for i in range(len(keys))]
        need = [c for c in self.table.order if c in df.columns]
        base = df.select(*[k.col.alias(g) for k, g in zip(keys, gs, strict=True)], *[s.arg.alias(f"_x{i}") for i, s in enumerate(self.slots)], *need)
        scalars_ = {f"_a{i}": s.agg for i, s in enumerate(self.slots) if s.agg is not None}
        if with_seq:
            scalars_["_seq"] = F.min(F.struct(*need))
        wholes = [i for i, s in enumerate(self.slots) if s.agg is None]
        if gs and scalars_ and wholes:
            return inv.sums_beside(base, gs, scalars_, {f"_x{i}": f"_a{i}" for i in wholes})
        parts = []
        if scalars_ or not wholes:
            parts.append(base.groupBy(*gs).agg(*[a.alias(k) for k, a in scalars_.items()] or [F.lit(1).alias("_one")]))
        parts += [inv.sum_positions(base, gs, f"_x{i}", f"_a{i}") for i in wholes]
        out = parts[0]
        for k, p in enumerate(parts[1:]):
            p = p.withColumnsRenamed({g: f"{g}_{k}" for g in gs})
            on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_{k}")) for g in gs]) if gs else F.lit(True)
            out = out.join(p, on)
        return out


def query(ledger: Ledger, text: str | Select) -> DataFrame:
    """Compile a SELECT, JOURNAL or BALANCES statement over ``ledger``."""
    return Compiler(ledger, parse(text) if isinstance(text, str) else text).run()


def plain(df: DataFrame) -> DataFrame:
    """Amounts, positions, inventories, sets and dicts as display text: rows that any sink takes."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        kind = "amount" if t.startswith("struct<number:decimal") else ("inventory" if t.startswith("array<struct<units") else "position" if t.startswith("struct<units") else "set" if t == "array<string>" else "meta" if t.startswith("struct<kind") else "dict" if t.startswith("map") else None)
        out.append((scalars.display(c, kind) if kind else c).alias(n))
    return df.select(*out)


