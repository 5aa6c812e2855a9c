"""Import of statements: a step library of typed Column expressions, and S-expression programs over it.

A step takes Columns and gives a Column; a row that a step can't read becomes NULL and a diagnostic
(``Pipeline.run``), never an error of the whole import. Amounts are structs (number, currency).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import display, strptime
from ledgerlake.model import NUM
from ledgerlake.sources.statements import Reader, exclude, number, row_hash

AMOUNT = "struct<number:decimal(18,8),currency:string>"


# --- steps ----------------------------------------------------------------------------------------


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def trim(c: Column) -> Column:
    return F.trim(c)


def coalesce(*cols: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def or_else(c: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), default)


def join_keys(sep: str, *cols: Column) -> Column:
    """Blanks are left out."""
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cols])


def split(c: Column, regex: str) -> dict[str, Column]:
    """Named groups of the first match; NULL without one."""
    names = sorted(re.compile(regex).groupindex.items(), key=lambda x: x[1])
    java = re.sub(r"\(\?P<", "(?<", regex)
    return {n: F.when(F.regexp_like(c, F.lit(java)), F.regexp_extract(c, java, i)) for n, i in names}


def map_value(c: Column, table: dict[str, str], strict: bool = True) -> Column:
    """The table's value; one that isn't there: NULL if strict, else itself."""
    out = F.lit(None).cast("string") if strict else c
    for k, v in table.items():
        out = F.when(F.trim(c) == k, v).otherwise(out)
    return out


def parse_date(c: Column, *formats: str) -> Column:
    """The first strptime format that fits."""
    return F.coalesce(*[F.try_to_date(F.trim(c), strptime(f)) for f in formats])


def date_offset(c: Column, days: int) -> Column:
    return F.date_add(c, days)


def amount(n: Column, currency: Column) -> Column:
    return F.when(n.isNotNull(), F.struct(n.cast(NUM).alias("number"), currency.alias("currency")))


def parse_amount(c: Column, currency: Column, thousands: str = ",", decimal: str = ".") -> Column:
    return amount(number(c, thousands, decimal), currency)


def _with(a: Column, n: Column) -> Column:
    return F.when(a.isNotNull(), F.struct(n.cast(NUM).alias("number"), a["currency"].alias("currency")))


def negate(a: Column) -> Column:
    return _with(a, -a["number"])


def absolute(a: Column) -> Column:
    return _with(a, F.abs(a["number"]))


def _both(a: Column, b: Column, n: Column) -> Column:
    """Of one currency, else NULL."""
    return F.when(a["currency"] == b["currency"], _with(a, n))


def add(a: Column, b: Column) -> Column:
    return _both(a, b, a["number"] + b["number"])


def subtract(a: Column, b: Column) -> Column:
    return _both(a, b, a["number"] - b["number"])


def scale(a: Column, k: str | Column) -> Column:
    return _with(a, (a["number"] * (F.lit(k) if isinstance(k, str) else k).cast(NUM)).cast(NUM))


def divide(a: Column, k: str | Column, digits: int = 8) -> Column:
    return _with(a, F.bround(F.try_divide(a["number"].cast(NUM), (F.lit(k) if isinstance(k, str) else k).cast(NUM)), digits))


def round_(a: Column, digits: int) -> Column:
    return _with(a, F.bround(a["number"], digits))


def floor(a: Column, digits: int) -> Column:
    return _with(a, F.floor(a["number"], F.lit(digits)))


def ceil(a: Column, digits: int) -> Column:
    return _with(a, F.ceil(a["number"], F.lit(digits)))


def currency_of(a: Column) -> Column:
    return a["currency"]


def template(text: str, **cols: Column) -> Column:
    """``{name}`` filled in; a NULL is empty."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[F.coalesce(cols[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def matches(c: Column, regex: str) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(regex)), F.lit(False))


def posting(account: Column, a: Column | None = None, cost: Column | None = None, price: Column | None = None) -> Column:
    none = F.lit(None).cast(AMOUNT)
    return F.struct(account.alias("account"), (none if a is None else a).alias("amount"), (none if cost is None else cost).alias("cost"), (none if price is None else price).alias("price"))


def double_entry(account: Column, counter: Column, a: Column) -> list[Column]:
    """The leg and its negated counter leg."""
    return [posting(account, a), posting(counter, negate(a))]


@dataclass
class Pipeline:
    """Named steps over records; rows that lack a required one become diagnostics.

    ``steps`` maps names to functions of the record's columns and earlier steps; ``warn`` names steps
    whose failure is a warning and keeps the row.
    """

    name: str
    reader: Reader
    steps: dict[str, Callable[[dict[str, Column]], Column]]
    postings: Callable[[dict[str, Column]], list[Column]]
    required: tuple[str, ...] = ("date",)
    warn: tuple[str, ...] = ()
    excludes: list[tuple[str | None, str]] = field(default_factory=list)
    flag: str = "*"

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.reader.records(spark, path)
        for column, regex in self.excludes:
            df = exclude(df, column, regex)
        return df

    def run(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(transactions, diagnostics): date, flag, payee, narration, postings, row_hash; code, severity, file, line, message."""
        raw = [c for c in records.columns if not c.startswith("_")]
        df = records.withColumn("row_hash", row_hash(self.name, *[F.col(f"`{c}`") for c in raw]))
        env: dict[str, Column] = {c: F.col(f"`{c}`") for c in raw}
        for name, step in self.steps.items():
            df = df.withColumn(f"_s_{name}", step(env))
            env[name] = F.col(f"_s_{name}")
        bad = F.array_compact(F.array(*[F.when(env[r].isNull(), r) for r in self.required]))
        df = df.withColumn("_bad", bad)
        diag = df.where(F.size("_bad") > 0).select(F.lit("row").alias("code"), F.lit("error").alias("severity"), "_file", "_line", F.concat(F.lit("no "), F.array_join("_bad", ", ")).alias("message"))
        for w in self.warn:
            diag = diag.unionByName(df.where(env[w].isNull() & (F.size("_bad") == 0)).select(F.lit("row").alias("code"), F.lit("warning").alias("severity"), "_file", "_line", F.lit(f"no {w}").alias("message")))
        text = lambda k: env[k] if k in env else F.lit(None).cast("string")
        legs = F.array_compact(F.array(*[F.when(p["account"].isNotNull(), p) for p in self.postings(env)]))
        good = df.where(F.size("_bad") == 0)
        return good.select(env["date"].alias("date"), F.lit(self.flag).alias("flag"), text("payee").alias("payee"), F.coalesce(text("narration"), F.lit("")).alias("narration"), legs.alias("postings"), "row_hash", "_file", "_line"), diag


def from_config(c: dict) -> Pipeline:
    """A pipeline from a mapping (as read from TOML): date, date_format, amount (or debit and credit), currency,
    account, counter, payee, narration, header, delimiter, charset, skip, exclude, accounts and counters (tables)."""
    col = lambda env, k: env[c[k]] if k in c and c[k] in env else F.lit(None).cast("string")
    num = lambda x: number(x, c.get("thousands", ","), c.get("decimal", "."))

    def value(env):
        if "debit" in c or "credit" in c:
            n = F.coalesce(num(col(env, "credit")), F.lit(0).cast(NUM)) - F.coalesce(F.abs(num(col(env, "debit"))), F.lit(0).cast(NUM))
        else:
            n = num(col(env, "amount"))
        currency = or_else(col(env, "currency_column"), F.lit(c.get("currency"))) if "currency_column" in c else F.lit(c.get("currency"))
        got = amount(n, currency)
        return negate(got) if c.get("negate") else got

    def account(key, table):
        def step(env):
            if f"{key}_column" in c:
                return map_value(env[c[f"{key}_column"]], c.get(table, {}), strict=table in c)
            return F.lit(c.get(key))

        return step

    steps = {"date": lambda env: parse_date(col(env, "date"), *([c["date_format"]] if isinstance(c.get("date_format", "%Y-%m-%d"), str) and "date_format" in c else c.get("date_formats", ["%Y-%m-%d"]))), "value": value, "account": account("account", "accounts"), "counter": account("counter", "counters")}
    for k in ("payee", "narration"):
        if k in c:
            steps[k] = (lambda ks: lambda env: join_keys(" ", *[env[x] for x in ks]))([c[k]] if isinstance(c[k], str) else c[k])
    used = [v for k, v in c.items() if k in ("date", "amount", "debit", "credit", "payee", "narration", "currency_column", "account_column", "counter_column") for v in ([v] if isinstance(v, str) else v)]
    reader = Reader(c.get("delimiter", ","), c.get("charset", "UTF-8"), header=() if "columns" in c else tuple(c.get("header", dict.fromkeys(used))), columns=tuple(c.get("columns", ())), skip=c.get("skip", 0))
    return Pipeline(c.get("name", "csv"), reader, steps, lambda e: double_entry(e["account"], e["counter"], e["value"]), ("date", "value", "account"), excludes=[(x.get("column"), x["regex"]) for x in c.get("exclude", [])], flag=c.get("flag", "*"))


def dispatch(path: str, pipelines: list[tuple[str, Pipeline]]) -> Pipeline | None:
    """The first whose file-name pattern matches."""
    return next((p for rx, p in pipelines if re.search(rx, path)), None)


def chain(*hooks: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for h in hooks:
            df = h(df)
        return df

    return run


def balance_with(account: str) -> Callable[[DataFrame], DataFrame]:
    """A leg to ``account`` for transactions of one leg."""
    extra = lambda: posting(F.lit(account))
    return lambda df: df.withColumn("postings", F.when(F.size("postings") == 1, F.concat("postings", F.array(extra()))).otherwise(F.col("postings")))


def stamp_metadata(**values: str) -> Callable[[DataFrame], DataFrame]:
    """Keys set on every transaction; those already there stay."""

    def run(df: DataFrame) -> DataFrame:
        have = F.col("meta") if "meta" in df.columns else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        new = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(v) for v in values.values()]))
        return df.withColumn("meta", F.map_concat(F.map_filter(new, lambda k, v: ~F.map_contains_key(have, k)), have))

    return run


def printed(transactions: DataFrame) -> DataFrame:
    """Transactions as ledger text, a row each."""
    leg = lambda p: F.concat(F.lit("  "), p["account"], F.when(p["amount"].isNotNull(), F.concat(F.lit("  "), display(p["amount"], "amount"))).otherwise(""))
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    payee = F.when(F.coalesce(F.col("payee"), F.lit("")) != "", F.concat(F.lit(" "), quote(F.col("payee")))).otherwise("")
    head = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "), "flag", payee, F.lit(" "), quote(F.col("narration")))
    return transactions.select("date", "row_hash", F.concat(head, F.lit('\n  row_hash: "'), "row_hash", F.lit('"\n'), F.array_join(F.transform("postings", leg), "\n"), F.lit("\n")).alias("text"))


# --- S-expressions --------------------------------------------------------------------------------


class ProgramError(ValueError):
    pass


def read_program(text: str) -> list:
    """Nested lists of an S-expression text; strings are ('str', s), numbers stay text."""
    toks = re.findall(r';[^\n]*|"(?:\\.|[^"\\])*"|[()]|[^\s()";]+', text)
    stack: list[list] = [[]]
    for t in toks:
        if t[0] == ";":
            continue
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise ProgramError("unexpected )")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(("str", re.sub(r"\\(.)", r"\1", t[1:-1])) if t[0] == '"' else t)
    if len(stack) != 1:
        raise ProgramError("missing )")
    return stack[0]


class Program:
    """An S-expression over a record: ``(let* ((name expr)...) (emit-transaction ...))``.

    Every form builds a Column (or an argument of one: tables, formats, postings), so a program is a plan.
    """

    def __init__(self, text: str):
        body = read_program(text)
        if len(body) != 1:
            raise ProgramError("a program is one expression")
        self.body = body[0]

    def run(self, records: DataFrame, name: str = "program", **hints: str) -> DataFrame:
        """Transactions (date, flag, payee, narration, tags, links, meta, postings, row_hash) of the records it emits for."""
        raw = [c for c in records.columns if not c.startswith("_")]
        self.hints, self.cols = hints, {c: F.col(f"`{c}`") for c in raw}
        out = self.eval(self.body, {})
        if not isinstance(out, dict):
            raise ProgramError("the program must end in emit-transaction")
        none = lambda t: F.lit(None).cast(t)
        keep = out.get("when", F.lit(True))
        cols = [out["date"].alias("date"), out.get("flag", F.lit("*")).alias("flag"), out.get("payee", none("string")).alias("payee"), out.get("narration", F.lit("")).alias("narration"), out.get("tags", none("array<string>")).alias("tags"), out.get("links", none("array<string>")).alias("links"), out.get("meta", none("map<string,string>")).alias("meta"), F.array_compact(F.array(*out["postings"])).alias("postings"), row_hash(name, *self.cols.values()).alias("row_hash")]
        return records.where(F.coalesce(keep, F.lit(False))).select(*cols, *[c for c in records.columns if c.startswith("_")])

    def eval(self, e, env: dict):
        if isinstance(e, tuple):
            return F.lit(e[1])
        if isinstance(e, str):
            if e in env:
                return env[e]
            if re.fullmatch(r"[-+]?\d+(\.\d+)?", e):
                return F.lit(e).cast(NUM)
            if e in ("true", "false"):
                return F.lit(e == "true")
            raise ProgramError(f"unknown name {e}")
        if not e or not isinstance(e[0], str):
            raise ProgramError(f"not a form: {e}")
        head, *args = e
        special = getattr(self, "_" + re.sub(r"\W", "_", head.replace("*", "_star")), None)
        if special is not None:
            return special(args, env)
        f = _FORMS.get(head)
        if f is None:
            raise ProgramError(f"unknown form {head}")
        return f(*[self.eval(a, env) for a in args])

    def text(self, e) -> str:
        return e[1] if isinstance(e, tuple) else e

    def _let_star(self, args, env):
        env = dict(env)
        for name, value in args[0]:
            env[name] = self.eval(value, env)
        return [self.eval(x, env) for x in args[1:]][-1]

    def _column(self, args, env):
        name = self.text(args[0])
        if name not in self.cols:
            raise ProgramError(f"no column {name}")
        return self.cols[name]

    def _row(self, args, env):
        return F.map_from_arrays(F.array(*[F.lit(c) for c in self.cols]), F.array(*self.cols.values()))

    def _const(self, args, env):
        return self.eval(args[0], env)

    def _hint(self, args, env):
        return F.lit(self.hints.get(self.text(args[0])))

    def _dict(self, args, env):
        return {self.text(a): self.text(b) for a, b in zip(args[::2], args[1::2], strict=True)}

    def _regex(self, args, env):
        return self.text(args[0])

    def _number_format(self, args, env):
        return (self.text(args[0]), self.text(args[1]))

    def _bindings(self, args, env):
        return {self.text(n): self.eval(v, env) for n, v in args}

    def _merge(self, args, env):
        return {k: v for a in args for k, v in self.eval(a, env).items()}

    def _split(self, args, env):
        rx = self.eval(args[1], env) if isinstance(args[1], list) else self.text(args[1])
        return split(self.eval(args[0], env), rx)

    def _group(self, args, env):
        return self.eval(args[0], env)[self.text(args[1])]

    def _join_keys(self, args, env):
        return join_keys(self.text(args[0]), *[self.eval(a, env) for a in args[1:]])

    def _map_value(self, args, env):
        table = self.eval(args[1], env)
        return map_value(self.eval(args[0], env), table, strict=len(args) < 3)

    def _parse_date(self, args, env):
        return parse_date(self.eval(args[0], env), *[self.text(a) for a in args[1:]])

    def _date_offset(self, args, env):
        return date_offset(self.eval(args[0], env), int(args[1]))

    def _parse_amount(self, args, env):
        fmt = self.eval(args[2], env) if len(args) > 2 else (",", ".")
        return parse_amount(self.eval(args[0], env), self.eval(args[1], env), *fmt)

    def _template(self, args, env):
        binds = self.eval(args[1], env) if len(args) > 1 else {k: v for k, v in env.items() if isinstance(v, Column)}
        return template(self.text(args[0]), **binds)

    def _matches_(self, args, env):
        rx = self.eval(args[1], env) if isinstance(args[1], list) else self.text(args[1])
        return matches(self.eval(args[0], env), rx)

    def _round_amount(self, args, env):
        return round_(self.eval(args[0], env), int(args[1]))

    def _floor_amount(self, args, env):
        return floor(self.eval(args[0], env), int(args[1]))

    def _ceil_amount(self, args, env):
        return ceil(self.eval(args[0], env), int(args[1]))

    def _divide_amount(self, args, env):
        return divide(self.eval(args[0], env), self.eval(args[1], env), int(args[2]) if len(args) > 2 else 8)

    def _if(self, args, env):
        return F.when(self.eval(args[0], env), self.eval(args[1], env)).otherwise(self.eval(args[2], env) if len(args) > 2 else None)

    def _when(self, args, env):
        return self._guard(self.eval(args[0], env), args[1:], env)

    def _unless(self, args, env):
        return self._guard(~self.eval(args[0], env), args[1:], env)

    def _guard(self, test, body, env):
        got = [self.eval(x, env) for x in body][-1]
        return got | {"when": got.get("when", F.lit(True)) & test} if isinstance(got, dict) else F.when(test, got)

    def _cond(self, args, env):
        out = F.lit(None)
        for test, value in reversed(args):
            v = self.eval(value, env)
            out = v if test == "else" else F.when(self.eval(test, env), v).otherwise(out)
        return out

    def _postings(self, args, env):
        out = []
        for a in args:
            v = self.eval(a, env)
            out += v if isinstance(v, list) else [v]
        return out

    def _double_entry(self, args, env):
        return double_entry(*[self.eval(a, env) for a in args])

    def _tags(self, args, env):
        return F.array(*[self.eval(a, env) for a in args])

    _links = _tags

    def _meta(self, args, env):
        kv = [(self.text(a), self.eval(b, env)) for a, b in zip(args[::2], args[1::2], strict=True)]
        return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in kv]), F.array(*[v.cast("string") for _, v in kv]))

    def _emit_transaction(self, args, env):
        """``(emit-transaction :date d :payee p :narration n :postings ps ...)``"""
        out = {k[1:]: self.eval(v, env) for k, v in zip(args[::2], args[1::2], strict=True)}
        if "date" not in out or "postings" not in out:
            raise ProgramError("emit-transaction needs :date and :postings")
        if not isinstance(out["postings"], list):
            out["postings"] = [out["postings"]]
        return out

    _transaction = _emit_transaction

    def _emit(self, args, env):
        return self.eval(args[0], env)

    _directive = _emit


_cmp = lambda f: lambda a, b: F.when(a["currency"] == b["currency"], f(a["number"], b["number"]))
_FORMS: dict[str, Callable] = {
    "trim": trim, "coalesce": coalesce, "or-else": or_else, "required": lambda c: F.nullif(F.trim(c), F.lit("")), "diag-as-warning": lambda c: c, "negate-amount": negate, "add-amounts": add, "sub-amounts": subtract,
    "abs-amount": absolute, "scale-amount": scale, "currency-hint": currency_of, "empty?": blank, "equal?": lambda a, b: F.coalesce(a == b, F.lit(False)), "and": lambda *x: _fold(x, lambda a, b: a & b), "or": lambda *x: _fold(x, lambda a, b: a | b),
    "not": lambda x: ~x, "negative?": lambda a: a["number"] < 0, "positive?": lambda a: a["number"] > 0, "zero?": lambda a: a["number"] == 0, "amount<?": _cmp(lambda a, b: a < b), "amount>?": _cmp(lambda a, b: a > b), "amount=?": _cmp(lambda a, b: a == b),
    "amount": lambda n, c: amount(n, c), "require-amount": lambda a: a, "posting": posting, "cost": lambda a: a, "price": lambda a: a,
}


def _fold(x, f):
    out = x[0]
    for y in x[1:]:
        out = f(out, y)
    return out
