"""The ledger query language: scanner, recursive-descent parser, syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal
from typing import Any


class QueryError(ValueError):
    """A query that can't be read or typed; carries its position."""

    def __init__(self, message: str, pos: int = 0):
        super().__init__(f"{message} (at {pos})")
        self.pos = pos


@dataclass
class Expr:
    pos: int


@dataclass
class Literal(Expr):
    value: Any
    type: str


@dataclass
class Column(Expr):
    name: str


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]


@dataclass
class Unary(Expr):
    op: str
    x: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class ListOf(Expr):
    items: list[Expr]


@dataclass
class IsNull(Expr):
    x: Expr
    negated: bool


@dataclass
class Attribute(Expr):
    x: Expr
    name: str


@dataclass
class Index(Expr):
    x: Expr
    key: Expr


@dataclass
class Target:
    expr: Expr
    alias: str | None = None


@dataclass
class Order:
    expr: Expr
    desc: bool = False


@dataclass
class From:
    expr: Expr | None = None
    open_on: date | None = None
    close_on: date | None = None
    clear: bool = False


@dataclass
class Select:
    targets: list[Target] | None
    distinct: bool = False
    source: From = field(default_factory=From)
    where: Expr | None = None
    group_by: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order_by: list[Order] = field(default_factory=list)
    limit: int | None = None


RESERVED = {"SELECT", "DISTINCT", "AS", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "ASC", "DESC", "LIMIT", "AND", "OR", "NOT", "IN", "IS", "NULL", "TRUE", "FALSE", "BETWEEN"}
_TOKEN = re.compile(
    r"""\s*(?:(?P<date>\d{4}-\d{2}-\d{2})(?![\d-])|(?P<dec>\d+\.\d*|\.\d+)|(?P<int>\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<str>'(?:\\.|''|[^'\\])*'|"(?:\\.|""|[^"\\])*")|(?P<op>!=|<=|>=|[=<>~+\-*/%(),.;\[\]]))""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str
    pos: int


def scan(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:].strip()[0]!r}", at)
        kind = m.lastgroup
        word = m[kind]
        pos = m.start(kind)
        if kind == "name" and word.upper() in RESERVED:
            kind, word = "key", word.upper()
        if kind == "str":
            q = word[0]
            word = re.sub(r"\\(.)|" + q + q, lambda e: e[1] if e[1] is not None else q, word[1:-1], flags=re.S)
        out.append(Token(kind, word, pos))
        at = m.end()
    return [*out, Token("end", "", len(text))]


class Parser:
    def __init__(self, text: str):
        self.toks, self.i = scan(text), 0

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def next(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def is_(self, *words: str) -> bool:
        return self.tok.kind in ("key", "op") and self.tok.text in words

    def soft(self, word: str) -> bool:
        """A word that is a keyword here only."""
        return self.tok.kind == "name" and self.tok.text.upper() == word

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> Token:
        if not self.is_(word):
            raise QueryError(f"expected {word}, found {self.tok.text or 'the end'}", self.tok.pos)
        return self.next()

    def statement(self) -> Select:
        if self.soft("JOURNAL"):
            out = self.journal()
        elif self.soft("BALANCES"):
            out = self.balances()
        else:
            out = self.select()
        self.take(";")
        if self.tok.kind != "end":
            raise QueryError(f"unexpected {self.tok.text!r}", self.tok.pos)
        return out

    def select(self) -> Select:
        self.need("SELECT")
        s = Select(None, distinct=self.take("DISTINCT"))
        if not self.take("*"):
            s.targets = [self.target()]
            while self.take(","):
                s.targets.append(self.target())
        if self.is_("FROM"):
            s.source = self.source()
        if self.take("WHERE"):
            s.where = self.expr()
        if self.take("GROUP"):
            self.need("BY")
            s.group_by = self.exprs()
        if self.take("HAVING"):
            s.having = self.expr()
        if self.take("ORDER"):
            self.need("BY")
            s.order_by = [self.order()]
            while self.take(","):
                s.order_by.append(self.order())
        if self.take("LIMIT"):
            if self.tok.kind != "int":
                raise QueryError("LIMIT takes an integer", self.tok.pos)
            s.limit = int(self.next().text)
        return s

    def summary(self) -> str | None:
        if not self.soft("AT"):
            return None
        self.next()
        if self.tok.kind != "name":
            raise QueryError("AT takes a function name", self.tok.pos)
        return self.next().text

    def journal(self) -> Select:
        pos = self.next().pos
        account = self.next().text if self.tok.kind == "str" else None
        f = self.summary()
        col = lambda n: Column(pos, n)
        wrap = lambda n: Call(pos, f, [col(n)]) if f else col(n)
        wide = lambda n, k: Call(pos, "maxwidth", [col(n), Literal(pos, k, "int")])
        s = Select([Target(e) for e in (col("date"), col("flag"), wide("payee", 48), wide("narration", 80), col("account"), wrap("position"), wrap("balance"))])
        if self.is_("FROM"):
            s.source = self.source()
        if account is not None:
            s.where = Binary(pos, "~", col("account"), Literal(pos, account, "string"))
        return s

    def balances(self) -> Select:
        pos = self.next().pos
        f = self.summary()
        position: Expr = Column(pos, "position")
        key = lambda: Call(pos, "account_sortkey", [Column(pos, "account")])
        s = Select([Target(Column(pos, "account")), Target(Call(pos, "sum", [Call(pos, f, [position]) if f else position]))], group_by=[Column(pos, "account"), key()], order_by=[Order(key())])
        if self.is_("FROM"):
            s.source = self.source()
        if self.take("WHERE"):
            s.where = self.expr()
        return s

    def source(self) -> From:
        self.need("FROM")
        f = From()
        scope = lambda: self.soft("OPEN") or self.soft("CLOSE") or self.soft("CLEAR")
        if not scope() or self.toks[self.i + 1].kind == "op":
            f.expr = self.expr()
        while scope():
            word = self.next().text.upper()
            if word == "CLEAR":
                f.clear = True
                continue
            if not self.soft("ON"):
                raise QueryError(f"expected ON after {word}", self.tok.pos)
            self.next()
            if self.tok.kind != "date":
                raise QueryError(f"{word} ON takes a date", self.tok.pos)
            d = self.day(self.next())
            if word == "OPEN":
                f.open_on = d
            else:
                f.close_on = d
        return f

    def day(self, t: Token) -> date:
        try:
            return date.fromisoformat(t.text)
        except ValueError as e:
            raise QueryError(f"no such date: {t.text}", t.pos) from e

    def target(self) -> Target:
        e = self.expr()
        if self.take("AS"):
            if self.tok.kind != "name":
                raise QueryError("AS takes a name", self.tok.pos)
            return Target(e, self.next().text)
        return Target(e)

    def order(self) -> Order:
        e = self.expr()
        if self.take("DESC"):
            return Order(e, True)
        self.take("ASC")
        return Order(e)

    def exprs(self) -> list[Expr]:
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def expr(self) -> Expr:
        return self.chain(lambda: self.chain(self.negation, "AND"), "OR")

    def chain(self, inner, *ops: str) -> Expr:
        left = inner()
        while self.is_(*ops):
            t = self.next()
            left = Binary(t.pos, t.text, left, inner())
        return left

    def negation(self) -> Expr:
        if self.is_("NOT"):
            return Unary(self.next().pos, "NOT", self.negation())
        return self.comparison()

    def comparison(self) -> Expr:
        left = self.sum()
        out = self.compared(left)
        if out is not left and (self.is_("=", "!=", "<", "<=", ">", ">=", "~", "IN", "IS", "BETWEEN") or (self.is_("NOT") and self.toks[self.i + 1].text in ("IN", "BETWEEN"))):
            raise QueryError("comparisons don't chain", self.tok.pos)
        return out

    def compared(self, left: Expr) -> Expr:
        pos = self.tok.pos
        if self.is_("=", "!=", "<", "<=", ">", ">=", "~"):
            return Binary(pos, self.next().text, left, self.sum())
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return IsNull(pos, left, negated)
        negated = self.is_("NOT") and self.toks[self.i + 1].text in ("IN", "BETWEEN")
        if negated:
            self.next()
        if self.take("IN"):
            out: Expr = Binary(pos, "IN", left, self.sum())
        elif self.take("BETWEEN"):
            low = self.sum()
            self.need("AND")
            out = Binary(pos, "AND", Binary(pos, ">=", left, low), Binary(pos, "<=", left, self.sum()))
        else:
            return left
        return Unary(pos, "NOT", out) if negated else out

    def sum(self) -> Expr:
        return self.chain(lambda: self.chain(self.sign, "*", "/", "%"), "+", "-")

    def sign(self) -> Expr:
        if self.is_("-", "+"):
            t = self.next()
            return Unary(t.pos, t.text, self.sign())
        return self.postfix()

    def postfix(self) -> Expr:
        e = self.primary()
        while True:
            if self.is_("."):
                pos = self.next().pos
                if self.tok.kind != "name":
                    raise QueryError("expected an attribute name", self.tok.pos)
                e = Attribute(pos, e, self.next().text.lower())
            elif self.is_("["):
                pos = self.next().pos
                key = self.expr()
                self.need("]")
                e = Index(pos, e, key)
            else:
                return e

    def primary(self) -> Expr:
        t = self.next()
        if t.kind == "int":
            return Literal(t.pos, int(t.text), "int")
        if t.kind == "dec":
            return Literal(t.pos, Decimal(t.text), "decimal")
        if t.kind == "str":
            return Literal(t.pos, t.text, "string")
        if t.kind == "date":
            return Literal(t.pos, self.day(t), "date")
        if t.kind == "key" and t.text in ("TRUE", "FALSE"):
            return Literal(t.pos, t.text == "TRUE", "bool")
        if t.kind == "key" and t.text == "NULL":
            return Literal(t.pos, None, "null")
        if t.kind == "name":
            if not self.take("("):
                return Column(t.pos, t.text)
            args = [] if self.is_(")") else self.exprs()
            self.need(")")
            return Call(t.pos, t.text.lower(), args)
        if t.text == "(":
            items = self.exprs()
            if len(items) == 1 and self.take(","):
                self.need(")")
                return ListOf(t.pos, items)
            self.need(")")
            return items[0] if len(items) == 1 else ListOf(t.pos, items)
        raise QueryError(f"unexpected {t.text or 'end'!r}", t.pos)


def parse(text: str) -> Select:
    return Parser(text).statement()
