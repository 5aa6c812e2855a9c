"""Ledger text: parsing with recovery, includes with globs, overlays; one row per directive and posting.

A file is parsed on its own (``parse_text``), so many files may be parsed on executors
(``read_files``). Includes are resolved on the driver: they are file names, not data.
"""

from __future__ import annotations

import datetime
import glob as globs
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, DivisionByZero, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.model import ENTRIES, KIND_ORDER, OTHER_KIND, POSTINGS, Ledger, Options

_DATE = re.compile(r"(\d{4})[-/](\d{2})[-/](\d{2})\b")
_ACCOUNT = r"[A-Z\u0080-\U0010FFFF][\w\-\u0080-\U0010FFFF]*(?::[A-Z0-9\u0080-\U0010FFFF][\w\-\u0080-\U0010FFFF]*)+"
_CURRENCY = r"(?:/?[A-Z][A-Z0-9'._\-]*[A-Z0-9]|[A-Z])\b"
_LEX = re.compile(
    rf"""(?P<ws>[ \t]+)|(?P<comment>;.*)|(?P<string>"(?:\\.|[^"\\])*")|(?P<date>\d{{4}}[-/]\d{{2}}[-/]\d{{2}}\b)|(?P<number>(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d*)?|\.\d+)
    |(?P<tag>\#[A-Za-z0-9\-_/.]+)|(?P<link>\^[A-Za-z0-9\-_/.]+)|(?P<account>{_ACCOUNT})|(?P<key>[a-z][\w\-]*:(?=\s|$))|(?P<currency>{_CURRENCY})
    |(?P<word>[A-Za-z][A-Za-z]*)|(?P<op>@@|@|\{{\{{|\}}\}}|\{{|\}}|[-+*/(),~!&?%|#:])""",
    re.X,
)
FLAGS = "*!&#?%"


class SyntaxFault(ValueError):
    pass


@dataclass
class Parsed:
    """What a text holds: directive and posting dicts in file order, headers, diagnostics."""

    directives: list[dict] = field(default_factory=list)
    options: list[tuple[str, str]] = field(default_factory=list)
    plugins: list[tuple[str, str | None]] = field(default_factory=list)
    includes: list[tuple[str, int]] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)


def evaluate(tokens: list[tuple[str, str]], at: int = 0) -> tuple[Decimal | None, int, int]:
    """(value, digits after the point, next token) of an arithmetic expression; None if there is none at ``at``."""

    def scale(n: Decimal) -> int:
        return max(0, -n.as_tuple().exponent)

    def primary(i: int) -> tuple[Decimal, int]:
        kind, text = tokens[i] if i < len(tokens) else ("end", "")
        if kind == "op" and text in "+-":
            n, i = primary(i + 1)
            return (-n if text == "-" else n), i
        if text == "(":
            n, i = total(i + 1)
            if i >= len(tokens) or tokens[i][1] != ")":
                raise SyntaxFault("expected )")
            return n, i + 1
        if kind != "number":
            raise SyntaxFault("expected a number")
        return Decimal(text.replace(",", "")), i + 1

    def product(i: int) -> tuple[Decimal, int]:
        n, i = primary(i)
        while i < len(tokens) and tokens[i][0] == "op" and tokens[i][1] in ("*", "/"):
            m, j = primary(i + 1)
            with localcontext() as c:
                c.prec = 34
                try:
                    n = n * m if tokens[i][1] == "*" else n / m
                except (DivisionByZero, InvalidOperation) as e:
                    raise SyntaxFault("division by zero") from e
            i = j
        return n, i

    def total(i: int) -> tuple[Decimal, int]:
        n, i = product(i)
        while i < len(tokens) and tokens[i][0] == "op" and tokens[i][1] in "+-":
            m, j = product(i + 1)
            n = n + m if tokens[i][1] == "+" else n - m
            i = j
        return n, i

    if at >= len(tokens) or not (tokens[at][0] == "number" or tokens[at][1] in ("+", "-", "(")):
        return None, 0, at
    n, i = total(at)
    return n, scale(n), i


class _Line:
    """Tokens of one logical line with a cursor."""

    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise SyntaxFault(f"unexpected {text[at]!r}")
            at = m.end()
            if m.lastgroup == "comment":
                break
            if m.lastgroup == "ws":
                continue
            word = m[m.lastgroup]
            self.toks.append((m.lastgroup, re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), word[1:-1], flags=re.S) if m.lastgroup == "string" else word))
        self.i = 0

    def peek(self, *kinds: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] in kinds

    def op(self, *texts: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][0] == "op" and self.toks[self.i][1] in texts

    def take(self, *kinds: str) -> str:
        if not self.peek(*kinds):
            raise SyntaxFault(f"expected {' or '.join(kinds)}, found {self.toks[self.i][1] if self.i < len(self.toks) else 'the end'!r}")
        self.i += 1
        return self.toks[self.i - 1][1]

    def number(self) -> tuple[Decimal | None, int]:
        n, scale, self.i = evaluate(self.toks, self.i)
        return n, scale

    def done(self) -> None:
        if self.i < len(self.toks):
            raise SyntaxFault(f"unexpected {self.toks[self.i][1]!r}")


def _day(text: str) -> datetime.date:
    try:
        return datetime.date.fromisoformat(text.replace("/", "-"))
    except ValueError as e:
        raise SyntaxFault(f"no such date: {text}") from e


def _amount(line: _Line) -> dict:
    n, scale = line.number()
    if n is None:
        raise SyntaxFault("expected an amount")
    return {"number": n, "currency": line.take("currency"), "scale": scale}


def _meta_value(line: _Line) -> dict:
    v = {"kind": None, "s": None, "n": None, "d": None, "b": None, "currency": None}
    if line.i >= len(line.toks):
        return v | {"kind": "none"}
    kind, text = line.toks[line.i]
    if kind in ("string", "date", "tag", "link", "account", "currency"):
        line.i += 1
        if kind == "date":
            return v | {"kind": "date", "d": _day(text)}
        return v | {"kind": kind, "s": text[1:] if kind in ("tag", "link") else text}
    if kind == "word" and text in ("TRUE", "FALSE"):
        line.i += 1
        return v | {"kind": "bool", "b": text == "TRUE"}
    n, _ = line.number()
    if n is None:
        raise SyntaxFault(f"not a metadata value: {text!r}")
    if line.peek("currency"):
        return v | {"kind": "amount", "n": n, "currency": line.take("currency")}
    return v | {"kind": "number", "n": n}


def _cost(line: _Line) -> dict | None:
    total = line.op("{{")
    line.i += 1
    out = {"per_unit": None, "total": None, "currency": None, "date": None, "label": None}
    close = "}}" if total else "}"
    while not line.op(close):
        if line.op(",", "*"):
            line.i += 1
        elif line.peek("date"):
            out["date"] = _day(line.take("date"))
        elif line.peek("string"):
            out["label"] = line.take("string")
        elif line.peek("currency"):
            out["currency"] = line.take("currency")
        elif line.op("#"):
            line.i += 1
            out["total"], _ = line.number()
        else:
            n, _ = line.number()
            if n is None:
                raise SyntaxFault("not a cost")
            out["total" if total else "per_unit"] = n
    line.i += 1
    return out


def _posting(line: _Line) -> dict:
    p: dict = {"posting_flag": None, "number": None, "scale": None, "currency": None, "cost": None, "cost_spec": None, "price": None, "meta": {}}
    if line.op(*FLAGS) or (line.peek("currency") and len(line.toks) > 1 and line.toks[1][0] == "account"):
        p["posting_flag"] = line.toks[line.i][1]
        line.i += 1
    p["account"] = line.take("account")
    n, scale = line.number()
    if n is not None:
        p["number"], p["scale"] = n, scale
    if line.peek("currency"):
        p["currency"] = line.take("currency")
    if line.op("{", "{{"):
        p["cost_spec"] = _cost(line)
    if line.op("@", "@@"):
        total = line.op("@@")
        line.i += 1
        n, _ = line.number()
        if n is not None or line.peek("currency"):
            p["price"] = {"number": n, "currency": line.take("currency") if line.peek("currency") else None, "is_total": total}
    line.done()
    return p


def _words(line: _Line, d: dict) -> None:
    """Strings, tags and links after a flag or directive."""
    while line.peek("tag", "link"):
        kind, text = line.toks[line.i]
        line.i += 1
        d["tags" if kind == "tag" else "links"].append(text[1:])


def _directive(line: _Line, d: dict) -> None:
    """The rest of a dated line after its date, by kind."""
    if line.op(*FLAGS) or (line.peek("word") and line.toks[line.i][1] == "txn") or line.peek("currency"):
        flag = line.toks[line.i][1]
        line.i += 1
        d.update(type="transaction", flag="*" if flag == "txn" else flag, postings=[])
        texts = []
        while line.peek("string"):
            texts.append(line.take("string"))
            if line.op("|"):
                line.i += 1
        d["payee"], d["narration"] = (texts[0], texts[1]) if len(texts) > 1 else (None, texts[0] if texts else "")
        _words(line, d)
        return
    kind = line.take("word")
    d["type"] = kind
    if kind == "open":
        d["account"] = line.take("account")
        d["currencies"] = []
        while line.peek("currency"):
            d["currencies"].append(line.take("currency"))
            if line.op(","):
                line.i += 1
        if line.peek("string"):
            d["booking"] = line.take("string")
    elif kind == "close":
        d["account"] = line.take("account")
    elif kind == "commodity":
        d["name"] = line.take("currency")
    elif kind == "balance":
        d["account"] = line.take("account")
        n, scale = line.number()
        if n is None:
            raise SyntaxFault("expected an amount")
        if line.op("~"):
            line.i += 1
            d["tolerance"], _ = line.number()
        d["amount"], d["scale"] = {"number": n, "currency": line.take("currency")}, scale
    elif kind == "pad":
        d["account"], d["pad_account"] = line.take("account"), line.take("account")
    elif kind == "note":
        d["account"], d["comment"] = line.take("account"), line.take("string")
        _words(line, d)
    elif kind == "document":
        d["account"], d["value"] = line.take("account"), line.take("string")
        _words(line, d)
    elif kind == "event":
        d["name"], d["value"] = line.take("string"), line.take("string")
    elif kind == "query":
        d["name"], d["value"] = line.take("string"), line.take("string")
    elif kind == "price":
        d["name"] = line.take("currency")
        a = _amount(line)
        d["scale"] = a.pop("scale")
        d["amount"] = a
    elif kind == "custom":
        d["name"] = line.take("string")
        values = []
        while line.i < len(line.toks):
            v = _meta_value(line)
            values.append(v)
        d["custom"] = values
        d["value"] = "\x1f".join(str(next((v[k] for k in ("s", "n", "d", "b") if v[k] is not None), "")) for v in values)
    else:
        raise SyntaxFault(f"no directive {kind}")
    line.done()


def _lines(text: str) -> Iterator[str]:
    """``text.split("\\n")``, a line at a time."""
    start = 0
    while (end := text.find("\n", start)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:]


def _logical_lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines, those inside an open string joined to the line it began on."""
    start, held = 0, ""
    for k, line in enumerate(_lines(text), 1):
        if not held and '"' not in line:
            yield start or k, line
            start = 0
            continue
        held = f"{held}\n{line}" if held else line
        start = start or k
        bare = re.sub(r'"(?:\\.|[^"\\])*"', "", held)
        cut = bare.split(";")[0]
        if '"' in cut and k - start < 200:
            continue
        yield start, held
        start, held = 0, ""
    if held:
        yield start, held


def commented(text: str) -> str:
    """Directives that are commented out (``; 2024-...`` and the indented comment lines after them), as text."""
    out, inside = [], False
    for line in text.split("\n"):
        m = re.match(r"^;+ ?(.*)$", line)
        body = m[1] if m else ""
        if m and _DATE.match(body):
            inside = True
            out.append(body)
        elif m and inside and re.match(r"^\s+\S", body):
            out.append(body)
        else:
            inside = False
            out.append("")
    return "\n".join(out)


def parse_text(text: str, filename: str = "<string>") -> Parsed:
    """Directives of one text. A statement that can't be read becomes a diagnostic; the next one is read on."""
    out = Parsed()
    out.directives.extend(read_directives(text, filename, out))
    return out


def read_directives(text: str, filename: str, out: Parsed) -> Iterator[dict]:
    """The directives of ``parse_text`` one after another; options, includes, plugins and diagnostics go to ``out``."""
    current, last, tags, metas = None, None, [], {}

    def fault(no: int, message: str) -> None:
        out.diagnostics.append({"code": "syntax", "severity": "error", "filename": filename, "lineno": no, "message": message})

    for no, raw in _logical_lines(text.lstrip("\ufeff").replace("\r\n", "\n")):
        if not raw.strip() or raw.lstrip().startswith(";") or re.match(r"^[*#]", raw):
            if not raw.strip():
                current = None
            continue
        try:
            if raw[0] in " \t":
                if current is None:
                    raise SyntaxFault("an indented line without a directive")
                line = _Line(raw)
                if not line.toks:
                    continue
                if line.peek("key"):
                    key = line.take("key")[:-1]
                    owner = current["postings"][-1] if current.get("postings") else current
                    if key not in owner["meta"]:
                        owner["meta"][key] = _meta_value(line)
                    line.done()
                elif line.peek("tag", "link") and current["type"] == "transaction":
                    _words(line, current)
                    line.done()
                elif current["type"] == "transaction":
                    current["postings"].append(_posting(line) | {"lineno": no})
                else:
                    raise SyntaxFault("a posting outside of a transaction")
                continue
            current = None
            line = _Line(raw)
            if not line.toks:
                continue
            if not line.peek("date"):
                word = line.take("word")
                if word == "option":
                    out.options.append((line.take("string"), line.take("string")))
                elif word == "plugin":
                    name = line.take("string")
                    out.plugins.append((name, line.take("string") if line.peek("string") else None))
                elif word == "include":
                    out.includes.append((line.take("string"), no))
                elif word == "pushtag":
                    tags.append(line.take("tag")[1:])
                elif word == "poptag":
                    tag = line.take("tag")[1:]
                    if tag not in tags:
                        raise SyntaxFault(f"poptag of {tag} without its pushtag")
                    tags.remove(tag)
                elif word == "pushmeta":
                    key = line.take("key")[:-1]
                    metas[key] = _meta_value(line)
                elif word == "popmeta":
                    metas.pop(line.take("key")[:-1], None)
                else:
                    raise SyntaxFault(f"unexpected {word!r}")
                line.done()
                continue
            d: dict = {"date": _day(line.take("date")), "filename": filename, "lineno": no, "tags": list(tags), "links": [], "meta": dict(metas)}
            _directive(line, d)
            line.done()
            if d["type"] != "transaction":
                d["tags"] = [t for t in d["tags"] if t not in tags] if d["type"] not in ("note", "document") else d["tags"]
            if last is not None:
                yield last
            current = last = d
        except SyntaxFault as e:
            fault(no, str(e))
    if last is not None:
        yield last


def entry_id(d: dict) -> str:
    """A digest of what matters in a directive: not its metadata, place, or the order of tags and links."""
    keys = ("type", "date", "flag", "payee", "narration", "account", "currencies", "booking", "amount", "tolerance", "pad_account", "comment", "name", "value")
    parts = [f"{k}={d.get(k)!r}" for k in keys if d.get(k) is not None] + [f"t={sorted(set(d['tags']))}", f"l={sorted(set(d['links']))}"]
    parts += [repr([p.get(k) for k in ("account", "posting_flag", "number", "currency", "cost", "cost_spec", "price")]) for p in d.get("postings", [])]
    return hashlib.md5("\x1e".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


# --- files ----------------------------------------------------------------------------------------


class LoadError(ValueError):
    """A file that is missing or includes itself."""


def _expand(pattern: str, base: str, overlay: dict[str, str]) -> list[str]:
    full = os.path.normpath(os.path.join(base, pattern))
    if not re.search(r"[*?\[]", pattern):
        return [full]
    rx = re.compile(globs.translate(full, recursive=True, include_hidden=False))
    return sorted({*map(os.path.normpath, globs.glob(full, recursive=True)), *(p for p in overlay if rx.match(p))})


def gather(path: str, overlay: dict[str, str] | None = None) -> list[Parsed]:
    """The parsed files of a ledger: the root and all it includes, each once, in the order of inclusion."""
    overlay = {os.path.normpath(k): v for k, v in (overlay or {}).items()}
    out: list[Parsed] = []
    done: set[str] = set()

    def read(p: str) -> str:
        if p in overlay:
            return overlay[p]
        if not os.path.isfile(p):
            raise LoadError(f"no such file: {p}")
        with open(p, encoding="utf-8") as f:
            return f.read()

    def visit(p: str, stack: list[str]) -> None:
        if p in stack:
            raise LoadError(f"include cycle: {' -> '.join([*stack, p])}")
        parsed = parse_text(read(p), p)
        done.add(p)
        out.append(parsed)
        for pattern, no in parsed.includes:
            found = _expand(pattern, os.path.dirname(p), overlay)
            warn = lambda m, no=no: parsed.diagnostics.append({"code": "include", "severity": "warning", "filename": p, "lineno": no, "message": m})
            if not found:
                warn(f"{pattern} matches no file")
            for f in found:
                if f in done and f not in stack and f != p:
                    warn(f"{f} is already loaded")
                    continue
                visit(f, [*stack, p])

    visit(os.path.normpath(path), [])
    return out


def _rows(parsed: list[Parsed]) -> tuple[list[dict], list[dict]]:
    """(entries, postings) in canonical order."""
    every = [(d, f, k) for f, p in enumerate(parsed) for k, d in enumerate(p.directives)]
    every.sort(key=lambda x: (x[0]["date"], KIND_ORDER.get(x[0]["type"], OTHER_KIND), x[0]["filename"], x[0]["lineno"], x[1], x[2]))
    entries, postings = [], []
    for seq, (d, _, _) in enumerate(every):
        d["id"] = entry_id(d)
        entries.append({f: d.get(f) for f in ENTRIES.names} | {"seq": seq, "links": sorted(set(d["links"])), "tags": sorted(set(d["tags"]))})
        for idx, p in enumerate(d.get("postings", [])):
            own = {"seq": seq, "idx": idx, "date": d["date"], "filename": d["filename"], "flag": d["flag"], "payee": d["payee"], "narration": d["narration"], "tags": entries[-1]["tags"], "links": entries[-1]["links"], "entry_meta": d["meta"], "id": d["id"]}
            postings.append({f: p.get(f) for f in POSTINGS.names} | own)
    return entries, postings


def build(spark: SparkSession, parsed: list[Parsed]) -> tuple[Ledger, list[tuple[str, str | None]]]:
    """The ledger of parsed files and its plugin directives. Amounts missing from postings stay null until booking."""
    entries, postings = _rows(parsed)
    options = Options()
    for k, v in (x for p in parsed for x in p.options):
        options = options.with_option(k, v)
    diag = [{"code": d["code"], "severity": d["severity"], "seq": None, "date": None, "account": None, "message": f"{d['filename']}:{d['lineno']}: {d['message']}"} for p in parsed for d in p.diagnostics]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)
    from ledgerlake.model import DIAGNOSTIC

    ledger = Ledger(spark, frame(entries, ENTRIES), frame(postings, POSTINGS), options, frame(diag, DIAGNOSTIC))
    return ledger, [x for p in parsed for x in p.plugins]


def load_text(spark: SparkSession, text: str, filename: str = "<string>") -> Ledger:
    return build(spark, [parse_text(text, filename)])[0]


def load_file(spark: SparkSession, path: str, overlay: dict[str, str] | None = None, booked: bool = True, plugins: bool = True) -> Ledger:
    """A ledger file as a booked and processed ledger: booking, plugins, pads; diagnostics gathered."""
    from ledgerlake.operators import booking, passes

    ledger, wanted = build(spark, gather(path, overlay))
    if booked and ledger.options.plugin_processing_mode != "raw":
        ledger = booking.book(ledger)
    return passes.run(ledger, wanted if plugins else [], checks=booked and ledger.options.plugin_processing_mode != "raw")


RAW = T.StructType([T.StructField("filename", T.StringType()), T.StructField("lineno", T.IntegerType()), T.StructField("date", T.DateType()), T.StructField("type", T.StringType()), T.StructField("account", T.StringType()), T.StructField("number", T.DecimalType(18, 8)), T.StructField("currency", T.StringType()), T.StructField("text", T.StringType())])


#: Rows that a reader of files hands on at a time, about.
ROWS = 20_000


def read_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of files (path, content)."""
    for pdf in batches:
        rows = []
        for name, content in zip(pdf["path"], pdf["content"], strict=True):
            for d in read_directives(bytes(content).decode("utf-8", "replace"), name, Parsed()):
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=RAW.names)
                    rows = []
                if d["type"] == "transaction":
                    rows += [(name, p["lineno"], d["date"], "transaction", p["account"], p["number"], p["currency"], d["narration"]) for p in d["postings"]]
                else:
                    a = d.get("amount") or {}
                    rows.append((name, d["lineno"], d["date"], d["type"], d.get("account"), a.get("number"), a.get("currency"), d.get("value") or d.get("comment") or d.get("name")))
        yield pd.DataFrame(rows, columns=RAW.names)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Many self-contained ledger files parsed on executors: a row per posting, and per other directive.

    ``filename, lineno, date, type, account, number, currency, text``; a file is one row of the input,
    so a task's memory holds its text, but of what is read from it only ``ROWS`` rows or so.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return files.mapInPandas(read_rows, RAW)
