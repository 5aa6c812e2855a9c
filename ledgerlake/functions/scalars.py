"""The scalar functions of the query language as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.registry import function, register
from ledgerlake.model import NUM, SUM
from ledgerlake.operators import inventory as inv

INTERVAL = "struct<years:int,months:int,days:int>"


# --- cast -----------------------------------------------------------------------------------------


def display(x: Column, kind: str) -> Column:
    """The display text of a value."""
    if kind == "bool":
        return F.when(x, "TRUE").when(~x, "FALSE")
    if kind == "decimal":
        s = x.cast("string")
        return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    if kind == "amount":
        return F.concat(display(x["number"], "decimal"), F.lit(" "), x["currency"])
    if kind == "position":
        c = x["cost"]
        lot = F.concat(F.lit(" {"), F.concat_ws(", ", F.concat(display(c["number"], "decimal"), F.lit(" "), c["currency"]), c["date"].cast("string"), F.concat(F.lit('"'), c["label"], F.lit('"'))), F.lit("}"))
        return F.concat(display(x["units"], "amount"), F.when(c.isNotNull(), lot).otherwise(""))
    if kind == "inventory":
        return F.concat(F.lit("("), F.array_join(F.transform(x, lambda p: display(p, "position")), ", "), F.lit(")"))
    if kind == "set":
        return F.array_join(x, ", ")
    if kind == "dict":
        return F.to_json(x)
    if kind == "meta":
        return F.when(x["kind"] == "number", display(x["n"], "decimal")).when(x["kind"] == "bool", display(x["b"], "bool")).when(x["kind"] == "date", x["d"].cast("string")).when(x["kind"] == "amount", F.concat(display(x["n"], "decimal"), F.lit(" "), x["currency"])).otherwise(x["s"])
    return x.cast("string")


for _k in ("bool", "int", "decimal", "string", "date", "amount", "position", "inventory", "set", "dict", "meta"):
    register("str", _k, "string", lambda x, k=_k: display(x, k))
    register("repr", _k, "string", lambda x, k=_k: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"')) if k == "string" else display(x, k))
register("str", "null", "string", lambda x: F.lit(None).cast("string"))

register("bool", "bool", "bool", lambda x: x)
register("bool", "int", "bool", lambda x: x != 0)
register("bool", "decimal", "bool", lambda x: x != 0)
register("bool", "string", "bool", lambda x: x != "")
register("bool", "any", "bool", lambda x: F.when(x.isNotNull(), F.lit(True)))
register("bool", "meta", "bool", lambda x: F.when(x["kind"] == "bool", x["b"]).when(x["kind"] == "number", x["n"] != 0).when(x.isNotNull(), F.coalesce(x["s"], F.lit("x")) != ""))

register("int", "int", "int", lambda x: x)
register("int", "bool", "int", lambda x: x.cast("bigint"))
register("int", "decimal", "int", lambda x: x.cast("bigint"))
register("int", "string", "int", lambda x: F.when(F.trim(x).rlike(r"^[-+]?\d+$"), F.trim(x).try_cast("bigint")))
register("int", "meta", "int", lambda x: F.coalesce(x["n"].cast("bigint"), F.when(x["s"].rlike(r"^[-+]?\d+$"), x["s"].try_cast("bigint"))))
register("int", "any", "int", lambda x: F.lit(None).cast("bigint"))
register("decimal", "decimal", "decimal", lambda x: x)
register("decimal", "int", "decimal", lambda x: x.cast(NUM))
register("decimal", "bool", "decimal", lambda x: x.cast("int").cast(NUM))
register("decimal", "string", "decimal", lambda x: F.trim(x).try_cast(NUM))
register("decimal", "meta", "decimal", lambda x: F.coalesce(x["n"], x["s"].try_cast(NUM)))
register("decimal", "any", "decimal", lambda x: F.lit(None).cast(NUM))
_iso = lambda s: F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
register("date", "date", "date", lambda x: x)
register("date", "string", "date", _iso)
register("date", "meta", "date", lambda x: F.coalesce(x["d"], _iso(x["s"])))
register("date", "any", "date", lambda x: F.lit(None).cast("date"))
register("date", "int int int", "date", lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))

# --- date -----------------------------------------------------------------------------------------

register("year", "date", "int", lambda d: F.year(d).cast("bigint"))
register("month", "date", "int", lambda d: F.month(d).cast("bigint"))
register("day", "date", "int", lambda d: F.day(d).cast("bigint"))
register("weekday", "date", "string", lambda d: F.date_format(d, "E"))
register("weekday_name", "date", "string", lambda d: F.date_format(d, "EEEE"))
register("quarter", "date", "string", lambda d: F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string")))
register("quarter_index", "date", "int", lambda d: F.quarter(d).cast("bigint"))
register("yearmonth", "date", "date", lambda d: F.trunc(d, "MM"))
register("yearmonth_str", "date", "string", lambda d: F.date_format(d, "yyyy-MM"))
register("today", "", "date", lambda ctx: F.lit(ctx.today), context=True)
register("date_add", "date int", "date", lambda d, n: F.date_add(d, n.cast("int")))
register("date_diff", "date date", "int", lambda a, b: F.datediff(a, b).cast("bigint"))

#: strptime directives and their patterns in Spark; fixed values.
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%H": "HH", "%M": "mm", "%S": "ss", "%%": "%"}


def strptime(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if fmt[i] == "%":
            if two not in STRPTIME:
                raise ValueError(f"unsupported {two!r} in a date format")
            out += STRPTIME[two]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


@function("string", "date")
def parse_date(s):
    """Three layouts; anything else is an error when it runs."""
    got = F.coalesce(*[F.when(s.rlike(p), F.try_to_date(s, f)) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{8}$", "yyyyMMdd"))])
    return F.when(s.isNotNull(), F.coalesce(got, F.raise_error(F.concat(F.lit("not a date: "), s)).cast("date")))


register("parse_date", "string string", "date", lambda ctx, s, f: F.to_date(s, strptime(ctx.constant(f))), context=True)


@function("string date", "date")
def date_trunc(unit, d):
    u, y = F.lower(unit), F.year(d)
    start = lambda n: F.make_date(n, F.lit(1), F.lit(1))
    return (
        F.when(u == "week", F.trunc(d, "week"))
        .when(u == "month", F.trunc(d, "month"))
        .when(u == "quarter", F.trunc(d, "quarter"))
        .when(u == "year", F.trunc(d, "year"))
        .when(u == "decade", start(y - y % 10))
        .when(u == "century", start(y - (y - 1) % 100))
        .when(u == "millennium", start(y - (y - 1) % 1000))
    )


@function("string date", "int")
def date_part(unit, d):
    u, y = F.lower(unit), F.year(d)
    parts = {
        ("weekday", "dow"): F.weekday(d),
        ("isoweekday", "isodow"): F.weekday(d) + 1,
        ("week",): F.weekofyear(d),
        ("month",): F.month(d),
        ("quarter",): F.quarter(d),
        ("year",): y,
        ("isoyear",): F.extract(F.lit("YEAROFWEEK"), d),
        ("decade",): F.floor(y / 10),
        ("century",): F.floor((y + 99) / 100),
        ("millennium",): F.floor((y + 999) / 1000),
        ("epoch",): F.unix_date(d).cast("bigint") * 86400,
    }
    out = F.lit(None).cast("bigint")
    for words, v in parts.items():
        out = F.when(u.isin(*words), v.cast("bigint")).otherwise(out)
    return out


@function("string", "interval")
def interval(s):
    p = r"^([-+]?\d+)\s+(day|month|year)s?$"
    n, unit = F.regexp_extract(s, p, 1).try_cast("int"), F.regexp_extract(s, p, 2)
    part = lambda u: F.when(unit == u, n).otherwise(0)
    return F.when(s.rlike(p), F.struct(part("year").alias("years"), part("month").alias("months"), part("day").alias("days")))


def _steps(origin: Column, n: Column, months: Column) -> Column:
    """``n`` strides of ``months`` from the origin, month lengths clamping as they are passed."""
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), origin, lambda d, _: F.add_months(d, months))
    # no month is shorter than 28 days, so earlier days never clamp
    return F.when(n <= 0, origin).when(F.day(origin) <= 28, F.add_months(origin, (n * months).cast("int"))).otherwise(walked)


def date_bin(stride, source, origin):
    """Calendar bins. A month or year boundary other than the origin belongs to the bin before it, and
    month lengths clamp cumulatively; a day boundary starts its own bin. A stride that is not positive: NULL."""
    days = F.floor(F.datediff(source, origin) / stride["days"]) * stride["days"]
    by_day = F.date_add(origin, days.cast("int"))
    months = (stride["years"] * 12 + stride["months"]).cast("int")
    gap = (F.year(source) - F.year(origin)) * 12 + F.month(source) - F.month(origin)
    after = F.floor(gap / months).cast("int")
    at = _steps(origin, after, months)
    forward = F.when((at >= source) & (after > 0), _steps(origin, after - 1, months)).otherwise(at)
    back = F.ceil(-gap / months).cast("int")
    near = _steps(origin, back, -months)
    below = F.when(near > source, _steps(origin, back + 1, -months)).otherwise(near)
    backward = F.when(F.add_months(below, months) < source, F.add_months(below, months)).otherwise(below)
    by_month = F.when(source >= origin, forward).otherwise(backward)
    return F.when((months > 0) & (stride["days"] == 0), by_month).when((stride["days"] > 0) & (months == 0), by_day)


register("date_bin", "interval date date", "date", date_bin)
register("date_bin", "string date date", "date", lambda s, a, b: date_bin(interval(s), a, b))

# --- string ---------------------------------------------------------------------------------------

register("upper", "string", "string", F.upper)
register("lower", "string", "string", F.lower)
register("length", "string", "int", lambda s: F.char_length(s).cast("bigint"))
register("length", "set", "int", lambda s: F.size(s).cast("bigint"))


@function("string int int", "string")
def substr(s, start, n):
    """0-based, clamped at both ends."""
    begin = F.greatest(start, F.lit(0))
    return F.substring(s, (begin + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))


register("grep", "string string", "string", lambda p, s: F.when(F.regexp_like(s, p), F.coalesce(F.regexp_substr(s, p), F.lit(""))))
register("grepn", "string string int", "string", lambda ctx, p, s, n: _group(ctx, p, s, n), context=True)


def _group(ctx, p, s, n):
    groups = re.compile(ctx.constant(p)).groups
    k = ctx.constant(n)
    if not 0 <= k <= groups:
        return F.lit(None).cast("string")
    return F.when(F.regexp_like(s, p), F.regexp_extract(s, ctx.constant(p), k))


register("subst", "string string string", "string", lambda p, r, s: F.regexp_replace(s, p, r))
register("findfirst", "string set", "string", lambda p, s: F.get(F.filter(F.array_sort(s), lambda x: F.regexp_like(x, F.concat(F.lit("^(?:"), p, F.lit(")")))), 0))
register("joinstr", "set", "string", lambda s: F.array_join(F.array_sort(s), ","))


@function("string int", "string")
def maxwidth(s, n):
    """White space collapsed; if too long, whole words that leave room for ``[...]``, then that."""
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    words = F.split(flat, " ")
    room = n - 6
    kept = F.aggregate(words, F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), lambda a, w: _word(a, w, room))["t"]
    return F.when(F.char_length(flat) <= n, flat).otherwise(F.when(kept == "", F.lit("[...]")).otherwise(F.concat(kept, F.lit(" [...]"))))


def _word(a, w, room):
    longer = F.when(a["t"] == "", w).otherwise(F.concat(a["t"], F.lit(" "), w))
    fits = ~a["full"] & (F.char_length(longer) <= room)
    return F.struct(F.when(fits, longer).otherwise(a["t"]).alias("t"), (~fits).alias("full"))


@function("string string int", "string")
def splitcomp(s, delim, i):
    """0-based component, negative from the end; NULL out of range."""
    parts = F.split(s, F.concat(F.lit(r"\Q"), delim, F.lit(r"\E")), F.lit(-1))
    at = F.when(i < 0, F.size(parts) + i).otherwise(i).cast("int")
    return F.get(parts, F.when(at < 0, F.lit(1 << 30)).otherwise(at))


# --- account --------------------------------------------------------------------------------------

register("root", "string", "string", lambda a: F.substring_index(a, ":", 1))
register("root", "string int", "string", lambda a, n: F.array_join(F.slice(F.split(a, ":"), F.lit(1), F.greatest(n, F.lit(0)).cast("int")), ":"))
register("parent", "string", "string", lambda a: F.regexp_replace(a, r":?[^:]*$", ""))
register("leaf", "string", "string", lambda a: F.nullif(F.substring_index(a, ":", -1), F.lit("")))


def _in_context(name, ins, out, build):
    register(name, ins, out, build, context=True)


_in_context("open_date", "string", "date", lambda ctx, a: ctx.dimension("opens", a, "open_date"))
_in_context("close_date", "string", "date", lambda ctx, a: ctx.dimension("closes", a, "close_date"))
_in_context("open_meta", "string", "dict", lambda ctx, a: ctx.dimension("opens", a, "open_meta"))
_in_context("open_meta", "string string", "meta", lambda ctx, a, k: F.try_element_at(ctx.dimension("opens", a, "open_meta"), k))
for _n in ("currency_meta", "commodity_meta"):
    _in_context(_n, "string", "dict", lambda ctx, c: ctx.dimension("commodities", c, "commodity_meta"))
    _in_context(_n, "string string", "meta", lambda ctx, c, k: F.try_element_at(ctx.dimension("commodities", c, "commodity_meta"), k))
_in_context("has_account", "string", "bool", lambda ctx, a: F.coalesce(ctx.dimension("known_accounts", a, "known"), F.lit(False)))


@function("string", "string", context=True)
def account_sortkey(ctx, a):
    root, out = F.substring_index(a, ":", 1), F.lit("5")
    for k, name in enumerate(ctx.options.roots):
        out = F.when(root == name, str(k)).otherwise(out)
    return F.concat(out, F.lit(":"), a)


def _signed(ctx, x, a):
    o = ctx.options
    return F.when(F.substring_index(a, ":", 1).isin(o.name_liabilities, o.name_equity, o.name_income), -x).when(a.isNotNull(), x)


register("possign", "decimal string", "decimal", lambda ctx, x, a: _signed(ctx, x, a), context=True)
register("possign", "amount string", "amount", lambda ctx, x, a: inv.amount(_signed(ctx, x["number"], a), x["currency"]), context=True)
register("possign", "position string", "position", lambda ctx, x, a: inv.position(_signed(ctx, x["units"]["number"], a), x["units"]["currency"], x["cost"]), context=True)
register("possign", "inventory string", "inventory", lambda ctx, x, a: inv.map_units(x, lambda n: _signed(ctx, n, a)), context=True)

# --- values and inventories -----------------------------------------------------------------------

register("number", "amount", "decimal", lambda x: x["number"])
register("number", "position", "decimal", lambda x: x["units"]["number"])
register("currency", "amount", "string", lambda x: x["currency"])
register("currency", "position", "string", lambda x: x["units"]["currency"])
register("commodity", "amount", "string", lambda x: x["currency"])
register("units", "position", "amount", lambda x: x["units"])
register("units", "inventory", "inventory", lambda x: inv.regroup(F.transform(x, lambda p: inv.bare(p["units"]))))
register("cost", "position", "amount", inv.cost_of)
register("cost", "inventory", "inventory", lambda x: inv.regroup(F.transform(x, lambda p: inv.bare(F.coalesce(inv.cost_of(p), p["units"])))))
register("only", "string inventory", "amount", inv.only)
register("empty", "inventory", "bool", lambda x: F.size(x) == 0)
register("filter_currency", "position string", "position", lambda x, c: F.when(x["units"]["currency"] == c, x))
register("filter_currency", "inventory string", "inventory", lambda x, c: F.filter(x, lambda p: p["units"]["currency"] == c))
register("abs", "decimal", "decimal", F.abs)
register("abs", "position", "position", lambda x: inv.position(F.abs(x["units"]["number"]), x["units"]["currency"], x["cost"]))
register("abs", "inventory", "inventory", lambda x: inv.map_units(x, F.abs))
register("neg", "decimal", "decimal", lambda x: -x)
register("neg", "amount", "amount", lambda x: inv.amount(-x["number"], x["currency"]))
register("neg", "position", "position", lambda x: inv.position(-x["units"]["number"], x["units"]["currency"], x["cost"]))
register("neg", "inventory", "inventory", lambda x: inv.map_units(x, lambda n: -n))
register("safediv", "decimal decimal", "decimal", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(a.try_cast(NUM), b.try_cast(NUM)), F.try_divide(a.cast(SUM), b.cast(SUM)), F.lit(0)).cast(SUM)))
register("round", "decimal", "decimal", lambda x: F.bround(x, 0).cast(SUM))
register("round", "decimal int", "decimal", lambda ctx, x, n: F.bround(x, int(ctx.constant(n))).cast(SUM), context=True)


def _convert(ctx, number, base, quote, date, keep):
    """number x rate as an amount; without a rate: NULL, or the amount itself if ``keep``."""
    rate = ctx.rate(base, quote, date)
    there = inv.amount(inv.times(number, rate), F.upper(quote))
    return F.coalesce(there, inv.amount(number, base)) if keep else there


for _ins in ("string string", "string string date"):
    register("getprice", _ins, "decimal", lambda ctx, b, q, d=None: ctx.rate(b, q, d), context=True)
for _tail in ("", " date"):
    register("convert", f"amount string{_tail}", "amount", lambda ctx, x, q, d=None: _convert(ctx, x["number"], x["currency"], q, d, False), context=True)
    register("convert", f"position string{_tail}", "amount", lambda ctx, x, q, d=None: _convert(ctx, x["units"]["number"], x["units"]["currency"], q, d, False), context=True)
    register("value", f"position{_tail}", "amount", lambda ctx, x, d=None: F.when(x["cost"].isNotNull(), _convert(ctx, x["units"]["number"], x["units"]["currency"], x["cost"]["currency"], d, False)).otherwise(x["units"]), context=True)



def convert_each(ctx, x, quote, date):
    """A position converted, or as it is where there is no rate: what convert and value do inside an inventory."""
    there = _convert(ctx, x["units"]["number"], x["units"]["currency"], quote, date, False)
    return F.coalesce(inv.bare(there), x)


# --- dict and generic -----------------------------------------------------------------------------

register("getitem", "dict string", "meta", lambda d, k: F.try_element_at(d, k))
register("getitem", "dict string string", "meta", lambda d, k, v: F.coalesce(F.try_element_at(d, k), F.struct(F.lit("string").alias("kind"), v.alias("s"), F.lit(None).cast(NUM).alias("n"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("currency"))))
for _t in ("bool", "int", "decimal", "string", "date", "amount", "set", "dict"):
    for _k in range(1, 6):
        register("coalesce", (_t,) * _k, _t, lambda *x: F.coalesce(*x))
