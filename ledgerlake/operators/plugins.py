"""Ledger plugins as relational passes: ``(ledger, config) -> (ledger, diagnostics or None)``."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.model import ENTRIES, META, NUM, Ledger, conform
from ledgerlake.operators import validate
from ledgerlake.operators.hierarchy import nearest, with_ancestors
from ledgerlake.operators.validate import diagnostics, references
from ledgerlake.plans.tables import per_unit, weight

Result = tuple[Ledger, DataFrame | None]
PLUGINS: dict[str, Callable[[Ledger, str | None], Result]] = {}


def plugin(*names: str):
    def add(f):
        for n in names:
            PLUGINS[n] = f
        return f

    return add


def changed(ledger: Ledger, entries: DataFrame | None = None, postings: DataFrame | None = None) -> Ledger:
    return Ledger(ledger.spark, entries if entries is not None else ledger.entries, postings if postings is not None else ledger.postings, ledger.options, ledger.diagnostics)


def added(ledger: Ledger, df: DataFrame, kind: str, after: Column | None = None) -> Ledger:
    """The ledger with new entries of one kind; ``after``: the seq they follow (text order is restored by ``resequence``)."""
    df = df.withColumns({"type": F.lit(kind), "id": F.md5(F.concat_ws("|", F.lit(kind), F.col("date").cast("string"), *[F.col(c) for c in ("account", "name") if c in df.columns]))})
    if "seq" not in df.columns:
        df = df.withColumn("seq", after if after is not None else F.lit(None).cast("long"))
    return changed(ledger, ledger.entries.unionByName(conform(df, ENTRIES)))


def resequence(ledger: Ledger) -> Ledger:
    """Canonical order anew after synthetic entries: (date, kind, old order). Ranks come from a range sort
    and per-range counts, not from one window over everything."""
    from ledgerlake.model import kind_order

    e = ledger.entries.withColumn("_kind", kind_order(F.col("type")))
    day = F.coalesce(F.unix_date("date"), F.lit(-(1 << 20))).cast("long")
    w = Window.partitionBy("date").orderBy("_kind", F.col("seq").asc_nulls_last(), "account", "id")
    ranked = e.withColumn("_rank", F.row_number().over(w))
    new = (day + (1 << 21)) * (1 << 40) + F.col("_rank")
    ranked = ranked.withColumn("_new", new)
    moved = ranked.where("seq is not null").select(F.col("seq"), "_new")
    postings = ledger.postings.join(moved, "seq").withColumn("seq", F.col("_new")).drop("_new")
    return changed(ledger, conform(ranked.withColumn("seq", F.col("_new")), ENTRIES), conform(postings, ledger.postings.schema))


def _roots(ledger: Ledger) -> tuple[str, str, str]:
    return ("Assets", "Liabilities", "Equity")


@plugin("auto_accounts", "autoaccounts")
def autoaccounts(ledger: Ledger, config: str | None = None) -> Result:
    """An Open on the first use of every account that has none."""
    new = references(ledger).groupBy("account").agg(F.min("date").alias("date")).join(ledger.of("open").select("account"), "account", "left_anti")
    return added(ledger, new, "open"), None


def _flag(meta: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(meta), F.lit(key))["b"], F.lit(False))


@plugin("check_closing", "checkclosing")
def checkclosing(ledger: Ledger, config: str | None = None) -> Result:
    """Postings with ``closing: TRUE`` get a zero balance the day after; the key goes."""
    hit = ledger.postings.where(_flag("meta", "closing"))
    zero = hit.select(F.date_add("date", 1).alias("date"), "account", F.struct(F.lit(0).cast(NUM).alias("number"), F.col("currency")).alias("amount"), F.lit(0).alias("scale"))
    stripped = ledger.postings.withColumn("meta", F.map_filter("meta", lambda k, v: k != "closing"))
    return changed(added(ledger, zero, "balance"), None, stripped), None


@plugin("check_commodity", "checkcommodity")
def checkcommodity(ledger: Ledger, config: str | None = None) -> Result:
    """Currencies in use without a Commodity; an account's use is named before a price's."""
    p = ledger.postings
    used = p.select(F.col("currency"), "account").unionByName(p.select(F.col("cost.currency").alias("currency"), "account")).unionByName(p.select(F.col("price.currency").alias("currency"), "account"))
    used = used.unionByName(ledger.of("balance").select(F.col("amount.currency").alias("currency"), "account"))
    priced = ledger.prices.select(F.explode(F.array("base", "quote")).alias("currency"), F.lit(None).cast("string").alias("account"))
    every = used.unionByName(priced).where("currency is not null").groupBy("currency").agg(F.min("account").alias("account"))
    bad = every.join(ledger.of("commodity").select(F.col("name").alias("currency")), "currency", "left_anti")
    return ledger, diagnostics(bad, "missing-commodity", F.concat(F.lit("no commodity "), F.col("currency")))


@plugin("check_drained", "checkdrained")
def checkdrained(ledger: Ledger, config: str | None = None) -> Result:
    """A closed balance-sheet account gets a zero balance the day after, for every currency it ever held."""
    closes = ledger.of("close").where(F.substring_index("account", ":", 1).isin(*_roots(ledger))).select("account", F.date_add("date", 1).alias("date"))
    held = ledger.postings.where("currency is not null").select("account", "currency").unionByName(ledger.of("open").select("account", F.explode("currencies").alias("currency"))).distinct()
    there = ledger.of("balance").select("account", "date", F.col("amount.currency").alias("currency"))
    new = closes.join(held, "account").join(there, ["account", "date", "currency"], "left_anti")
    return added(ledger, new.withColumns({"amount": F.struct(F.lit(0).cast(NUM).alias("number"), F.col("currency")), "scale": F.lit(0)}), "balance"), None


@plugin("close_tree", "closetree")
def closetree(ledger: Ledger, config: str | None = None) -> Result:
    """Closing an account closes the open accounts below it."""
    opens = with_ancestors(ledger.of("open").select("account", F.col("seq").alias("o"), F.col("date").alias("od")), itself=False)
    closes = ledger.of("close").select(F.col("account").alias("ancestor"), "seq", "date")
    new = opens.join(closes, "ancestor").where("o < seq and od <= date").groupBy("account").agg(F.min("date").alias("date"))
    return added(ledger, new.join(ledger.of("close").select("account"), "account", "left_anti"), "close"), None


@plugin("coherent_cost", "coherentcost")
def coherentcost(ledger: Ledger, config: str | None = None) -> Result:
    """Currencies of an account held both with and without cost."""
    p = ledger.postings.where("number is not null").groupBy("account", "currency").agg(F.bool_or(F.col("cost").isNull()).alias("a"), F.bool_or(F.col("cost").isNotNull()).alias("b")).where("a and b")
    return ledger, diagnostics(p, "incoherent-cost", F.concat(F.col("currency"), F.lit(" with and without cost in "), F.col("account")))


@plugin("exclude_tag", "excludetag")
def excludetag(ledger: Ledger, config: str | None = None) -> Result:
    """Transactions with the tag (``virtual`` by default) go."""
    has = F.coalesce(F.array_contains("tags", (config or "virtual").lstrip("#")), F.lit(False))
    return changed(ledger, ledger.entries.where(~((F.col("type") == "transaction") & has)), ledger.postings.where(~has)), None


def implied_prices(postings: DataFrame) -> DataFrame:
    """date, base, quote, rate that postings imply: the price, else the cost per unit; one of equal ones."""
    price = per_unit()
    cost = F.struct(F.col("cost.number").alias("number"), F.col("cost.currency").alias("currency"))
    got = F.when(F.col("price.number").isNotNull(), price).when(F.col("cost.number").isNotNull(), cost)
    rows = postings.withColumn("_p", got).where("_p.number is not null and currency is not null")
    return rows.groupBy("date", F.col("currency").alias("base"), F.col("_p.currency").alias("quote"), F.col("_p.number").alias("rate")).agg(F.min("seq").alias("seq"))


@plugin("implicit_prices", "implicitprices")
def implicitprices(ledger: Ledger, config: str | None = None) -> Result:
    new = implied_prices(ledger.postings).select("date", F.col("base").alias("name"), F.struct(F.col("rate").cast(NUM).alias("number"), F.col("quote").alias("currency")).alias("amount"), "seq")
    return added(ledger, new, "price"), None


def _parents(ledger: Ledger) -> DataFrame:
    every = references(ledger).select("account").distinct()
    return with_ancestors(every, itself=False).select(F.col("ancestor").alias("account")).distinct()


@plugin("leafonly")
def leafonly(ledger: Ledger, config: str | None = None, pads: bool = False) -> Result:
    """Postings on accounts that have accounts below them."""
    use = ledger.postings.select("seq", "date", "account")
    if pads:
        pad = ledger.of("pad")
        use = use.unionByName(pad.select("seq", "date", "account")).unionByName(pad.select("seq", "date", F.col("pad_account").alias("account")))
    return ledger, diagnostics(use.join(_parents(ledger), "account", "left_semi"), "not-a-leaf", F.concat("account", F.lit(" has accounts below it")))


PLUGINS["leafonly_pads"] = lambda ledger, config=None: leafonly(ledger, config, True)


@plugin("noduplicates")
def noduplicates(ledger: Ledger, config: str | None = None) -> Result:
    """Transactions after the first with the same date and the same postings (account, number, currency)."""
    key = F.array_sort(F.collect_list(F.struct("account", F.coalesce(F.col("number").cast("string"), F.lit("?")).alias("n"), F.coalesce("currency", F.lit("?")).alias("c"))))
    t = ledger.postings.groupBy("seq", "date").agg(F.xxhash64(key).alias("h"), F.md5(F.to_json(key)).alias("k"))
    w = Window.partitionBy("date", "h", "k").orderBy("seq")
    return ledger, diagnostics(t.withColumn("_n", F.row_number().over(w)).where("_n > 1"), "duplicate-transaction", F.lit("repeats an earlier transaction of the day"))


@plugin("nounused")
def nounused(ledger: Ledger, config: str | None = None) -> Result:
    """Opened accounts that nothing else refers to."""
    used = references(ledger).where("type <> 'open'").select("account").distinct()
    return ledger, diagnostics(ledger.of("open").join(used, "account", "left_anti"), "unused-account", F.concat("account", F.lit(" is never used")))


@plugin("onecommodity")
def onecommodity(ledger: Ledger, config: str | None = None) -> Result:
    """Accounts with more than one currency of units, or of cost."""
    p = ledger.postings.where("currency is not null")
    if config:
        p = p.where(F.col("account").rlike(f"^(?:{config})"))
    out = ledger.opens.where(~F.coalesce(F.try_element_at("open_meta", F.lit("onecommodity"))["b"], F.lit(True)) | (F.size("open_currencies") > 1)).select("account")
    n = p.join(out, "account", "left_anti").groupBy("account").agg(F.count_distinct("currency").alias("u"), F.count_distinct("cost.currency").alias("c")).where("u > 1 or c > 1")
    return ledger, diagnostics(n, "many-commodities", F.concat("account", F.lit(" holds more than one commodity")))


@plugin("sellgains")
def sellgains(ledger: Ledger, config: str | None = None) -> Result:
    """Where all postings at cost have a price: proceeds at those prices against the other balance-sheet and expense legs."""
    n, c = weight()
    price = F.when(F.col("price.is_total"), F.signum("number").cast("decimal(2,0)") * F.abs("price.number")).otherwise((F.col("number") * F.col("price.number")).cast(NUM)).cast(NUM)
    at_cost = F.col("cost").isNotNull()
    root = F.substring_index("account", ":", 1)
    sums = ledger.postings.where("number is not null").withColumns({"_lot": at_cost, "_ok": ~at_cost | F.col("price.number").isNotNull()})
    whole = sums.groupBy("seq").agg(F.bool_and("_ok").alias("ok"), F.bool_or("_lot").alias("any")).where("ok and any")
    kept = sums.join(whole, "seq", "left_semi")
    cur = F.when(F.col("_lot"), F.col("price.currency")).otherwise(c)
    proceeds = F.coalesce(F.sum(F.when(F.col("_lot"), -price)), F.lit(0))
    other = F.coalesce(F.sum(F.when(~F.col("_lot") & root.isin("Assets", "Liabilities", "Equity", "Expenses"), n)), F.lit(0))
    t = kept.groupBy("seq", "date", cur.alias("currency")).agg(proceeds.alias("proceeds"), other.alias("other"), F.max(validate.tolerance_of(F.col("scale"), ledger.options)).alias("tol"))
    bad = t.where(F.abs(F.col("proceeds") - F.col("other")) > F.coalesce("tol", F.lit("0.005").cast("decimal(28,10)")) * 2)
    return ledger, diagnostics(bad, "sell-gains", F.concat(F.lit("proceeds "), F.col("proceeds").cast("string"), F.lit(" against "), F.col("other").cast("string")))


@plugin("uniqueprices", "unique_prices")
def uniqueprices(ledger: Ledger, config: str | None = None) -> Result:
    """Prices that differ from the first of their day and pair."""
    first = ledger.prices.groupBy("date", "base", "quote").agg(F.min_by("rate", "seq").alias("first"))
    bad = ledger.prices.join(first, ["date", "base", "quote"]).where("rate <> first")
    return ledger, diagnostics(bad, "price-conflict", F.concat(F.lit("another price of "), F.col("base")))


@plugin("check_metadata", "checkmetadata")
def checkmetadata(ledger: Ledger, config: str | None = None) -> Result:
    """Keys ``account:key,...;commodity:key,...`` that leaf accounts or commodities lack."""
    out = None
    for part in filter(None, (config or "").split(";")):
        kind, _, keys = part.partition(":")
        for key in filter(None, map(str.strip, keys.split(","))):
            rows = ledger.of("open").join(_parents(ledger), "account", "left_anti") if kind.strip() == "account" else ledger.of("commodity")
            bad = diagnostics(rows.where(~F.coalesce(F.map_contains_key("meta", key), F.lit(False))), "missing-metadata", F.lit(f"no {key}"))
            out = bad if out is None else out.unionByName(bad)
    return ledger, out


@plugin("commodity_pattern", "commoditypattern")
def commoditypattern(ledger: Ledger, config: str | None = None) -> Result:
    """Postings whose currency doesn't match the whole pattern of their account's Open (key ``commodity_pattern``)."""
    rx = ledger.opens.select("account", F.try_element_at("open_meta", F.lit(config or "commodity_pattern"))["s"].alias("_rx")).where("_rx is not null")
    bad = ledger.postings.join(rx, "account").where(~F.regexp_like("currency", F.concat(F.lit("^(?:"), F.col("_rx"), F.lit(")$"))))
    return ledger, diagnostics(bad, "commodity-pattern", F.concat(F.col("currency"), F.lit(" doesn't match "), F.col("_rx")))


@plugin("comprehensive_balance", "comprehensivebalance")
def comprehensivebalance(ledger: Ledger, config: str | None = None) -> Result:
    """Custom ``comprehensive-balance`` entries become a balance per currency ever seen; unlisted ones must be 0."""
    c = ledger.of("custom").where("name = 'comprehensive-balance'").withColumn("_v", F.split("value", "\x1f"))
    own = c.select("seq", "date", F.get("_v", 0).alias("account"), F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0))).alias("_l"))
    listed = own.select("seq", "date", "account", F.explode("_l").alias("_x")).select("seq", "date", "account", F.substring_index("_x", " ", 1).try_cast(NUM).alias("number"), F.element_at(F.split("_x", " "), -1).alias("currency"))
    before = ledger.postings.where("currency is not null").select("account", "currency", F.col("date").alias("d")).unionByName(ledger.of("balance").select("account", F.col("amount.currency").alias("currency"), F.col("date").alias("d")))
    first = before.groupBy("account", "currency").agg(F.min("d").alias("d"))
    seen = own.select("seq", "date", "account").join(first, "account").where("d < date").select("seq", "date", "account", "currency")
    every = seen.unionByName(listed.select("seq", "date", "account", "currency")).distinct().join(listed.select("seq", "currency", "number"), ["seq", "currency"], "left")
    new = every.withColumns({"amount": F.struct(F.coalesce("number", F.lit(0).cast(NUM)).alias("number"), F.col("currency")), "scale": F.lit(0)}).select("seq", "date", "account", "amount", "scale")
    rest = changed(ledger, ledger.entries.join(c.select("seq"), "seq", "left_anti"))
    return added(rest, new, "balance"), None


@plugin("fiscal_income_expense", "fiscalincomeexpense")
def fiscalincomeexpense(ledger: Ledger, config: str | None = None) -> Result:
    """Custom ``fiscal`` entries (account, begin, end, number, currency[, tolerance]): the subtree's sum in [begin, end]."""
    v = F.split("value", "\x1f")
    c = ledger.of("custom").where("name = 'fiscal'").select("seq", "date", F.get(v, 0).alias("ancestor"), F.get(v, 1).try_cast("date").alias("begin"), F.get(v, 2).try_cast("date").alias("end"), F.get(v, 3).try_cast(NUM).alias("expected"), F.get(v, 4).alias("currency"), F.coalesce(F.get(v, 5).try_cast(NUM), F.lit("0.005").cast(NUM)).alias("tol"))
    sums = with_ancestors(ledger.postings.where("number is not null").select("account", "number", "currency", F.col("date").alias("d"))).join(c.withColumnRenamed("date", "on"), ["ancestor", "currency"]).where("d between begin and end").groupBy("seq").agg(F.sum("number").alias("actual"))
    got = c.join(sums, "seq", "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(F.abs(F.col("actual") - F.col("expected")) > F.col("tol"))
    return ledger, diagnostics(got.withColumn("account", F.col("ancestor")), "fiscal-mismatch", F.concat(F.lit("expected "), F.col("expected").cast("string"), F.lit(", is "), F.col("actual").cast("string")))


@plugin("infer_metadata", "infermetadata")
def infermetadata(ledger: Ledger, config: str | None = None) -> Result:
    """Rules ``type target source`` a line; sources: a meta key, ``__commodity__``, ``__account__`` (leaf). Nothing is overwritten."""
    e = ledger.entries
    for line in filter(None, map(str.strip, (config or "").splitlines())):
        kind, target, source = line.split()[:3]
        text = lambda c: F.struct(F.lit("string").alias("kind"), c.alias("s"), F.lit(None).cast(NUM).alias("n"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("currency"))
        value = {"__commodity__": F.when(F.col("name").isNotNull(), text(F.col("name"))), "__account__": F.when(F.col("account").isNotNull(), text(F.substring_index("account", ":", -1)))}.get(source)
        value = F.try_element_at("meta", F.lit(source)) if value is None else value
        meta = F.coalesce("meta", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{META.valueType.simpleString()}>")))
        fill = (F.col("type") == kind) & ~F.map_contains_key(meta, target) & value.isNotNull()
        e = e.withColumn("meta", F.when(fill, F.map_concat(meta, F.create_map(F.lit(target), value))).otherwise(F.col("meta")))
    return changed(ledger, e), None


@plugin("inherit_metadata", "inheritmetadata")
def inheritmetadata(ledger: Ledger, config: str | None = None) -> Result:
    """Keys (comma-separated) that an Open lacks come from the nearest account above that has them."""
    e = ledger.entries
    for key in filter(None, map(str.strip, (config or "").split(","))):
        values = ledger.of("open").select("account", F.try_element_at("meta", F.lit(key)).alias("_v"))
        opens = nearest(ledger.of("open").select("account"), values, "_v").where("_v is not null").dropDuplicates(["account"])
        meta = F.coalesce("meta", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{META.valueType.simpleString()}>")))
        fill = (F.col("type") == "open") & F.col("_v").isNotNull() & ~F.map_contains_key(meta, key)
        e = e.join(opens, "account", "left").withColumn("meta", F.when(fill, F.map_concat(meta, F.create_map(F.lit(key), F.col("_v")))).otherwise(F.col("meta"))).drop("_v")
        e = conform(e, ENTRIES)
    return changed(ledger, e), None


def best_rates(edges: pd.DataFrame, targets: tuple[str, ...], base: float = 1.0, scale: float = 1.0) -> list[tuple[str, str, float, bool]]:
    """(currency, operating currency, rate, fresh) by shortest paths over one day's latest prices.

    edges: base, quote, rate, days. Ties: fewest hops, then names.
    """
    import heapq

    graph: dict[str, list] = {}
    for b, q, r, days in edges[["base", "quote", "rate", "days"]].itertuples(index=False):
        if b == q or not r:
            continue
        cost = 1.0 if days == 0 else base + scale * math.log(max(1, days))
        graph.setdefault(b, []).append((q, cost, float(r), days == 0))
        graph.setdefault(q, []).append((b, cost, 1 / float(r), days == 0))
    out = []
    for target in targets:
        heap, done = [(0.0, 0, (target,), 1.0, False)], {}
        while heap:
            dist, hops, path, rate, fresh = heapq.heappop(heap)
            at = path[-1]
            if at in done:
                continue
            done[at] = (rate, fresh)
            for nxt, cost, r, new in graph.get(at, []):
                if nxt not in done:
                    heapq.heappush(heap, (dist + cost, hops + 1, (*path, nxt), rate * r, fresh or new))
        out += [(c, target, 1 / r, f) for c, (r, f) in sorted(done.items()) if c != target and r]
    return out


def completed_prices(prices: DataFrame, targets: tuple[str, ...], base: float = 1.0, scale: float = 1.0) -> DataFrame:
    """date, base, quote, rate: prices in the operating currencies along each day's shortest paths with a fresh edge.

    A currency with one pair (a leaf; no target) lies on no other's path: its own is that of its neighbour and one
    edge. So only the pairs among the others, the core, are carried to every later day and solved as graphs, a day
    each; leaves are joined to the core's paths on days with a fresh price of theirs or a fresh path of the neighbour.
    """
    from ledgerlake.operators.prices import asof, daily

    d = daily(prices)
    pairs = d.where("base <> quote").select("base", "quote").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("base").alias("c"), F.col("quote").alias("via")), F.struct(F.col("quote").alias("c"), F.col("base").alias("via")))).alias("e"), "base", "quote")
    leaves = ends.where(~F.col("e.c").isin(*targets)).groupBy(F.col("e.c").alias("c")).agg(F.count("*").alias("n"), F.first("e.via").alias("via"), F.first("base").alias("base"), F.first("quote").alias("quote")).where("n = 1").drop("n")
    inner = pairs.join(leaves.select("base", "quote"), ["base", "quote"], "left_anti")

    days = d.select("date").distinct()
    core = d.join(inner, ["base", "quote"], "left_semi")
    grid = inner.join(core.groupBy("base", "quote").agg(F.min("date").alias("from")), ["base", "quote"]).join(days, F.col("date") >= F.col("from"))
    w = Window.partitionBy("base", "quote").orderBy("date")
    carried = grid.join(core, ["base", "quote", "date"], "left").withColumn("_at", F.last(F.when(F.col("rate").isNotNull(), F.struct("date", "rate")), True).over(w))
    edges = carried.select("date", "base", "quote", F.col("_at.rate").alias("rate"), F.datediff("date", F.col("_at.date")).alias("days"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        day = pdf["date"].iloc[0]
        direct = {(b, q) for b, q, n in pdf[["base", "quote", "days"]].itertuples(index=False) if n == 0}
        rows = [(day, c, t, r, fresh, (c, t) in direct) for c, t, r, fresh in best_rates(pdf, targets, base, scale)]
        return pd.DataFrame(rows, columns=["date", "c", "target", "rate", "fresh", "direct"])

    paths = edges.groupBy("date").applyInPandas(solve, "date date, c string, target string, rate double, fresh boolean, direct boolean")
    of_core = paths.where("fresh and not direct").select("date", F.col("c").alias("base"), F.col("target").alias("quote"), "rate")

    r = F.col("r").cast("double")
    own = F.when(F.col("c") == F.col("base"), r).otherwise(F.lit(1.0) / r)  # what one unit of the leaf is worth next door
    mine = d.join(leaves, ["base", "quote"]).withColumnRenamed("rate", "r").where("r is not null")
    now = mine.where("r <> 0")
    straight = now.where(F.col("via").isin(*targets) & (F.col("c") != F.col("base"))).select("date", F.col("c").alias("base"), F.col("via").alias("quote"), own.alias("rate"))
    ways = paths.select("date", F.col("c").alias("via"), "target", F.col("rate").alias("way"), "fresh")
    through = lambda rows: rows.select("date", F.col("c").alias("base"), F.col("target").alias("quote"), (own * F.col("way")).alias("rate"))
    new = through(now.join(ways, ["via", "date"]))
    asked = leaves.join(ways.where("fresh"), "via")
    old = asof(asked, mine.select("base", "quote", "date", F.struct(F.col("date").alias("on"), "r").alias("at")), ["base", "quote"], "date", "at", "at")
    old = through(old.where("at.on < date").withColumn("r", F.col("at.r")).where("r <> 0"))
    return of_core.unionByName(straight).unionByName(new).unionByName(old)


@plugin("price_completion", "pricecompletion")
def pricecompletion(ledger: Ledger, config: str | None = None) -> Result:
    if not ledger.options.operating_currency:
        return ledger, None
    new = completed_prices(ledger.prices, ledger.options.operating_currency)
    return added(ledger, new.select("date", F.col("base").alias("name"), F.struct(F.col("rate").cast(NUM).alias("number"), F.col("quote").alias("currency")).alias("amount")), "price"), None


@plugin("print")
def print_(ledger: Ledger, config: str | None = None) -> Result:
    ledger.entries.orderBy("seq").show(int(config or 20), truncate=False)
    return ledger, None


@plugin("trading_validation", "tradingvalidation")
def tradingvalidation(ledger: Ledger, config: str | None = None) -> Result:
    """Transactions that touch the trading prefix: weights of the trading legs, and of the others, each balance; so do raw units."""
    prefix = config or "Equity:Trading"
    n, c = weight()
    trading = (F.col("account") == prefix) | F.col("account").startswith(prefix + ":")
    p = ledger.postings.where("number is not null").withColumn("_t", trading)
    p = p.join(p.where("_t").select("seq").distinct(), "seq", "left_semi")
    tol = F.coalesce(F.max(validate.tolerance_of(F.col("scale"), ledger.options)), F.lit(0).cast("decimal(28,10)"))
    sides = p.groupBy("seq", "date", "_t", c.alias("currency")).agg(F.sum(n).alias("sum"), tol.alias("tol"), F.lit("weights").alias("rule"))
    units = p.groupBy("seq", "date", F.lit(None).cast("boolean").alias("_t"), "currency").agg(F.sum("number").alias("sum"), tol.alias("tol"), F.lit("units").alias("rule"))
    bad = sides.unionByName(units).where(F.abs("sum") > F.col("tol"))
    return ledger, diagnostics(bad, "trading-unbalanced", F.concat(F.col("rule"), F.lit(" don't balance: "), F.col("sum").cast("string"), F.lit(" "), F.col("currency")))


