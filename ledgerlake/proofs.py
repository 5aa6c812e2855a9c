"""More queries over the star-schema ledger with equivalent SQL: functions, tables, booking, validation, plugins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.model import COST_SPEC, ENTRIES, NUM, POSTINGS, Ledger, Options, conform
from ledgerlake.operators import booking, dedup, plugins, prices, route, validate
from ledgerlake.plans.compiler import plain, query
from ledgerlake.queries import D2, LOTS, PRICES, TXN, UNIT, bql, entry
from ledgerlake.sources import star, work

LOT = LOTS.replace("__UNIT__", UNIT)
D6 = "decimal(38,6)"


def value(kind: str, s: Column | None = None, n: Column | None = None, b: Column | None = None) -> Column:
    """A metadata value."""
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(F.lit(kind).alias("kind"), none(s, "string").alias("s"), none(n, NUM).alias("n"), F.lit(None).cast("date").alias("d"), none(b, "boolean").alias("b"), F.lit(None).cast("string").alias("currency"))


def text(c) -> Column:
    return value("string", s=F.lit(c) if isinstance(c, str) else c)


def annotated(spark, sf_dir, lots: bool = False) -> Ledger:
    """The star ledger with metadata: parts' brand and size, inventory accounts' zone, orders' segment, postings' half."""
    led = star.ledger(spark, sf_dir, lots)
    part = star.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.create_map(F.lit("brand"), text(F.col("p_brand")), F.lit("size"), value("number", n=F.col("p_size"))).alias("m"))
    e = led.entries.join(part, "name", "left").withColumn("meta", F.when(F.col("type") == "commodity", F.col("m")).when((F.col("type") == "open") & F.col("account").startswith("Assets:"), F.create_map(F.lit("zone"), text("east"))))
    p = led.postings
    if not lots:
        p = p.withColumns({"meta": F.when(F.col("number") > 0, F.create_map(F.lit("half"), text("debit"))), "entry_meta": F.create_map(F.lit("segment"), text(F.get("tags", 0)), F.lit("half"), text("whole"))})
    return plugins.changed(led, conform(e, ENTRIES), conform(p, POSTINGS))


def over(make, statement: str, cast: dict[str, str] | None = None):
    """A query of the statement over the ledger that ``make`` gives."""

    def run(spark, sf_dir) -> DataFrame:
        df = plain(query(make(spark, sf_dir), statement))
        return df.withColumns({c: F.col(c).cast(t) for c, t in (cast or {}).items()})

    return run


# --- scalar functions -----------------------------------------------------------------------------

bql("f_repr", "SELECT DISTINCT repr(narration) AS r, repr(year) AS y, repr(number > 0) AS b", "SELECT DISTINCT '\"' || narration || '\"' AS r, year(date)::VARCHAR AS y, CASE WHEN number > 0 THEN 'TRUE' ELSE 'FALSE' END AS b FROM post")
bql("f_today", "SELECT account, max(date_diff(today(), date)) > 9000 AS old, count(date) AS n WHERE date < today() GROUP BY account", "SELECT account, max(current_date - date) > 9000 AS old, count(*) AS n FROM post WHERE date < current_date GROUP BY account")
bql("f_parse_date", "SELECT DISTINCT date, parse_date(str(date)) AS a, parse_date(subst('-', '', str(date))) AS b, parse_date(subst('-', '/', str(date))) AS c, parse_date('03 Feb 1999', '%d %b %Y') AS e", "SELECT DISTINCT date, date AS a, date AS b, date AS c, DATE '1999-02-03' AS e FROM post")
bql("f_interval", "SELECT DISTINCT date, date_bin(interval('14 days'), date, 1995-01-01) AS a, interval('3 days') = interval('3 day') AS b, interval('many days') IS NULL AS c, date_bin(interval('1 year'), date, 1990-01-01) AS d", "SELECT DISTINCT date, (DATE '1995-01-01' + ((date - DATE '1995-01-01') // 14 * 14)::INT)::DATE AS a, TRUE AS b, TRUE AS c, make_date(year(date - 1)::INT, 1, 1) AS d FROM post")
bql("f_date_bin_months", "SELECT DISTINCT date, date_bin('1 month', date, 1990-01-01) AS m, date_bin('3 months', date, 1990-01-01) AS q, date_bin('2 years', date, 1990-01-01) AS y, date_bin('1 month', date, 2030-01-01) AS b", "SELECT DISTINCT date, date_trunc('month', date - 1)::DATE AS m, date_trunc('quarter', date - 1)::DATE AS q, make_date((year(date - 1) // 2 * 2)::INT, 1, 1) AS y, date_trunc('month', date)::DATE AS b FROM post")
bql("f_findfirst", "SELECT account, findfirst('[A-F]', tags) AS f, count(date) AS n, count(findfirst('Z', tags)) AS z GROUP BY account, findfirst('[A-F]', tags)", "SELECT account, CASE WHEN tag[1:1] BETWEEN 'A' AND 'F' THEN tag END AS f, count(*) AS n, 0::BIGINT AS z FROM post GROUP BY ALL")
bql("f_filter_currency", "SELECT id, account, number(filter_currency(position, 'USD')) AS u, number(filter_currency(position, 'EUR')) AS e, commodity(units(position)) AS c", "SELECT o_orderkey::VARCHAR AS id, account, number::DECIMAL(38,2) AS u, NULL::DECIMAL(38,2) AS e, 'USD' AS c FROM post", cast={"u": D2, "e": D2})
bql("f_empty", "SELECT account, year, empty(sum(position)) AS a, empty(filter_currency(sum(position), 'EUR')) AS b, number(only('USD', filter_currency(sum(position), 'USD'))) AS c GROUP BY account, year", "SELECT account, year(date) AS year, sum(number) = 0 AS a, TRUE AS b, sum(number)::DECIMAL(38,2) AS c FROM post GROUP BY ALL", cast={"c": D2})
bql("f_convert", "SELECT id, number(convert(position, 'USD', date)) AS n, currency(convert(position, 'USD')) AS c, number(convert(units(position), 'USD')) AS l, number(convert(cost(position), 'USD')) AS k", """, last_ AS (SELECT base, last(rate ORDER BY date) AS rate FROM prices GROUP BY base)
SELECT l_orderkey::VARCHAR AS id, (number * p.rate)::DECIMAL(38,6) AS n, 'USD' AS c, (number * x.rate)::DECIMAL(38,6) AS l, (number * cost)::DECIMAL(38,6) AS k FROM lots ASOF LEFT JOIN prices p ON lots.currency = p.base AND lots.date >= p.date JOIN last_ x ON lots.currency = x.base""", LOT + ", " + PRICES, True, {c: D6 for c in "nlk"})
bql("f_value_at_date", "SELECT account, count(date) AS n, sum(number(value(position, date))) AS v, sum(number(value(position))) AS l GROUP BY account", """, last_ AS (SELECT base, last(rate ORDER BY date) AS rate FROM prices GROUP BY base)
SELECT account, count(*) AS n, sum(number * p.rate)::DECIMAL(38,6) AS v, sum(number * x.rate)::DECIMAL(38,6) AS l FROM lots ASOF LEFT JOIN prices p ON lots.currency = p.base AND lots.date >= p.date JOIN last_ x ON lots.currency = x.base GROUP BY account""", LOT + ", " + PRICES, True, {c: D6 for c in "vl"})
bql("f_value_of_sum", "SELECT account, value(sum(position)) AS v, convert(sum(position), 'USD') AS c GROUP BY account", """, last_ AS (SELECT base, last(rate ORDER BY date) AS rate FROM prices GROUP BY base),
v AS (SELECT account, sum(number * x.rate)::DECIMAL(38,6) AS s FROM lots JOIN last_ x ON lots.currency = x.base GROUP BY account)
SELECT account, CASE WHEN s = 0 THEN '()' ELSE '(' || rtrim(rtrim(s::VARCHAR, '0'), '.') || ' USD)' END AS v, CASE WHEN s = 0 THEN '()' ELSE '(' || rtrim(rtrim(s::VARCHAR, '0'), '.') || ' USD)' END AS c FROM v""", LOT + ", " + PRICES, True)
entry("f_open_meta", "SELECT account, CASE WHEN account LIKE 'Assets:%' AND account NOT LIKE '%1' THEN 'east' END AS z, account LIKE 'Assets:%' AND account NOT LIKE '%1' AS d, count(*) AS n FROM post GROUP BY ALL")(
    over(annotated, "SELECT account, str(open_meta(account, 'zone')) AS z, open_meta(account) IS NOT NULL AS d, count(date) AS n GROUP BY account")
)
entry("f_commodity_meta", "SELECT l_orderkey::VARCHAR AS id, p_brand AS b, p_size::BIGINT AS s, NULL::VARCHAR AS x, p_brand AS c FROM lots JOIN part ON currency = 'P' || p_partkey", LOT)(
    over(lambda s, d: annotated(s, d, True), "SELECT id, str(commodity_meta(currency, 'brand')) AS b, int(currency_meta(currency, 'size')) AS s, str(currency_meta(currency, 'nope')) AS x, str(getitem(currency_meta(currency), 'brand')) AS c")
)
entry("f_getitem", "SELECT o_orderkey::VARCHAR AS id, account, tag AS a, CASE WHEN idx = 0 THEN 'debit' END AS b, CASE WHEN idx = 0 THEN 'debit' ELSE 'whole' END AS c, CASE WHEN idx = 0 THEN 'debit' ELSE 'other' END AS d, 'none' AS e FROM post WHERE number <> 0")(
    over(annotated, "SELECT id, account, str(getitem(entry_meta, 'segment')) AS a, str(meta['half']) AS b, str(any_meta('half')) AS c, str(meta('half', 'other')) AS d, str(entry_meta('nope', 'none')) AS e WHERE number != 0")
)
bql("f_coalesce", "SELECT account, count(coalesce(posting_flag, flag)) AS n, max(coalesce(posting_flag, payee, 'x')) AS m, min(coalesce(cost_number, number)) AS c GROUP BY account", "SELECT account, count(*) AS n, max(payee) AS m, min(number)::DECIMAL(38,2) AS c FROM post GROUP BY account", cast={"c": D2})
bql("a5_sum_amount", "SELECT account, sum(weight) AS w, sum(units(position)) AS u, count(weight) AS n GROUP BY account", """, s AS (SELECT account, currency, sum(number) AS u, sum(number * cost)::DECIMAL(38,6) AS w, count(*) AS n FROM lots GROUP BY ALL), a AS (SELECT account, sum(w)::DECIMAL(38,6) AS w, sum(n)::BIGINT AS n, string_agg(rtrim(rtrim(u::VARCHAR, '0'), '.') || ' ' || currency, ', ' ORDER BY currency) FILTER (WHERE u <> 0) AS u FROM s GROUP BY account)
SELECT account, '(' || rtrim(rtrim(w::VARCHAR, '0'), '.') || ' USD)' AS w, '(' || coalesce(u, '') || ')' AS u, n FROM a""", LOT, True)
bql("e12_entry_attributes", "SELECT DISTINCT entry.id AS i, entry.type AS t, entry.date AS d, entry.payee AS p, entry.description AS s, entry.flag AS f, year(entry.date) AS y", "SELECT DISTINCT o_orderkey::VARCHAR AS i, 'transaction' AS t, date AS d, payee AS p, payee || ' | ' || narration AS s, flag AS f, year(date) AS y FROM post")
entry("e13_dict_key", "SELECT tag AS s, count(*) AS n, count(*) FILTER (WHERE idx = 0 AND number > 0) AS h FROM post GROUP BY tag")(over(annotated, "SELECT str(entry_meta['segment']) AS s, count(date) AS n, count(str(meta['half'])) AS h GROUP BY str(entry_meta['segment'])"))
entry("e14_meta_sugar", "SELECT account, count(*) AS n FROM post WHERE tag = 'BUILDING' AND idx = 0 AND number > 0 GROUP BY account")(over(annotated, "SELECT account, count(date) AS n WHERE str(entry_meta('segment')) = 'BUILDING' AND str(any_meta('half')) = 'debit' GROUP BY account"))
entry("q11_ungrouped_column", "SELECT 'account must be in GROUP BY or in an aggregate' AS said, count(*) AS n FROM region")(
    lambda spark, sf_dir: star.table(spark, sf_dir, "region").select(F.lit(_refused(star.ledger(spark, sf_dir), "SELECT account, number GROUP BY number")).alias("said")).groupBy("said").agg(F.count("*").alias("n"))
)


def _refused(ledger: Ledger, statement: str) -> str:
    from ledgerlake.plans.syntax import QueryError

    try:
        query(ledger, statement)
    except QueryError as e:
        return str(e).rsplit(" (at", 1)[0]
    return "accepted"


@entry("e16_overloads", "SELECT o_orderkey::VARCHAR AS id, (2 * number)::DECIMAL(38,2) AS t, 2 * year(date) AS y FROM post")
def e16_overloads(spark, sf_dir):
    """A user function of two overloads (U1, U4): the types of the argument choose; then it is taken back."""
    from ledgerlake.functions import registry

    registry.register("twice", "decimal", "decimal", lambda x: x + x)
    registry.register("twice", "int", "int", lambda x: x + x)
    try:
        df = query(star.ledger(spark, sf_dir), "SELECT id, twice(number) AS t, twice(year) AS y")
    finally:
        registry.unregister("twice", "decimal")
        registry.unregister("twice", "int")
    return df.withColumn("t", F.col("t").cast(D2))


# --- tables ---------------------------------------------------------------------------------------


def _with_entries(spark, sf_dir, *rows: DataFrame, lots: bool = False) -> Ledger:
    led = star.ledger(spark, sf_dir, lots)
    e = led.entries
    for r in rows:
        e = e.unionByName(conform(r, ENTRIES))
    return plugins.changed(led, e)


def _balances(spark, sf_dir) -> DataFrame:
    """Each account's balance of year ends, asserted one cent off in even years."""
    p = star.ledger(spark, sf_dir).postings
    per = p.groupBy("account", F.year("date").alias("y")).agg(F.sum("number").alias("s"))
    return per.select(
        F.lit("balance").alias("type"), "account", F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("date"), F.struct((F.col("s") + F.when(F.col("y") % 2 == 0, F.lit("0.01").cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))).cast("decimal(36,8)").alias("number"), F.lit("USD").alias("currency")).alias("amount"), F.lit(2).alias("scale"),
        star._seq(2, F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)), F.xxhash64("account")).alias("seq"),
    )


bql("s8_prices_table", "SELECT date, currency, number(amount) AS r, currency(amount) AS q FROM prices", "SELECT date, base AS currency, rate::DECIMAL(38,4) AS r, 'USD' AS q FROM prices", PRICES, cast={"r": "decimal(38,4)"})
bql("s8_accounts_table", "SELECT account, open.date AS o, close IS NULL AS c FROM accounts", "SELECT account, min(date) AS o, TRUE AS c FROM post WHERE account NOT LIKE '%1' GROUP BY account")
entry("s8_balances_table", """, y AS (SELECT account, year(date) AS y, sum(number) AS s FROM post GROUP BY ALL), r AS (SELECT account, y, s + CASE WHEN y % 2 = 0 THEN 0.01 ELSE 0 END AS want, sum(s) OVER (PARTITION BY account ORDER BY y) AS have FROM y)
SELECT account, make_date((y + 1)::INT, 1, 1) AS date, want::DECIMAL(38,2) AS n, nullif(have - want, 0)::DECIMAL(38,2) AS d FROM r""")(
    over(lambda s, d: _with_entries(s, d, _balances(s, d)), "SELECT account, date, number(amount) AS n, number(discrepancy) AS d FROM balances", {"n": D2, "d": D2})
)


def _notes(spark, sf_dir) -> DataFrame:
    c = star.table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("turn").cast("int"))
    return c.select(F.lit("note").alias("type"), day.alias("date"), F.concat(F.lit("Expenses:Chat:"), F.initcap("role")).alias("account"), F.col("text").alias("comment"), star._seq(5, day, F.xxhash64("conv_id", "turn", "text")).alias("seq"))


def _documents(spark, sf_dir) -> DataFrame:
    d = star.table(spark, sf_dir, "documents")
    return d.select(F.lit("document").alias("type"), F.lit("2000-01-01").cast("date").alias("date"), F.concat(F.lit("Assets:Docs:"), F.upper("lang")).alias("account"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("value"), star._seq(5, F.lit("2000-01-01").cast("date"), F.col("doc_id")).alias("seq"))


entry("s8_notes_table", "SELECT account, count(*) AS n, min(length(comment)) AS lo, max(date) AS hi FROM (SELECT 'Expenses:Chat:' || upper(role[1:1]) || lower(role[2:]) AS account, text AS comment, DATE '2000-01-01' + turn::INT AS date FROM conversations) GROUP BY account", "")(
    over(lambda s, d: _with_entries(s, d, _notes(s, d)), "SELECT account, count(comment) AS n, min(length(comment)) AS lo, max(date) AS hi FROM notes GROUP BY account")
)
entry("s8_documents_table", "SELECT 'Assets:Docs:' || upper(lang) AS account, source || '/' || doc_id AS filename, DATE '2000-01-01' AS date FROM documents", "")(
    over(lambda s, d: _with_entries(s, d, _documents(s, d)), "SELECT account, filename, date FROM documents")
)

# --- validation -----------------------------------------------------------------------------------


@entry("v1_pad", """, y AS (SELECT account, sum(number) FILTER (WHERE date < DATE '1997-01-01') AS before, sum(number) FILTER (WHERE date >= DATE '1997-01-01' AND date < DATE '1998-01-01') AS mid FROM post WHERE account LIKE 'Assets:%' GROUP BY account)
SELECT account, (5000000 - coalesce(before, 0))::DECIMAL(38,2) AS first, (6000000 - 5000000 - coalesce(mid, 0))::DECIMAL(38,2) AS second FROM y""")  # fmt: skip
def v1_pad(spark, sf_dir):
    """Pads at the end of 1996 and of 1997 bring each inventory account to 5 and to 6 million (J5: each assertion belongs to the pad before it)."""
    led = star.ledger(spark, sf_dir)
    accounts = led.postings.where("account like 'Assets:%'").select("account").distinct()
    rows = []
    for day, n in (("1997-01-01", 5_000_000), ("1998-01-01", 6_000_000)):
        d, before = F.lit(day).cast("date"), F.date_sub(F.lit(day).cast("date"), 1)
        rows.append(accounts.select(F.lit("pad").alias("type"), before.alias("date"), "account", F.lit("Equity:Pad").alias("pad_account"), star._seq(3, before, F.xxhash64("account")).alias("seq")))
        rows.append(accounts.select(F.lit("balance").alias("type"), d.alias("date"), "account", F.struct(F.lit(n).cast("decimal(36,8)").alias("number"), F.lit("USD").alias("currency")).alias("amount"), F.lit(2).alias("scale"), star._seq(2, d, F.xxhash64("account")).alias("seq")))
    padded, diag = validate.pad(_with_entries(spark, sf_dir, *rows))
    fills = padded.postings.where("flag = 'P' and account <> 'Equity:Pad'")
    of = lambda y: F.sum(F.when(F.year("date") == y, F.col("number"))).cast(D2)
    return fills.groupBy("account").agg(of(1996).alias("first"), of(1997).alias("second"))


def _days(spark, sf_dir, kind: str, key: str) -> DataFrame:
    """Orders' customers as balances of their day: amounts differ from order to order."""
    o = star.table(spark, sf_dir, "orders")
    return o.select(F.lit(kind).alias("type"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("Assets:Priority:P"), F.substring("o_orderpriority", 1, 1)).alias("account"), F.struct(F.col(key).cast("decimal(18,2)").cast("decimal(36,8)").alias("number"), F.lit("USD").alias("currency")).alias("amount"), F.lit(2).alias("scale"), F.col("o_orderkey").alias("seq"))


@entry("v3_duplicate_balances", """, b AS (SELECT o_orderdate::DATE AS date, 'Assets:Priority:P' || o_orderpriority[1:1] AS account, o_totalprice::DECIMAL(18,2) AS n, o_orderkey AS k FROM orders), f AS (SELECT *, first(n) OVER (PARTITION BY account, date ORDER BY k) AS head FROM b)
SELECT date, account, count(*) AS n FROM f WHERE n <> head GROUP BY ALL""", TXN)  # fmt: skip
def v3_duplicate_balances(spark, sf_dir):
    """Assertions of a day that differ from the day's first."""
    led = Ledger(spark, conform(_days(spark, sf_dir, "balance", "o_totalprice"), ENTRIES), spark.createDataFrame([], POSTINGS))
    return validate.duplicate_balances(led).groupBy("date", "account").agg(F.count("*").alias("n"))


@entry("v4_duplicate_opens", "SELECT account, count(*) - 1 AS n FROM (SELECT 'Assets:Customer:' || o_custkey AS account FROM orders) GROUP BY account HAVING count(*) > 1", "")
def v4_duplicate_opens(spark, sf_dir):
    """Every order opens its customer's account: all but the first are told."""
    o = star.table(spark, sf_dir, "orders")
    rows = o.select(F.lit("open").alias("type"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("Assets:Customer:"), F.col("o_custkey").cast("string")).alias("account"), star._seq(1, F.to_date("o_orderdate"), F.col("o_orderkey")).alias("seq"))
    return validate.duplicate_opens(Ledger(spark, conform(rows, ENTRIES), spark.createDataFrame([], POSTINGS))).groupBy("account").agg(F.count("*").alias("n"))


@entry("v6_currency_constraints", "SELECT account, currency, count(*) AS n FROM lots WHERE (l_partkey + l_suppkey) % 2 = 1 GROUP BY ALL", LOTS.replace("__UNIT__", "0"))
def v6_currency_constraints(spark, sf_dir):
    """A stock account's Open allows the parts whose number is as even as its supplier's."""
    led = star.ledger(spark, sf_dir, lots=True)
    used = led.postings.select("account", "currency").distinct()
    even = (F.substring("currency", 2, 12).cast("bigint") + F.regexp_extract("account", r"S(\d+)$", 1).cast("bigint")) % 2 == 0
    opens = used.groupBy("account").agg(F.coalesce(F.collect_list(F.when(even, F.col("currency"))), F.array()).alias("currencies")).withColumn("currencies", F.concat("currencies", F.array(F.lit("USD"))))
    opens = opens.select(F.lit("open").alias("type"), F.lit("1990-01-01").cast("date").alias("date"), "account", "currencies", star._seq(1, F.lit("1990-01-01").cast("date"), F.xxhash64("account")).alias("seq"))
    led = plugins.changed(led, conform(opens, ENTRIES))
    d = validate.disallowed_currencies(led)
    return d.groupBy("account", F.substring_index("message", " ", 1).alias("currency")).agg(F.count("*").alias("n"))


@entry("v8_tolerances", "SELECT o_orderkey AS k, 'USD' AS currency, CASE WHEN min(l_linenumber % 3) = 2 THEN NULL WHEN max(CASE WHEN l_linenumber % 3 = 2 THEN -1 ELSE 2 - l_linenumber % 3 END) = 2 THEN 0.05 ELSE 0.005 END::DECIMAL(38,4) AS t FROM post GROUP BY ALL")
def v8_tolerances(spark, sf_dir):
    """Half a unit of the coarsest authored digits: lines of number 0 mod 3 with one digit, 1 with two, 2 with none."""
    led = star.ledger(spark, sf_dir)
    line = F.floor(F.col("idx") / 2)
    ranks = _line_numbers(spark, sf_dir)
    p = led.postings.withColumn("rank", line.cast("int")).withColumn("k", F.col("id").cast("bigint")).join(ranks, ["k", "rank"])
    p = p.withColumn("scale", F.when(F.col("l_linenumber") % 3 == 0, 1).when(F.col("l_linenumber") % 3 == 1, 2).otherwise(0))
    keys = p.select("seq", "k").distinct()
    return validate.transaction_tolerances(plugins.changed(led, None, conform(p, POSTINGS))).join(keys, "seq").select("k", "currency", F.col("tolerance").cast("decimal(38,4)").alias("t"))


def _line_numbers(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    li = star.table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*star.LINE_KEY[1:])) - 1
    return li.select(F.col("l_orderkey").alias("k"), rank.alias("rank"), "l_linenumber")


@entry("v9_missing_documents", "SELECT source || '/' || doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "")
def v9_missing_documents(spark, sf_dir):
    """The files that exist are those of labelled documents."""
    d = star.table(spark, sf_dir, "documents").join(star.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    led = Ledger(spark, conform(_documents(spark, sf_dir), ENTRIES), spark.createDataFrame([], POSTINGS))
    return validate.missing_documents(led, d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))).select(F.regexp_replace("message", "^no such file: ", "").alias("path"))


# --- booking --------------------------------------------------------------------------------------

TRADES = f"""lines AS (SELECT *, l_shipdate::DATE AS day, {UNIT} AS cost, ('0x' || md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, l_extendedprice::DECIMAL(18,2)))[1:15])::BIGINT AS k FROM lineitem),
buys AS (SELECT * FROM lines WHERE l_returnflag <> 'R'), sells AS (SELECT * FROM lines WHERE l_returnflag = 'R')"""


def trades(spark, sf_dir, method: str, empty: bool = True) -> Ledger:
    """Lines as purchases of a part's account at cost; returned lines sell one unit each after all purchases."""
    li = star.table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in star.LINE_KEY[:4]], F.col("l_quantity").cast("bigint").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    k = F.coalesce(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(0))  # the order of transactions, from their key alone
    per = (F.col("l_extendedprice").cast("decimal(18,2)") / F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,4)").cast(NUM)
    sale = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    # booking reads the legs several times: keys and costs are computed once and written down
    li = work.written(li.select(k.alias("k"), F.when(~sale, per).alias("per"), "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"), "trades")
    part, n = F.col("l_partkey").cast("string"), F.lit
    none = lambda t: F.lit(None).cast(t)
    bought, sold = li.where(~sale), li.where(sale)
    lot = F.struct(F.col("per").alias("per_unit"), none(NUM).alias("total"), n("USD").alias("currency"), F.to_date("l_shipdate").alias("date"), F.col("k").cast("string").alias("label"))
    any_lot = F.struct(*[none(f.dataType).alias(f.name) for f in COST_SPEC.fields])
    day, last = F.to_date("l_shipdate"), n("2010-01-01").cast("date")
    first, later = F.col("k"), F.col("k") + n(1 << 61)
    stock, cash = {"idx": n(0), "account": F.concat(n("Assets:Stock:P"), part), "currency": F.concat(n("P"), part)}, {"idx": n(1), "account": n("Assets:Cash")}
    # a union of purchases and sales and of their legs, so that a condition on some doesn't compute the others
    def rows(df, seq, date, what, leg):
        have = {"seq": seq, "date": date, "flag": n("*"), "narration": n(what), "id": F.col("k").cast("string")} | leg
        # specs have their type already: a cast would hide their fields from Catalyst
        return df.select(*[(have[f.name] if f.name == "cost_spec" and "cost_spec" in have else have.get(f.name, n(None)).cast(f.dataType)).alias(f.name) for f in POSTINGS.fields])

    p = rows(bought, first, day, "purchase", stock | {"number": F.col("l_quantity").cast(NUM), "cost_spec": lot}).unionByName(rows(sold, later, last, "sale", stock | {"number": n(-1).cast(NUM), "cost_spec": any_lot}))
    p = p.unionByName(rows(bought, first, day, "purchase", cash)).unionByName(rows(sold, later, last, "sale", cash))
    return Ledger(spark, conform(p.select("seq", "date", "flag", "id", F.lit("transaction").alias("type")).distinct(), ENTRIES), p, Options(booking_method=method))


def _fifo_sql(order: str) -> str:
    return f""", b AS (SELECT l_partkey, k, cost, l_quantity::BIGINT AS q, sum(l_quantity::BIGINT) OVER (PARTITION BY l_partkey ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS hi FROM buys),
s AS (SELECT l_partkey, k, row_number() OVER (PARTITION BY l_partkey ORDER BY k) AS n FROM sells),
m AS (SELECT s.k, b.k AS lot, b.cost FROM s JOIN b ON s.l_partkey = b.l_partkey AND n <= hi AND n > hi - q)
SELECT k::VARCHAR AS id, lot::VARCHAR AS lot, -1::DECIMAL(38,2) AS n, cost::DECIMAL(38,4) AS cost FROM m"""


def _matched(led: Ledger) -> DataFrame:
    p = booking.book(led).postings.where("account <> 'Assets:Cash' and number < 0")
    return p.select("id", F.col("cost.label").alias("lot"), F.col("number").cast(D2).alias("n"), F.col("cost.number").cast("decimal(38,4)").alias("cost"))


@entry("b5_reduce_fifo", _fifo_sql("day, k"), TRADES)
def b5_reduce_fifo(spark, sf_dir):
    """Purchases augment, sales reduce the oldest lots; every sale's lot and cost."""
    return _matched(trades(spark, sf_dir, "FIFO"))


@entry("b5_reduce_lifo", _fifo_sql("day DESC, k"), TRADES)
def b5_reduce_lifo(spark, sf_dir):
    return _matched(trades(spark, sf_dir, "LIFO"))


@entry("b5_reduce_strict", """, s AS (SELECT l_partkey, count(*) AS n FROM buys GROUP BY l_partkey)
SELECT 'ambiguous-lot' AS code, 'Assets:Stock:P' || x.l_partkey AS account, count(*) AS n FROM sells x JOIN s USING (l_partkey) WHERE s.n > 1 GROUP BY ALL""", TRADES)  # fmt: skip
def b5_reduce_strict(spark, sf_dir):
    """A sale that names no lot is ambiguous wherever there are several."""
    return booking.book(trades(spark, sf_dir, "STRICT")).diagnostics.groupBy("code", "account").agg(F.count("*").alias("n"))


@entry("b7_interpolation", "SELECT k::VARCHAR AS id, (-l_quantity * cost)::DECIMAL(38,4) AS cash FROM buys", TRADES)
def b7_interpolation(spark, sf_dir):
    """The cash leg without an amount takes what the purchase costs."""
    p = booking.book(trades(spark, sf_dir, "FIFO")).postings.where("account = 'Assets:Cash' and narration = 'purchase'")
    return p.select("id", F.col("number").cast("decimal(38,4)").alias("cash"))


@entry("b8_inventory_after", """, b AS (SELECT l_partkey, k, cost, l_quantity::BIGINT AS q, sum(l_quantity::BIGINT) OVER (PARTITION BY l_partkey ORDER BY day, k ROWS UNBOUNDED PRECEDING) AS hi FROM buys), s AS (SELECT l_partkey, count(*) AS n FROM sells GROUP BY l_partkey),
left_ AS (SELECT b.l_partkey, cost, greatest(0, least(q, hi - coalesce(n, 0))) AS u FROM b LEFT JOIN s USING (l_partkey))
SELECT 'Assets:Stock:P' || l_partkey AS account, sum(u)::DECIMAL(38,2) AS units, sum(u * cost)::DECIMAL(38,4) AS cost FROM left_ WHERE u > 0 GROUP BY ALL""", TRADES)  # fmt: skip
def b8_inventory_after(spark, sf_dir):
    """The walk's end (B4, B8): what each account holds, and at what cost."""
    led = booking.book(trades(spark, sf_dir, "FIFO"))
    return query(led, "SELECT account, sum(number) AS units, number(only('USD', sum(cost(position)))) AS cost WHERE account ~ 'Stock' GROUP BY account").withColumns({"units": F.col("units").cast(D2), "cost": F.col("cost").cast("decimal(38,4)")})


@entry("b2_total_cost", "SELECT k::VARCHAR AS id, (((l_extendedprice::DECIMAL(18,2) * 100)::HUGEINT * 2000000 + l_quantity::HUGEINT) // (l_quantity::HUGEINT * 2) / 100000000.0::DECIMAL(18,8))::DECIMAL(38,8) AS cost FROM buys", TRADES)
def b2_total_cost(spark, sf_dir):
    """Lots given by their total cost: the cost of a unit."""
    led = trades(spark, sf_dir, "FIFO")
    li = led.postings.where("seq < 2305843009213693952")
    total = (F.col("cost_spec.per_unit") * 0).cast(NUM)
    raw = star.table(spark, sf_dir, "lineitem").select(_line_id().alias("id"), F.col("l_extendedprice").cast("decimal(18,2)").cast(NUM).alias("ext"))
    spec = F.struct(F.lit(None).cast(NUM).alias("per_unit"), F.col("ext").alias("total"), F.col("cost_spec.currency").alias("currency"), F.col("cost_spec.date").alias("date"), F.col("cost_spec.label").alias("label"))
    p = li.join(raw, "id").withColumn("cost_spec", F.when(F.col("cost_spec").isNotNull() & total.isNotNull(), spec))
    got = booking.book(plugins.changed(led, None, conform(p, POSTINGS))).postings
    return got.where("cost is not null").select("id", F.col("cost.number").cast("decimal(38,8)").alias("cost"))


def _line_id() -> Column:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in star.LINE_KEY[:4]], F.col("l_quantity").cast("bigint").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10)


@entry("b7_group_rollback", """, s AS (SELECT l_partkey, count(*) AS n FROM buys GROUP BY l_partkey)
SELECT k::VARCHAR AS id, currency, 2::BIGINT AS n FROM sells JOIN s USING (l_partkey), (VALUES ('EUR'), ('GBP')) AS c(currency) WHERE n > 1""", TRADES)  # fmt: skip
def b7_group_rollback(spark, sf_dir):
    """Ambiguous sales drop the postings of their currency; those in EUR and GBP of the same transaction stay."""
    led = trades(spark, sf_dir, "STRICT")
    sale = led.postings.where("seq >= 2305843009213693952 and idx = 0")
    more = sale.withColumn("x", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(n).cast(NUM).alias("n")) for i, c, n in ((2, "EUR", 1), (3, "EUR", -1), (4, "GBP", 2), (5, "GBP", -2))])))
    more = more.withColumns({"idx": F.col("x.i"), "account": F.concat(F.lit("Assets:Bank:"), F.col("x.c")), "currency": F.col("x.c"), "number": F.col("x.n"), "cost_spec": F.when(F.lit(False), F.col("cost_spec"))})
    got = booking.book(plugins.changed(led, None, led.postings.unionByName(conform(more, POSTINGS)))).postings.where("seq >= 2305843009213693952")
    kept = got.where("account like 'Assets:Bank:%'").groupBy("id", "currency").agg(F.count("*").alias("n"))
    return kept.join(got.where("account like 'Assets:Stock:%'").select("id"), "id", "left_anti")


@entry("b9_inspect", """, b AS (SELECT l_partkey, k, cost, l_quantity::BIGINT AS q, sum(l_quantity::BIGINT) OVER (PARTITION BY l_partkey ORDER BY day, k ROWS UNBOUNDED PRECEDING) AS hi FROM buys),
s AS (SELECT l_partkey, k, row_number() OVER (PARTITION BY l_partkey ORDER BY k) AS n FROM sells), one AS (SELECT * FROM s WHERE k = (SELECT max(k) FROM sells))
SELECT 'P' || b.l_partkey AS currency, cost::DECIMAL(38,4) AS cost, greatest(0, least(q, hi - n + 1))::DECIMAL(38,2) AS before, greatest(0, least(q, hi - n))::DECIMAL(38,2) AS after FROM b JOIN one USING (l_partkey) WHERE hi - n + 1 > 0""", TRADES)  # fmt: skip
def b9_inspect(spark, sf_dir):
    """The lots of the last sale's account before and after it."""
    lines = trades(spark, sf_dir, "FIFO")
    led = booking.book(lines)
    last = lines.postings.where("cost_spec is not null").agg(F.max(F.struct("seq", "account"))).first()[0]
    got = booking.inspect(led, last["seq"], [last["account"]])
    return got.select("currency", F.col("cost.number").cast("decimal(38,4)").alias("cost"), F.col("before").cast(D2).alias("before"), F.col("after").cast(D2).alias("after"))


# --- plugins --------------------------------------------------------------------------------------


@entry("p_checkclosing", "SELECT account, (date + 1)::DATE AS date, count(*) AS n, TRUE AS stripped FROM post WHERE number > 90000 GROUP BY ALL")
def p_checkclosing(spark, sf_dir):
    led = star.ledger(spark, sf_dir)
    led = plugins.changed(led, None, conform(led.postings.withColumn("meta", F.when(F.col("number") > 90000, F.create_map(F.lit("closing"), value("bool", b=F.lit(True))))), POSTINGS))
    got = plugins.checkclosing(led)[0]
    left = got.postings.where(F.map_contains_key("meta", "closing")).count()
    return got.of("balance").where("amount.number = 0").groupBy("account", "date").agg(F.count("*").alias("n")).withColumn("stripped", F.lit(left == 0))


@entry("p_checkdrained", "SELECT DISTINCT replace(account, 'Liabilities:Payable', 'Income:Sales') AS account, DATE '2005-01-02' AS date, 'USD' AS currency FROM post WHERE account LIKE 'Assets:%'")
def p_checkdrained(spark, sf_dir):
    """Income accounts close too, but are not drained."""
    from ledgerlake.queries import _income_ledger

    led = _income_ledger(spark, sf_dir)
    close = led.postings.select("account").distinct().select(F.lit("close").alias("type"), F.lit("2005-01-01").cast("date").alias("date"), "account", star._seq(6, F.lit("2005-01-01").cast("date"), F.xxhash64("account")).alias("seq"))
    got = plugins.checkdrained(plugins.changed(led, led.entries.unionByName(conform(close, ENTRIES))))[0]
    return got.of("balance").select("account", "date", F.col("amount.currency").alias("currency"))


def _nation_ledger(spark, sf_dir) -> Ledger:
    """Suppliers post to accounts of their own below their nation, customers to their nation's account, which is no leaf."""
    s, c, n, r = (star.table(spark, sf_dir, t) for t in ("supplier", "customer", "nation", "region"))
    nations = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat_ws(":", F.lit("Assets"), F.regexp_replace("r_name", " ", "-"), F.regexp_replace("n_name", " ", "-")).alias("nation"))
    rows = lambda t, key, of, bal, own, base: t.join(nations, t[of] == nations["n_nationkey"]).select((F.col(key) + base).alias("seq"), F.lit(0).alias("idx"), F.lit("2000-01-01").cast("date").alias("date"), F.lit("*").alias("flag"), (F.concat("nation", F.lit(":S"), F.col(key).cast("string")) if own else F.col("nation")).alias("account"), F.col(bal).cast("decimal(18,2)").alias("number"), F.lit("USD").alias("currency"))
    p = rows(s, "s_suppkey", "s_nationkey", "s_acctbal", True, 0).unionByName(rows(c, "c_custkey", "c_nationkey", "c_acctbal", False, 1 << 40))
    return Ledger(spark, conform(p.select("seq", "date", "flag", F.lit("transaction").alias("type")), ENTRIES), conform(p, POSTINGS))


NATIONS = "nat AS (SELECT n_nationkey, 'Assets:' || replace(r_name, ' ', '-') || ':' || replace(n_name, ' ', '-') AS nation FROM nation JOIN region ON n_regionkey = r_regionkey), held AS (SELECT DISTINCT nation FROM supplier JOIN nat ON s_nationkey = n_nationkey)"


@entry("p_leafonly", "SELECT nation AS account, count(*) AS n FROM customer JOIN nat ON c_nationkey = n_nationkey WHERE nation IN (SELECT nation FROM held) GROUP BY ALL", NATIONS)
def p_leafonly(spark, sf_dir):
    return plugins.leafonly(_nation_ledger(spark, sf_dir))[1].groupBy("account").agg(F.count("*").alias("n"))


@entry("p_leafonly_pads", """, u AS (SELECT nation AS account FROM customer JOIN nat ON c_nationkey = n_nationkey WHERE nation IN (SELECT nation FROM held) UNION ALL SELECT nation FROM held UNION ALL SELECT regexp_replace(nation, ':[^:]*$', '') FROM held)
SELECT account, count(*) AS n FROM u GROUP BY account""", NATIONS)  # fmt: skip
def p_leafonly_pads(spark, sf_dir):
    """Pads count as uses too: of the padded account and of the one drawn on."""
    led = _nation_ledger(spark, sf_dir)
    up = lambda a, n: F.array_join(F.slice(F.split(a, ":"), 1, n), ":")
    own = led.postings.where(F.size(F.split("account", ":")) == 4).select(up("account", 3).alias("account"), up("account", 2).alias("pad_account")).distinct()
    pads = own.select(F.lit("pad").alias("type"), F.lit("2000-01-01").cast("date").alias("date"), "account", "pad_account", F.xxhash64("account").alias("seq"))
    led = plugins.changed(led, led.entries.unionByName(conform(pads, ENTRIES)))
    return plugins.PLUGINS["leafonly_pads"](led)[1].groupBy("account").agg(F.count("*").alias("n"))


@entry("p_nounused", "SELECT 'Assets:Customer:' || c_custkey AS account FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)", "")
def p_nounused(spark, sf_dir):
    c, o = star.table(spark, sf_dir, "customer"), star.table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 200000")
    name = lambda k: F.concat(F.lit("Assets:Customer:"), F.col(k).cast("string")).alias("account")
    day = F.lit("1990-01-01").cast("date").alias("date")
    opens = c.select(F.lit("open").alias("type"), day, name("c_custkey"), F.col("c_custkey").alias("seq"))
    p = o.select((F.col("o_orderkey") + (1 << 40)).alias("seq"), F.lit(0).alias("idx"), F.to_date("o_orderdate").alias("date"), name("o_custkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("number"), F.lit("USD").alias("currency"))
    return plugins.nounused(Ledger(spark, conform(opens, ENTRIES), conform(p, POSTINGS)))[1].select("account")


@entry("p_uniqueprices", "SELECT 'P' || l_partkey AS base, count(*) AS n FROM (SELECT l_partkey, cost, first(cost) OVER (PARTITION BY l_partkey, day ORDER BY k) AS f FROM lines) WHERE cost <> f GROUP BY l_partkey", TRADES)
def p_uniqueprices(spark, sf_dir):
    """A price entry per line: those that differ from their day's first."""
    li = star.table(spark, sf_dir, "lineitem")
    rate = (F.col("l_extendedprice").cast("decimal(18,2)") / F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,4)")
    e = li.select(F.lit("price").alias("type"), _line_id().cast("long").alias("seq"), F.to_date("l_shipdate").alias("date"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.struct(rate.cast("decimal(36,8)").alias("number"), F.lit("USD").alias("currency")).alias("amount"))
    d = plugins.uniqueprices(Ledger(spark, conform(e, ENTRIES), spark.createDataFrame([], POSTINGS)))[1]
    return d.groupBy(F.regexp_extract("message", r"of (\S+)$", 1).alias("base")).agg(F.count("*").alias("n"))


@entry("p_checkmetadata", "SELECT 'no zone' AS message, account FROM (SELECT DISTINCT account FROM post WHERE account LIKE 'Liabilities:%' AND account NOT LIKE '%1') UNION ALL SELECT 'no colour', NULL FROM part")
def p_checkmetadata(spark, sf_dir):
    return plugins.checkmetadata(annotated(spark, sf_dir), "account: zone; commodity: brand, size, colour")[1].select("message", "account")


@entry("p_commoditypattern", "SELECT account, count(*) AS n FROM lots WHERE NOT regexp_full_match(currency, 'P[0-9]*[0-4]') GROUP BY account", LOT)
def p_commoditypattern(spark, sf_dir):
    led = star.ledger(spark, sf_dir, lots=True)
    opens = led.postings.select("account").distinct().select(F.lit("open").alias("type"), F.lit("1990-01-01").cast("date").alias("date"), "account", F.create_map(F.lit("commodity_pattern"), text("P[0-9]*[0-4]")).alias("meta"), F.xxhash64("account").alias("seq"))
    d = plugins.commoditypattern(plugins.changed(led, conform(opens, ENTRIES)))[1]
    return d.groupBy("account").agg(F.count("*").alias("n"))


@entry("p_comprehensivebalance", ", m AS (SELECT account, min(currency) AS c FROM lots GROUP BY account) SELECT DISTINCT l.account, DATE '2010-01-01' AS date, currency, (CASE WHEN currency = c THEN 7 ELSE 0 END)::DECIMAL(38,2) AS n FROM lots l JOIN m USING (account)", LOT)
def p_comprehensivebalance(spark, sf_dir):
    """Each stock account lists one of its parts: all others that it ever held must be gone."""
    led = star.ledger(spark, sf_dir, lots=True)
    own = led.postings.groupBy("account").agg(F.min("currency").alias("c"))
    custom = own.select(F.lit("custom").alias("type"), F.lit("comprehensive-balance").alias("name"), F.lit("2010-01-01").cast("date").alias("date"), F.concat_ws("\x1f", "account", F.concat(F.lit("7 "), F.col("c"))).alias("value"), F.xxhash64("account").alias("seq"))
    got = plugins.comprehensivebalance(plugins.changed(led, conform(custom, ENTRIES)))[0].of("balance")
    return got.select("account", "date", F.col("amount.currency").alias("currency"), F.col("amount.number").cast(D2).alias("n"))


@entry("p_infermetadata", "SELECT 'commodity' AS type, 'P' || p_partkey AS k, 'P' || p_partkey AS title, p_brand AS label FROM part UNION ALL SELECT DISTINCT 'open', account, split_part(account, ':', 3), NULL FROM post WHERE account NOT LIKE '%1'")
def p_infermetadata(spark, sf_dir):
    got = plugins.infermetadata(annotated(spark, sf_dir), "commodity title __commodity__\nopen title __account__\ncommodity label brand\ncommodity size __commodity__")[0].entries
    m = lambda k: F.try_element_at("meta", F.lit(k))["s"].alias(k)
    return got.where("type in ('commodity', 'open')").select("type", F.coalesce("name", "account").alias("k"), m("title"), m("label"))


@entry("p_inheritmetadata", "SELECT account, CASE WHEN account LIKE 'Assets:ASIA%' THEN 'east' ELSE 'world' END AS zone FROM (SELECT nation || ':S' || s_suppkey AS account FROM supplier JOIN nat ON s_nationkey = n_nationkey UNION ALL SELECT DISTINCT nation FROM held UNION ALL SELECT 'Assets' UNION ALL SELECT 'Assets:ASIA')", NATIONS)
def p_inheritmetadata(spark, sf_dir):
    """Accounts without a zone take that of the nearest account above."""
    up = F.array_join(F.slice(F.split("account", ":"), 1, 3), ":")
    own = _nation_ledger(spark, sf_dir).postings.where(F.size(F.split("account", ":")) == 4).select("account")
    every = own.unionByName(own.select(up.alias("account")).distinct()).withColumn("zone", F.lit(None).cast("string")).unionByName(spark.createDataFrame([("Assets", "world"), ("Assets:ASIA", "east")], "account string, zone string"))
    e = every.select(F.lit("open").alias("type"), "account", F.when(F.col("zone").isNotNull(), F.create_map(F.lit("zone"), text(F.col("zone")))).alias("meta"), F.xxhash64("account").alias("seq"))
    got = plugins.inheritmetadata(Ledger(spark, conform(e, ENTRIES), spark.createDataFrame([], POSTINGS)), "zone")[0]
    return got.of("open").select("account", F.col("meta")["zone"]["s"].alias("zone"))


@entry("p_pricecompletion", "SELECT date, base, 'EUR' AS quote, (rate / 1.25)::DECIMAL(38,6) AS rate FROM prices UNION ALL SELECT DATE '1990-01-01', 'USD', 'EUR', 0.8", PRICES)
def p_pricecompletion(spark, sf_dir):
    """Parts are priced in USD, and EUR once in USD: every part's price in EUR on the days it has a price."""
    led = star.ledger(spark, sf_dir)
    eur = spark.createDataFrame([("price", 0, "EUR")], "type string, seq long, name string").withColumns({"date": F.lit("1990-01-01").cast("date"), "amount": F.struct(F.lit("1.25").cast("decimal(36,8)").alias("number"), F.lit("USD").alias("currency"))})
    led = Ledger(spark, led.of("price").unionByName(conform(eur, ENTRIES)), led.postings, Options(operating_currency=("EUR",)))
    new = plugins.pricecompletion(led)[0].of("price").where("amount.currency = 'EUR'")
    return new.select("date", F.col("name").alias("base"), F.col("amount.currency").alias("quote"), F.col("amount.number").cast(D6).alias("rate"))


@entry("p_tradingvalidation", "SELECT l_orderkey AS k, (1 + count(DISTINCT l_partkey))::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey", "")
def p_tradingvalidation(spark, sf_dir):
    """Every line trades cash for stock by way of the trading account; of returned lines the trading leg lacks its price."""
    li = star.table(spark, sf_dir, "lineitem")
    cash, units, part = F.col("l_extendedprice").cast("decimal(18,2)").cast(NUM), F.col("l_quantity").cast(NUM), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    price = F.struct(cash.alias("number"), F.lit("USD").alias("currency"), F.lit(True).alias("is_total"))
    leg = lambda i, a, n, c, p: F.struct(F.lit(i).alias("i"), F.lit(a).alias("account"), n.alias("number"), c.alias("currency"), p.alias("price"))
    none = F.when(F.lit(False), price)
    legs = F.array(leg(0, "Assets:Cash", -cash, F.lit("USD"), none), leg(1, "Equity:Trading:Cash", cash, F.lit("USD"), none), leg(2, "Equity:Trading:Stock", -units, part, F.when(F.col("l_returnflag") != "R", price)), leg(3, "Assets:Stock", units, part, price))
    p = li.select(F.col("l_orderkey").alias("seq"), F.to_date("l_shipdate").alias("day"), F.explode(legs).alias("x")).select("seq", F.lit("2000-01-01").cast("date").alias("date"), "x.account", "x.number", "x.currency", "x.price", F.lit(2).alias("scale"))
    led = Ledger(spark, spark.createDataFrame([], ENTRIES), conform(p, POSTINGS))
    return plugins.tradingvalidation(led)[1].groupBy(F.col("seq").alias("k")).agg(F.count("*").alias("n"))


# --- scoping, prices, dedup, routing ----------------------------------------------------------------


@entry("r4_synthetic", """, i AS (SELECT date, replace(account, 'Liabilities:Payable', 'Income:Sales') AS account, number FROM post),
o AS (SELECT account FROM i WHERE date < DATE '1998-01-01' GROUP BY account HAVING sum(number) <> 0), c AS (SELECT account FROM i WHERE date >= DATE '1998-01-01' AND date < DATE '1999-01-01' AND account LIKE 'Income:%' GROUP BY account HAVING sum(number) <> 0)
SELECT m, count(*) AS n FROM (SELECT 'opening' AS m FROM o, (VALUES (1), (2)) UNION ALL SELECT 'clearing' FROM c, (VALUES (1), (2)) UNION ALL SELECT NULL FROM i WHERE date >= DATE '1998-01-01' AND date < DATE '1999-01-01') GROUP BY m""")  # fmt: skip
def r4_synthetic(spark, sf_dir):
    """Postings by the mark of what made them."""
    from ledgerlake.queries import _income_ledger

    return query(_income_ledger(spark, sf_dir), "SELECT str(entry_meta('__synthetic__')) AS m, count(date) AS n FROM OPEN ON 1998-01-01 CLOSE ON 1999-01-01 CLEAR GROUP BY str(entry_meta('__synthetic__'))")


@entry("r2_kept_entries", ", e AS (SELECT 'transaction' AS type, date FROM txn UNION ALL SELECT 'price', l_shipdate::DATE FROM lineitem GROUP BY l_partkey, l_shipdate::DATE UNION ALL SELECT 'event', ts::DATE FROM events UNION ALL SELECT 'commodity', NULL FROM part), o AS (SELECT account FROM post WHERE date < DATE '1998-01-01' GROUP BY account HAVING sum(number) <> 0), a AS (SELECT DISTINCT account FROM post WHERE account NOT LIKE '%1') SELECT type, count(*) AS n FROM (SELECT type FROM e WHERE date IS NULL OR date >= DATE '1998-01-01' UNION ALL SELECT 'transaction' FROM o UNION ALL SELECT 'open' FROM a) GROUP BY type")
def r2_kept_entries(spark, sf_dir):
    """Entries after OPEN ON: those from that day on, undated ones, earlier Opens, and an opening transaction per account held."""
    import datetime

    from ledgerlake.operators.scope import opened

    return opened(star.ledger(spark, sf_dir), datetime.date(1998, 1, 1)).entries.groupBy("type").agg(F.count("*").alias("n"))


MERGED = f", a AS (SELECT 'P' || l_partkey AS base, l_shipdate::DATE AS date, first({UNIT} ORDER BY k) FILTER (WHERE l_returnflag <> 'R') AS old_first, first({UNIT} ORDER BY k) FILTER (WHERE l_returnflag = 'R') AS new_first, last({UNIT} ORDER BY k) FILTER (WHERE l_returnflag <> 'R') AS old_last, last({UNIT} ORDER BY k) FILTER (WHERE l_returnflag = 'R') AS new_last FROM lines GROUP BY ALL) SELECT base, date, coalesce(old_first, new_first)::DECIMAL(38,4) AS first, coalesce(new_last, old_last)::DECIMAL(38,4) AS last FROM a"


@entry("w6_merge_prices", MERGED, TRADES)
def w6_merge_prices(spark, sf_dir):
    """Prices of sold lines merged into those of the others: the first of a day is kept, or the last."""
    li = star.table(spark, sf_dir, "lineitem")
    rate = (F.col("l_extendedprice").cast("decimal(18,2)") / F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,4)")
    p = li.select(_line_id().cast("long").alias("seq"), F.to_date("l_shipdate").alias("date"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("base"), F.lit("USD").alias("quote"), rate.alias("rate"), "l_returnflag")
    old, new = p.where("l_returnflag <> 'R'").drop("l_returnflag"), p.where("l_returnflag = 'R'").drop("l_returnflag")
    one = lambda keep: route.merge_prices(old, new, keep).select("base", "date", F.col("rate").cast("decimal(38,4)").alias(keep))
    return one("first").join(one("last"), ["base", "date"])


@entry("w7_carry_forward", ", g AS (SELECT DISTINCT 'P' || l_partkey AS base, o_orderdate::DATE AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT date, count(*) AS asked, count(rate) AS n, coalesce(sum(rate), 0)::DECIMAL(38,4) AS total FROM g ASOF LEFT JOIN prices USING (base, date) GROUP BY date", PRICES)
def w7_carry_forward(spark, sf_dir):
    """Each part's last price carried to the days on which it is ordered."""
    li, o = star.table(spark, sf_dir, "lineitem"), star.table(spark, sf_dir, "orders")
    asked = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("base"), F.to_date("o_orderdate").alias("date")).distinct()
    got = prices.asof(asked, prices.daily(star.prices(spark, sf_dir)).select("base", "date", "rate"), ["base"], "date", "rate", "r")
    return got.groupBy("date").agg(F.count("*").alias("asked"), F.count("r").alias("n"), F.coalesce(F.sum("r"), F.lit(0)).cast("decimal(38,4)").alias("total"))


@entry("d3_decide", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'skip' WHEN o_orderkey % 3 = 1 THEN 'comment' ELSE 'write' END AS action, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL", "")
def d3_decide(spark, sf_dir):
    """What happens to a third that comes again, a third like others, and a third of new transactions."""
    from ledgerlake.queries import d2_dedup_exact

    return dedup.decide(d2_dedup_exact(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@entry("d5_price_requests", "SELECT 'P' || p_partkey AS currency, q AS quote, l::INT AS level, s AS source, m AS symbol, i AS inverted FROM part, (VALUES ('USD', 0, 'one', 'A', FALSE), ('USD', 1, 'two', 'B', TRUE), ('EUR', 0, 'two', 'C', FALSE)) AS v(q, l, s, m, i)", "")
def d5_price_requests(spark, sf_dir):
    c = star.ledger(spark, sf_dir).of("commodity").withColumn("meta", F.create_map(F.lit("price"), text("USD:one/A,two/^B EUR:two/C")))
    return route.price_requests(c)


@entry("d6_source_fallback", ", r AS (SELECT 'P' || p_partkey AS currency, p_partkey FROM part) SELECT currency, 'USD' AS quote, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 2 END::DECIMAL(38,2) AS rate FROM r WHERE p_partkey % 3 < 2", "x AS (SELECT 1)")
def d6_source_fallback(spark, sf_dir):
    """The first source knows a third of the parts, the second two thirds of the rest's numbers."""
    c = star.ledger(spark, sf_dir).of("commodity").withColumn("meta", F.create_map(F.lit("price"), text("USD:one/A,two/B")))
    k = F.substring("currency", 2, 12).cast("bigint") % 3
    give = lambda part, rate: lambda asked, mode: asked.where(part).select("currency", "quote", F.current_date().alias("date"), F.lit(rate).cast(D2).alias("rate"))
    return route.fetch(route.price_requests(c), {"one": give(k == 0, 1), "two": give(k < 2, 2)}).select("currency", "quote", "rate")


@entry("d7_fetch_modes", "SELECT base, last(rate ORDER BY date)::DECIMAL(38,4) AS latest, (last(rate ORDER BY date) FILTER (WHERE date <= DATE '1997-06-30'))::DECIMAL(38,4) AS at, count(*) FILTER (WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') AS n FROM prices GROUP BY base", PRICES)
def d7_fetch_modes(spark, sf_dir):
    """The latest quote of a saved table, that of a day, and a range of days."""
    from ledgerlake.sources.statements import quotes

    p = star.prices(spark, sf_dir)
    r = lambda df, name: df.select("base", F.col("rate").cast("decimal(38,4)").alias(name))
    n = quotes(p, "range", "1996-12-31", "1996-01-01").groupBy("base").agg(F.count("*").alias("n"))
    return r(quotes(p), "latest").join(r(quotes(p, "at", "1997-06-30"), "at"), "base", "left").join(n, "base", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


# --- statements, importing --------------------------------------------------------------------------


def _statement(spark, sf_dir) -> str:
    """Orders as a bank's CSV files with a banner, in the shared folder: German dates, thousands, negatives in parentheses."""
    from ledgerlake.sources import work

    o = star.table(spark, sf_dir, "orders")
    n = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    cell = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", F.date_format("o_orderdate", "dd.MM.yyyy"), cell(F.concat(F.lit('Cust "'), F.col("o_custkey").cast("string"), F.lit('", Inc'))), "o_orderpriority", cell(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), n, F.lit(")"))).when(F.col("o_orderstatus") == "P", "-").otherwise(n)), F.col("o_orderkey").cast("string"))
    # a file per 1,000 order numbers: each has its banner and header
    files = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("f")).agg(F.concat_ws("\n", F.lit("Bank of X"), F.lit(""), F.lit("Date,Payee,Description,Amount,Ref"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("text"))
    path = work.folder(spark, "statement")
    files.repartition("f").write.partitionBy("f").text(path)
    return path


CONFIG = {"name": "bank", "date": "Date", "date_format": "%d.%m.%Y", "amount": "Amount", "payee": "Payee", "narration": ["Description", "Ref"], "header": ["Date", "Payee", "Description", "Amount", "Ref"], "currency": "USD", "account": "Assets:Bank", "counter": "Expenses:Unknown", "exclude": [{"column": "Description", "regex": "^5"}]}
BANK = "bank AS (SELECT o_orderkey, o_orderdate::DATE AS date, 'Cust \"' || o_custkey || '\", Inc' AS payee, o_orderpriority, (CASE WHEN o_orderstatus = 'F' THEN -1 WHEN o_orderstatus = 'P' THEN NULL ELSE 1 END * o_totalprice::DECIMAL(18,2)) AS n FROM orders WHERE o_orderpriority NOT LIKE '5%')"


def _imported(spark, sf_dir):
    from ledgerlake.operators import importing

    p = importing.dispatch("a/bank.csv", [("other", None), (r"bank\.csv$", importing.from_config(CONFIG))])
    return p.run(p.read(spark, _statement(spark, sf_dir)))


@entry("i2_csv_import", "SELECT date, payee, o_orderpriority || ' ' || o_orderkey AS narration, account, (n * sign)::DECIMAL(38,2) AS n, 'USD' AS currency FROM bank, (VALUES ('Assets:Bank', 1), ('Expenses:Unknown', -1)) AS v(account, sign) WHERE n IS NOT NULL", BANK)
def i2_csv_import(spark, sf_dir):
    """Files dispatched, read past their banner, filtered, and made transactions of two legs."""
    tx, _ = _imported(spark, sf_dir)
    return tx.select("date", "payee", "narration", F.explode("postings").alias("p")).select("date", "payee", "narration", "p.account", F.col("p.amount.number").cast(D2).alias("n"), F.col("p.amount.currency").alias("currency"))


@entry("i2_row_diagnostics", "SELECT 'error' AS severity, 'no value' AS message, count(*) AS n FROM bank WHERE n IS NULL GROUP BY ALL", BANK)
def i2_row_diagnostics(spark, sf_dir):
    """Rows whose amount is a placeholder."""
    return _imported(spark, sf_dir)[1].groupBy("severity", "message").agg(F.count("*").alias("n"))


@entry("i7_row_hash", "SELECT o_orderkey::VARCHAR AS ref, substring(sha256('bank' || chr(30) || strftime(date, '%d.%m.%Y') || chr(30) || payee || chr(30) || o_orderpriority || chr(30) || CASE WHEN n < 0 THEN '(' || format('{:,.2f}', -n::DOUBLE) || ')' ELSE format('{:,.2f}', n::DOUBLE) END || chr(30) || o_orderkey), 1, 16) AS row_hash FROM bank WHERE n IS NOT NULL", BANK)
def i7_row_hash(spark, sf_dir):
    return _imported(spark, sf_dir)[0].select(F.element_at(F.split("narration", " "), -1).alias("ref"), "row_hash")


@entry("i10_hooks", "SELECT size, source, keep, counter, count(*) AS n FROM (SELECT 2 AS size, 'statement' AS source, TRUE AS keep, CASE WHEN o_orderpriority LIKE '1%' THEN 'Expenses:Urgent' WHEN o_orderpriority LIKE '%LOW' OR o_orderpriority LIKE '2%' THEN 'Expenses:Later' END AS counter FROM bank WHERE n IS NOT NULL) GROUP BY ALL", BANK)
def i10_hooks(spark, sf_dir):
    """A chain of hooks: the counter leg goes and comes back (BalanceWith), metadata is stamped, rules classify."""
    from ledgerlake.operators import importing, predict

    bare = lambda df: df.withColumn("postings", F.slice("postings", 1, 1))
    rules = lambda df: predict.classify(df, [("narration", "^1", "Expenses:Urgent"), ("narration", "LOW|^2", "Expenses:Later")])
    tx = importing.chain(bare, importing.balance_with("Equity:Suspense"), importing.stamp_metadata(source="statement"), rules)(_imported(spark, sf_dir)[0])
    keep = F.get("postings", 1)["account"] == "Equity:Suspense"
    return tx.groupBy(F.size("postings").alias("size"), F.col("meta")["source"].alias("source"), keep.alias("keep"), "counter").agg(F.count("*").alias("n"))


PROGRAM = """
(let* ((d (parse-date (column "Date") "%d.%m.%Y"))
       (a (parse-amount (column "Amount") (or-else (hint "currency") (const "USD")) (number-format "," ".")))
       (part (split (column "Description") (regex "^(?P<level>[0-9])-(?P<word>.*)$")))
       (acct (map-value (group part "level") (dict "1" "Expenses:One" "2" "Expenses:Two"))))
  (when (and (not (empty? (column "Amount"))) (negative? a)) (emit-transaction :date d :payee (trim (column "Payee")) :narration (template "{w} {n}" (bindings (w (group part "word")) (n (column "Ref"))))
      :tags (tags (group part "level")) :meta (meta "ref" (column "Ref"))
      :postings (postings (double-entry "Assets:Bank" (coalesce acct "Expenses:Other") (scale-amount a 2))))))
"""


@entry("i6_program", "SELECT date, payee, regexp_replace(o_orderpriority, '^[0-9]-', '') || ' ' || o_orderkey AS narration, o_orderpriority[1:1] AS tag, o_orderkey::VARCHAR AS ref, CASE WHEN o_orderpriority LIKE '1%' THEN 'Expenses:One' WHEN o_orderpriority LIKE '2%' THEN 'Expenses:Two' ELSE 'Expenses:Other' END AS counter, (-2 * n)::DECIMAL(38,2) AS n FROM (SELECT o_orderkey, o_orderdate::DATE AS date, 'Cust \"' || o_custkey || '\", Inc' AS payee, o_orderpriority, -(o_totalprice::DECIMAL(18,2)) AS n FROM orders WHERE o_orderstatus = 'F')", "")
def i6_program(spark, sf_dir):
    """An S-expression program over the statement's records (I4: predicates; I5: constructors)."""
    from ledgerlake.operators import importing
    from ledgerlake.sources.statements import Reader

    rows = Reader(header=tuple(CONFIG["header"])).records(spark, _statement(spark, sf_dir))
    tx = importing.Program(PROGRAM).run(rows, "program")
    leg = F.get("postings", 1)
    return tx.select("date", "payee", "narration", F.get("tags", 0).alias("tag"), F.col("meta")["ref"].alias("ref"), leg["account"].alias("counter"), leg["amount"]["number"].cast(D2).alias("n"))


@entry("i13_tokens", "SELECT c_custkey AS k, t AS term FROM customer, LATERAL (SELECT unnest(['customer', '<n>', lower(c_mktsegment)]) AS t)", "")
def i13_tokens(spark, sf_dir):
    from ledgerlake.operators import predict

    c = star.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.explode(predict.tokens(F.concat_ws(" ", "c_name", "c_mktsegment"))).alias("term"))


@entry("s10_rates", "SELECT o_orderdate::DATE AS date, 'EUR' AS base, 'C' || o_orderpriority[1:1] AS quote, (round(sum(o_totalprice::DECIMAL(18,2)), 0) / 100)::DECIMAL(38,4) AS rate FROM orders GROUP BY ALL", "")
def s10_rates(spark, sf_dir):
    """Saved rate files of the central bank's form, a currency per priority: read back."""
    from ledgerlake.sources import statements, work

    o = star.table(spark, sf_dir, "orders")
    r = o.groupBy(F.to_date("o_orderdate").alias("d"), F.substring("o_orderpriority", 1, 1).alias("q")).agg((F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 0) / 100).cast("decimal(18,4)").alias("r"))
    cubes = r.groupBy("d").agg(F.array_join(F.collect_list(F.concat(F.lit('<Cube currency="C'), "q", F.lit('" rate="'), F.col("r").cast("string"), F.lit('"/>'))), "").alias("c"))
    year = cubes.groupBy(F.year("d").alias("y")).agg(F.concat(F.lit('<e:Envelope xmlns:e="g" xmlns="x"><Cube>'), F.array_join(F.collect_list(F.concat(F.lit('<Cube time="'), F.col("d").cast("string"), F.lit('">'), "c", F.lit("</Cube>"))), ""), F.lit("</Cube></e:Envelope>")).alias("text"))
    path = work.folder(spark, "rates")
    year.repartition(16, "y").select("y", "text").write.partitionBy("y").text(path)
    return statements.ecb_quotes(spark, f"{path}/*").select("date", "base", "quote", F.col("rate").cast("decimal(38,4)").alias("rate"))


# --- sinks and ledger text --------------------------------------------------------------------------

LINES = ", l AS (SELECT date, o_orderkey AS k, account, number, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, idx) AS n, flag, payee, narration, tag FROM post)"
NUMBER = "rtrim(rtrim(number::VARCHAR, '0'), '.')"


@entry("k4_ledger_printer", LINES + f", t AS (SELECT strftime(date, '%Y-%m-%d') || ' ' || flag || ' \"' || payee || '\" \"' || narration || '\" #' || tag || chr(10) || string_agg('  ' || account || '  ' || {NUMBER} || ' USD', chr(10) ORDER BY n) || chr(10) AS text, date FROM l GROUP BY k, date, flag, payee, narration, tag) SELECT date, text FROM t UNION ALL SELECT o_orderdate::DATE, strftime(o_orderdate::DATE, '%Y-%m-%d') || ' ' || CASE WHEN o_orderstatus = 'F' THEN '*' ELSE '!' END || ' \"' || c_name || '\" \"' || o_orderpriority || '\" #' || c_mktsegment || chr(10) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def k4_ledger_printer(spark, sf_dir):
    """Every transaction as ledger text."""
    from ledgerlake.sources import sinks

    led = star.ledger(spark, sf_dir)
    return sinks.entry_text(plugins.changed(led, led.of("transaction"))).select("date", "text")


@entry("s1_read_files", "SELECT date, account, number::DECIMAL(38,2) AS number, currency, narration AS text FROM post")
def s1_read_files(spark, sf_dir):
    """The ledger written as text files, one or more a year, and parsed on the executors."""
    from ledgerlake.sources import sinks, work
    from ledgerlake.sources.text import read_files

    led = star.ledger(spark, sf_dir)
    path = work.folder(spark, "ledger")
    rows = sinks.entry_text(plugins.changed(led, led.of("transaction")))
    rows.repartitionByRange(16, "date", "seq").sortWithinPartitions("seq").select("text").write.option("maxRecordsPerFile", 20_000).text(path)
    return read_files(spark, path).where("type = 'transaction'").select("date", "account", F.col("number").cast(D2).alias("number"), "currency", "text")


TEXT_SQL = "nat AS (SELECT n_nationkey, replace(n_name, ' ', '-') AS name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _nation_text(spark, sf_dir) -> str:
    """A ledger of 25 nations: arithmetic, tags pushed and popped, a broken line, commented-out transactions."""
    n = star.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows, whatever the scale
    out = ['option "title" "Nations"', "2000-01-01 open Assets:Bank", "pushtag #all"]
    for r in n:
        k, name = r["n_nationkey"], r["n_name"].replace(" ", "-").title()
        out += [f"2000-01-01 open Expenses:{name}", f'2001-02-{1 + k:02d} * "{name}" "n {k}" ^l{k}', f"  Expenses:{name}  ({k} + 1) * 2.5 USD", f"  Assets:Bank  -{k + 1} * 2.50 USD"]
        if k % 5 == 0:
            out += [f"2001-03-{1 + k:02d} opne Expenses:{name}", f'; 2001-04-{1 + k:02d} * "out" "commented"', f";   Expenses:{name}  1 USD", ";   Assets:Bank  -1 USD"]
    return "\n".join([*out, "poptag #all", '2001-12-31 * "end"', "  Assets:Bank  1/3 USD", "  Expenses:Egypt", ""])


@entry("s5_parser", "SELECT 'n ' || n_nationkey AS narration, make_date(2001, 2, (1 + n_nationkey)::INT) AS date, 'Expenses:' || array_to_string(list_transform(string_split(replace(n_name, ' ', '-'), '-'), lambda x: upper(x[1:1]) || lower(x[2:])), '-') AS account, ((n_nationkey + 1) * 2.5)::DECIMAL(38,2) AS n, 'all' AS tag, 'l' || n_nationkey AS link, 5::BIGINT AS bad FROM nation", "")
def s5_parser(spark, sf_dir):
    """Lines that can't be read are diagnostics, the rest is read: arithmetic, tags, links."""
    from ledgerlake.sources import text as source

    led = source.load_text(spark, _nation_text(spark, sf_dir))
    p = led.postings.where("account like 'Expenses:%' and narration like 'n %'")
    return p.select("narration", "date", "account", F.col("number").cast(D2).alias("n"), F.get("tags", 0).alias("tag"), F.get("links", 0).alias("link"), F.lit(led.diagnostics.where("severity = 'error'").count()).cast("long").alias("bad"))


@entry("s12_commented", "SELECT make_date(2001, 4, (1 + n_nationkey)::INT) AS date, 'out' AS payee, 2::BIGINT AS legs FROM nation WHERE n_nationkey % 5 = 0", "")
def s12_commented(spark, sf_dir):
    from ledgerlake.sources import text as source

    led = source.load_text(spark, source.commented(_nation_text(spark, sf_dir)))
    return led.postings.groupBy("date", "payee", "seq").agg(F.count("*").alias("legs")).drop("seq")


@entry("s3_include_glob", "SELECT 'Assets:' || array_to_string(list_transform(string_split(replace(r_name, ' ', '-'), '-'), lambda x: upper(x[1:1]) || lower(x[2:])), '-') AS account, (count(*) + CASE WHEN r_name = 'ASIA' THEN 100 ELSE 0 END)::BIGINT AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' GROUP BY r_name", "")
def s3_include_glob(spark, sf_dir):
    """A root file includes those of the regions by a pattern; Asia's unsaved text (overlay) counts, not its file."""
    import os
    import tempfile

    from ledgerlake.sources import text as source

    n, r = star.table(spark, sf_dir, "nation"), star.table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count("*").alias("n")).collect()  # 5 rows
    with tempfile.TemporaryDirectory() as top:  # includes are resolved and read on the driver
        write = lambda name, body: open(os.path.join(top, name), "w").write(body)  # noqa: E731, SIM115
        body = lambda name, n: f'2000-01-02 * "x"\n  Assets:{name}  {n} USD\n  Equity:All  -{n} USD\n'
        os.makedirs(os.path.join(top, "sub/deep"))
        write("main.ledger", 'include "sub/**/r-[!e]*.ledger"\ninclude "sub/none?.ledger"\n')
        over = {}
        for x in rows:
            name = x["r_name"].replace(" ", "-").title()
            path = f"sub/{'deep/' if x['r_name'] == 'ASIA' else ''}r-{name.lower()}.ledger"
            write(path, body(name, x["n"]))
            if x["r_name"] == "ASIA":
                over[os.path.join(top, path)] = body(name, x["n"] + 100)
        led = source.load_file(spark, os.path.join(top, "main.ledger"), over)
        got = [(p["account"], int(p["number"])) for p in led.postings.where("account like 'Assets:%'").collect()]
    return spark.createDataFrame(got, "account string, n long")


@entry("k1_text_table", """, g AS (SELECT account, sum(number)::VARCHAR AS n FROM post GROUP BY account), t AS (SELECT account, rtrim(rtrim(n, '0'), '.') AS n FROM g), w AS (SELECT greatest(7, max(length(account))) AS a, greatest(5, max(length(n))) AS b FROM t)
SELECT rtrim(rpad(account, a::INT, ' ') || '  ' || lpad(n, b::INT, ' ')) AS line FROM t, w UNION ALL SELECT rpad('account', a::INT, ' ') || '  ' || lpad('total', b::INT, ' ') FROM w UNION ALL SELECT repeat('-', a::INT) || '  ' || repeat('-', b::INT) FROM w""")  # fmt: skip
def k1_text_table(spark, sf_dir):
    """The lines of the text table, a row per account."""
    from ledgerlake.sources import sinks

    lines = sinks.text_lines(query(star.ledger(spark, sf_dir), "SELECT account, sum(number) AS total GROUP BY account"))
    return spark.createDataFrame([(x,) for x in lines], "line string")


@entry("k2_csv", "SELECT account, rtrim(rtrim(sum(number)::VARCHAR, '0'), '.') || ' USD' AS p, min(tag) || CASE WHEN max(tag) <> min(tag) THEN '' ELSE '' END AS t, CASE WHEN sum(number) > 0 THEN 'TRUE' ELSE 'FALSE' END AS b, '' AS z, rtrim(rtrim(sum(number)::VARCHAR, '0'), '.') AS n FROM post GROUP BY account, tag")
def k2_csv(spark, sf_dir):
    """Cells as they stand in CSV: inventories, sets, bools, NULL and numbers."""
    from ledgerlake.sources import sinks

    return sinks.csv_cells(query(star.ledger(spark, sf_dir), "SELECT account, sum(position) AS p, tags AS t, sum(number) > 0 AS b, max(posting_flag) AS z, sum(number) AS n GROUP BY account, tags"))


@entry("k3_json", f"""SELECT '{{"date":"' || strftime(date, '%Y-%m-%d') || '","account":"' || account || '","position":{{"units":{{"number":"' || {NUMBER} || '","currency":"USD"}},"cost":null}},"tags":["' || tag || '"],"number":"' || {NUMBER} || '","posting_flag":null}}' AS value FROM post""")
def k3_json(spark, sf_dir):
    from ledgerlake.sources import sinks

    return sinks.json_rows(query(star.ledger(spark, sf_dir), "SELECT date, account, position, tags, number, posting_flag"))


@entry("k6_price_lines", "SELECT strftime(date, '%Y-%m-%d') || ' price ' || base || ' ' || rtrim(rtrim(rate::VARCHAR, '0'), '.') || ' USD' AS value FROM prices", PRICES)
def k6_price_lines(spark, sf_dir):
    """Prices written as a price file, and the file's lines."""
    from ledgerlake.sources import sinks, work

    path = work.folder(spark, "prices")
    sinks.write_prices(star.prices(spark, sf_dir), path)
    return spark.read.text(path)


@entry("k7_routed_files", "SELECT split_part(account, ':', 3) || '-' || strftime(date, '%Y') AS path, count(*) AS n, min(date) AS first, max(date) AS last, TRUE AS sorted FROM post GROUP BY ALL")
def k7_routed_files(spark, sf_dir):
    """Postings routed to folders, written in the order of their dates, and read back."""
    from ledgerlake.sources import sinks, work

    p = star.ledger(spark, sf_dir).postings.select("seq", "date", F.regexp_replace("account", "^[^:]*:[^:]*:", "").alias("account"))
    path = work.folder(spark, "routed")
    sinks.write_routed(route.route(p, "{root}-{yyyy}"), path)
    # in order within a folder: every day's last place is before the next day's first
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    days = spark.read.parquet(path).select("path", "date", place.alias("at")).groupBy("path", "date").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    days = days.withColumn("ok", F.coalesce(F.lag("hi").over(Window.partitionBy("path").orderBy("date")) < F.col("lo"), F.lit(True)))
    return days.groupBy("path").agg(F.sum("n").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("ok").alias("sorted"))
