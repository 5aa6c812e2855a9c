"""The queries over the star-schema ledger with equivalent SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.model import ENTRIES, Ledger, conform
from ledgerlake.operators import booking, dedup, hierarchy, plugins, predict, prices, route, validate
from ledgerlake.plans.compiler import plain, query
from ledgerlake.sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The ledger's tables in SQL, put before each query.
TXN = """txn AS (SELECT o_orderkey, o_orderdate::DATE AS date, CASE WHEN o_orderstatus = 'F' THEN '*' ELSE '!' END AS flag, c_name AS payee, o_orderpriority AS narration, c_mktsegment AS tag FROM orders JOIN customer ON o_custkey = c_custkey)"""
POST = (
    TXN
    + """,
legs AS (SELECT t.*, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, 0 AS idx, 'Assets:Inventory:' || replace(p_brand, '#', '-') AS account, l_extendedprice::DECIMAL(18,2) AS number
  FROM lineitem JOIN txn t ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT t.*, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, 1, 'Liabilities:Payable:' || tag, -(l_extendedprice::DECIMAL(18,2))
  FROM lineitem JOIN txn t ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
post AS (SELECT *, 'USD' AS currency FROM legs)"""
)
LOTS = """lots AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate::DATE AS date, 'Assets:Stock:S' || l_suppkey AS account,
  CASE WHEN l_returnflag = 'R' THEN -(l_quantity::DECIMAL(18,2)) ELSE l_quantity::DECIMAL(18,2) END AS number, 'P' || l_partkey AS currency,
  __UNIT__ AS cost, l_suppkey::VARCHAR AS label,
  CASE WHEN l_returnflag = 'R' THEN p_retailprice::DECIMAL(18,2) END AS price FROM lineitem JOIN part ON l_partkey = p_partkey)"""
UNIT = "(((l_extendedprice::DECIMAL(18,2) * 100)::HUGEINT * 20000 + (l_quantity::DECIMAL(18,2) * 100)::HUGEINT) // ((l_quantity::DECIMAL(18,2) * 100)::HUGEINT * 2) / 10000.0::DECIMAL(18,4))::DECIMAL(18,4)"


def entry(name: str, sql: str | None = None, base: str = POST):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = f"WITH {base}\n{sql}" if base else sql
        return f

    return add


def bql(name: str, text: str, sql: str, base: str = POST, lots: bool = False, cast: dict[str, str] | None = None) -> None:
    """A query-language statement; ``cast`` gives output columns a fixed type in both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plain(query(star.ledger(spark, sf_dir, lots), text))
        return df.withColumns({c: F.col(c).cast(t) for c, t in (cast or {}).items()})

    entry(name, sql, base)(run)


D2 = "decimal(38,2)"
bql("q8_group_by", "SELECT account, sum(number) AS total, count(number) AS n GROUP BY account ORDER BY account", "SELECT account, sum(number)::DECIMAL(38,2) AS total, count(number) AS n FROM post GROUP BY account", cast={"total": D2})
bql("q1_default_table", "SELECT id, account, number", "SELECT o_orderkey::VARCHAR AS id, account, number::DECIMAL(38,2) AS number FROM post", cast={"number": D2})
bql("q2_from_predicate", "SELECT account, count(number) AS n FROM year = 1997 WHERE flag = '*' GROUP BY account", "SELECT account, count(*) AS n FROM post WHERE year(date) = 1997 AND flag = '*' GROUP BY account")
bql("q4_close_on", "SELECT account, sum(number) AS total FROM CLOSE ON 1997-06-01 GROUP BY account", "SELECT account, sum(number)::DECIMAL(38,2) AS total FROM post WHERE date < DATE '1997-06-01' GROUP BY account", cast={"total": D2})
bql("q6_projection", "SELECT date, payee AS who, number * 2 AS twice, account WHERE number < -90000", "SELECT date, payee AS who, (number * 2)::DECIMAL(38,2) AS twice, account FROM post WHERE number < -90000", cast={"twice": D2})
bql("q9_global_aggregate", "SELECT sum(number) AS total, count(number) AS n WHERE number > 1000000000", "SELECT coalesce(sum(number), 0)::DECIMAL(38,2) AS total, count(number) AS n FROM post WHERE number > 1000000000", cast={"total": D2})
bql("q10_having", "SELECT account, sum(number) AS total GROUP BY account HAVING count(number) > 250", "SELECT account, sum(number)::DECIMAL(38,2) AS total FROM post GROUP BY account HAVING count(number) > 250", cast={"total": D2})
bql("q12_distinct", "SELECT DISTINCT account, year, flag", "SELECT DISTINCT account, year(date) AS year, flag FROM post")
bql("q13_order_by", "SELECT account, year, sum(number) AS total GROUP BY account, year ORDER BY total DESC, account, year LIMIT 25", "SELECT account, year(date) AS year, sum(number)::DECIMAL(38,2) AS total FROM post GROUP BY ALL ORDER BY total DESC NULLS FIRST, account, year LIMIT 25", cast={"total": D2})
bql("q14_limit", "SELECT date, id, account, number LIMIT 20", "SELECT date, o_orderkey::VARCHAR AS id, account, number::DECIMAL(38,2) AS number FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, idx ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rk FROM post) ORDER BY date, o_orderkey, rk, idx LIMIT 20", cast={"number": D2})
bql("q15_journal", "JOURNAL AT units", """, j AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, idx ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rk FROM post),
k AS (SELECT *, sum(number) OVER (ORDER BY date, o_orderkey, rk, idx ROWS UNBOUNDED PRECEDING) AS bal FROM j)
SELECT date, flag, payee AS maxwidth, narration AS maxwidth_3, account, rtrim(rtrim(number::VARCHAR, '0'), '.') || ' USD' AS units, CASE WHEN bal = 0 THEN '()' ELSE '(' || rtrim(rtrim(bal::VARCHAR, '0'), '.') || ' USD)' END AS units_6 FROM k""")
bql("q16_balances", "BALANCES FROM year = 1996", "SELECT account, '(' || rtrim(rtrim(sum(number)::VARCHAR, '0'), '.') || ' USD)' AS sum FROM post WHERE year(date) = 1996 GROUP BY account")
bql("q18_running_balance", "SELECT id, account, number, number(only('USD', balance)) AS bal", """SELECT o_orderkey::VARCHAR AS id, account, number::DECIMAL(38,2) AS number, sum(number) OVER (ORDER BY date, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, idx ROWS UNBOUNDED PRECEDING)::DECIMAL(38,2) AS bal FROM post""", cast={"number": D2, "bal": D2})
bql("e1_arithmetic", "SELECT id, number + 1 AS a, number - 0.5 AS b, -number AS c, year % 10 AS d", "SELECT o_orderkey::VARCHAR AS id, (number + 1)::DECIMAL(38,2) AS a, (number - 0.5)::DECIMAL(38,2) AS b, (-number)::DECIMAL(38,2) AS c, year(date) % 10 AS d FROM post", cast={"a": D2, "b": D2, "c": D2})
bql("e2_division", "SELECT id, round(number / 4, 2) AS a, year / 4 AS b", "SELECT o_orderkey::VARCHAR AS id, round_even((number / 4)::DECIMAL(28,8), 2)::DECIMAL(38,2) AS a, (year(date) * 100 // 4 / 100.0)::DECIMAL(38,2) AS b FROM post", cast={"a": D2, "b": D2})
bql("e5_comparison", "SELECT id, number > 50000 AS a, date < 1996-01-01 AS b, account != 'x' AS c", "SELECT o_orderkey::VARCHAR AS id, number > 50000 AS a, date < DATE '1996-01-01' AS b, account <> 'x' AS c FROM post")
bql("e6_regex", "SELECT account, count(number) AS n WHERE account ~ '^Assets:.*-1[0-2]$' GROUP BY account", "SELECT account, count(*) AS n FROM post WHERE regexp_matches(account, '^Assets:.*-1[0-2]$') GROUP BY account")
bql("e7_three_valued", "SELECT count(number) AS n WHERE NOT (narration = '1-URGENT' OR year = 1995) AND (NULL OR TRUE)", "SELECT count(*) AS n FROM post WHERE NOT (narration = '1-URGENT' OR year(date) = 1995)")
bql("e8_in_list", "SELECT narration, count(number) AS n WHERE narration IN ('1-URGENT', '5-LOW') GROUP BY narration", "SELECT narration, count(*) AS n FROM post WHERE narration IN ('1-URGENT', '5-LOW') GROUP BY narration")
bql("e9_in_set", "SELECT account, count(number) AS n WHERE 'BUILDING' IN tags GROUP BY account", "SELECT account, count(*) AS n FROM post WHERE tag = 'BUILDING' GROUP BY account")
bql("e10_between", "SELECT count(number) AS n WHERE date BETWEEN 1996-01-01 AND 1996-12-31 AND number NOT BETWEEN 0 AND 1000", "SELECT count(*) AS n FROM post WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND NOT (number BETWEEN 0 AND 1000)")
bql("e11_is_null", "SELECT count(account) AS n WHERE posting_flag IS NULL AND payee IS NOT NULL", "SELECT count(account) AS n FROM post")
bql("a1_count", "SELECT account, count(number) AS n, count(posting_flag) AS z GROUP BY account", "SELECT account, count(number) AS n, 0::BIGINT AS z FROM post GROUP BY account")
bql("a2_sum_int", "SELECT account, sum(year) AS y GROUP BY account", "SELECT account, sum(year(date))::BIGINT AS y FROM post GROUP BY account")
bql("a4_sum_position", "SELECT account, sum(position) AS p GROUP BY account", "SELECT account, '(' || rtrim(rtrim(sum(number)::VARCHAR, '0'), '.') || ' USD)' AS p FROM post GROUP BY account")
bql("a4_sum_position_lots", "SELECT account, count(number) AS n, number(only('P7', sum(units(position)))) AS p GROUP BY account", "SELECT account, count(*) AS n, coalesce(sum(number) FILTER (WHERE currency = 'P7'), 0)::DECIMAL(38,2) AS p FROM lots GROUP BY account", LOTS.replace("__UNIT__", "0"), True, {"p": D2})
bql("a6_min_max", "SELECT account, min(number) AS lo, max(date) AS hi, max(payee) AS p GROUP BY account", "SELECT account, min(number)::DECIMAL(38,2) AS lo, max(date) AS hi, max(payee) AS p FROM post GROUP BY account", cast={"lo": D2})
_ORD = "date, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
bql("a7_first_last", "SELECT account, first(id) AS f, last(number) AS l GROUP BY account", f"SELECT account, first(o_orderkey ORDER BY {_ORD})::VARCHAR AS f, last(number ORDER BY {_ORD})::DECIMAL(38,2) AS l FROM post GROUP BY account", cast={"l": D2})
bql("f_date", "SELECT DISTINCT date, year(date) AS y, month(date) AS m, day(date) AS d, weekday(date) AS w, weekday_name(date) AS wn, quarter(date) AS q, quarter_index(date) AS qi, yearmonth(date) AS ym, yearmonth_str(date) AS ys, date_add(date, 30) AS a, date_diff(date, 1995-01-01) AS df",
    "SELECT DISTINCT date, year(date) AS y, month(date) AS m, day(date) AS d, strftime(date, '%a') AS w, strftime(date, '%A') AS wn, year(date) || '-Q' || quarter(date) AS q, quarter(date) AS qi, date_trunc('month', date)::DATE AS ym, strftime(date, '%Y-%m') AS ys, (date + 30)::DATE AS a, date - DATE '1995-01-01' AS df FROM post")
bql("f_date_parts", "SELECT DISTINCT date, date_trunc('week', date) AS tw, date_trunc('decade', date) AS td, date_trunc('century', date) AS tc, date_part('dow', date) AS pd, date_part('isodow', date) AS pi, date_part('week', date) AS pw, date_part('isoyear', date) AS py, date_part('century', date) AS pc, date_part('epoch', date) AS pe, date_part('nope', date) AS pn",
    "SELECT DISTINCT date, date_trunc('week', date)::DATE AS tw, date_trunc('decade', date)::DATE AS td, make_date((year(date) - (year(date) - 1) % 100)::INT, 1, 1) AS tc, isodow(date) - 1 AS pd, isodow(date) AS pi, week(date) AS pw, isoyear(date) AS py, (year(date) + 99) // 100 AS pc, epoch(date)::BIGINT AS pe, NULL::BIGINT AS pn FROM post")
bql("f_date_bin_days", "SELECT DISTINCT date, date_bin('10 days', date, 1995-01-01) AS b", "SELECT DISTINCT date, (DATE '1995-01-01' + ((date - DATE '1995-01-01') // 10 * 10)::INT)::DATE AS b FROM post")
bql("f_string", "SELECT DISTINCT payee, upper(narration) AS u, lower(narration) AS l, length(payee) AS n, substr(payee, 2, 5) AS s, grep('[0-9]+', payee) AS g, grepn('#0*([0-9]+)', payee, 1) AS gn, subst('[0-9]', 'x', payee) AS sb, splitcomp(account, ':', 1) AS c, joinstr(tags) AS j",
    "SELECT DISTINCT payee, upper(narration) AS u, lower(narration) AS l, length(payee) AS n, substring(payee, 3, 5) AS s, regexp_extract(payee, '[0-9]+') AS g, regexp_extract(payee, '#0*([0-9]+)', 1) AS gn, regexp_replace(payee, '[0-9]', 'x', 'g') AS sb, split_part(account, ':', 2) AS c, tag AS j FROM post")
bql("f_account", "SELECT DISTINCT account, root(account) AS r, root(account, 2) AS r2, parent(account) AS p, leaf(account) AS l, account_sortkey(account) AS k, has_account('Nope') AS h",
    "SELECT DISTINCT account, split_part(account, ':', 1) AS r, split_part(account, ':', 1) || ':' || split_part(account, ':', 2) AS r2, regexp_replace(account, ':[^:]*$', '') AS p, split_part(account, ':', 3) AS l, CASE WHEN account LIKE 'Assets%' THEN '0:' ELSE '1:' END || account AS k, FALSE AS h FROM post")
bql("f_open_date", "SELECT DISTINCT account, open_date(account) AS o, close_date(account) AS c", "SELECT account, CASE WHEN account NOT LIKE '%1' THEN min(date) END AS o, NULL::DATE AS c FROM post GROUP BY account")
bql("f_math", "SELECT id, abs(number) AS a, neg(number) AS n, safediv(number, 0) AS s, round(number, -2) AS r, possign(number, account) AS p", "SELECT o_orderkey::VARCHAR AS id, abs(number)::DECIMAL(38,2) AS a, (-number)::DECIMAL(38,2) AS n, 0::DECIMAL(38,2) AS s, (round_even(number::DOUBLE / 100, 0) * 100)::DECIMAL(38,2) AS r, (CASE WHEN idx = 1 THEN -number ELSE number END)::DECIMAL(38,2) AS p FROM post", cast={c: D2 for c in "ansrp"})
bql("f_cast", "SELECT DISTINCT narration, int(substr(narration, 0, 1)) AS i, decimal(substr(narration, 0, 1)) AS d, bool(narration) AS b, str(year) AS s, date('1999-02-03') AS t, date('x') AS x, date(2000, 1, 2) AS m", "SELECT DISTINCT narration, narration[1:1]::BIGINT AS i, narration[1:1]::DECIMAL(38,2) AS d, TRUE AS b, year(date)::VARCHAR AS s, DATE '1999-02-03' AS t, NULL::DATE AS x, DATE '2000-01-02' AS m FROM post", cast={"d": D2})
bql("f_value", "SELECT id, number(position) AS n, currency(position) AS c, number(cost(position)) AS k, number(units(position)) AS u", "SELECT l_orderkey::VARCHAR AS id, number::DECIMAL(38,2) AS n, currency AS c, (number * cost)::DECIMAL(38,2) AS k, number::DECIMAL(38,2) AS u FROM lots", LOTS.replace("__UNIT__", UNIT), True, {c: D2 for c in "nku"})
bql("q5_clear_scope", "SELECT account, count(number) AS n, sum(number) AS s FROM CLOSE ON 1998-01-01 CLEAR GROUP BY account", "SELECT account, count(*) AS n, sum(number)::DECIMAL(38,2) AS s FROM post WHERE date < DATE '1998-01-01' GROUP BY account", cast={"s": D2})
bql("r1_open_on", "SELECT account, sum(number) AS s FROM OPEN ON 1998-01-01 GROUP BY account", """, o AS (SELECT account, sum(number) AS number FROM post WHERE date < DATE '1998-01-01' GROUP BY account HAVING sum(number) <> 0),
u AS (SELECT account, number FROM o UNION ALL SELECT 'Equity:Opening-Balances', -number FROM o UNION ALL SELECT account, number FROM post WHERE date >= DATE '1998-01-01')
SELECT account, sum(number)::DECIMAL(38,2) AS s FROM u GROUP BY account""", cast={"s": D2})  # fmt: skip
bql("s8_events_table", "SELECT type, date, count(description) AS n FROM events GROUP BY type, date", "SELECT event_type AS type, ts::DATE AS date, count(props) AS n FROM events GROUP BY ALL", "")
bql("s8_commodities_table", "SELECT count(currency) AS n, max(currency) AS m FROM commodities", "SELECT count(*) AS n, max('P' || p_partkey) AS m FROM part", "")
bql("s8_transactions_table", "SELECT date, flag, payee, narration, description FROM transactions", "SELECT date, flag, payee, narration, payee || ' | ' || narration AS description FROM txn", TXN)
bql("s8_entries_table", "SELECT type, count(id) AS n FROM entries WHERE type = 'transaction' GROUP BY type", "SELECT 'transaction' AS type, count(*) AS n FROM txn", TXN)

# --- joins, windows, validation and plugins over the star ledger ------------------------------------

PRICES = f"prices AS (SELECT 'P' || l_partkey AS base, l_shipdate::DATE AS date, last({UNIT} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rate FROM lineitem GROUP BY ALL)"


@entry("j3_asof_price", """SELECT o.k, o.date, o.base, p.rate::DECIMAL(38,4) AS rate FROM (SELECT l_orderkey AS k, l_linenumber AS ln, 'P' || l_partkey AS base, o_orderdate::DATE AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey) o
ASOF LEFT JOIN prices p ON o.base = p.base AND o.date >= p.date""", PRICES)  # fmt: skip
def j3_asof_price(spark, sf_dir):
    li, o = star.table(spark, sf_dir, "lineitem"), star.table(spark, sf_dir, "orders")
    asks = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("k"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("base"), F.to_date("o_orderdate").alias("date"))
    got = prices.asof(asks, prices.daily(star.prices(spark, sf_dir)), ["base"], "date", "rate", "rate")
    return got.select("k", "date", "base", F.col("rate").cast("decimal(38,4)").alias("rate"))


@entry("j3_latest_price", "SELECT base, last(rate ORDER BY date)::DECIMAL(38,4) AS rate FROM prices GROUP BY base", PRICES)
def j3_latest_price(spark, sf_dir):
    return prices.latest(star.prices(spark, sf_dir)).select("base", F.col("rate").cast("decimal(38,4)").alias("rate"))


bql("f_getprice", "SELECT id, getprice(currency, 'USD', date) AS r", "SELECT l_orderkey::VARCHAR AS id, rate::DECIMAL(38,4) AS r FROM lots ASOF LEFT JOIN prices ON lots.currency = prices.base AND lots.date >= prices.date", LOTS.replace("__UNIT__", UNIT) + ", " + PRICES, True, {"r": "decimal(38,4)"})


def _tree(spark, sf_dir):
    """Supplier accounts Assets:Region:Nation:Supplier with their balances as amounts."""
    s, n, r = (star.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    name = F.concat_ws(":", F.lit("Assets"), F.regexp_replace("r_name", " ", "-"), F.regexp_replace("n_name", " ", "-"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    return rows.select(name.alias("account"), F.col("s_acctbal").cast(star.MONEY).alias("number"), "s_suppkey")


TREE = "tree AS (SELECT 'Assets:' || replace(r_name, ' ', '-') || ':' || replace(n_name, ' ', '-') || ':S' || s_suppkey AS account, s_acctbal::DECIMAL(18,2) AS number, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@entry("j4_subtree_balance", """, up AS (SELECT array_to_string(string_split(account, ':')[1:d], ':') AS ancestor, number FROM tree, (VALUES (1), (2), (3), (4)) AS v(d))
SELECT ancestor, sum(number)::DECIMAL(38,2) AS total, count(*) AS n FROM up GROUP BY ancestor""", TREE)  # fmt: skip
def j4_subtree_balance(spark, sf_dir):
    return hierarchy.with_ancestors(_tree(spark, sf_dir)).groupBy("ancestor").agg(F.sum("number").cast("decimal(38,2)").alias("total"), F.count("*").alias("n"))


@entry("j13_inheritmeta", "SELECT account, CASE WHEN account LIKE 'Assets:ASIA%' THEN 'east' ELSE 'world' END AS zone FROM tree", TREE)
def j13_inheritmeta(spark, sf_dir):
    values = spark.createDataFrame([("Assets", "world"), ("Assets:ASIA", "east")], "account string, zone string")
    return hierarchy.nearest(_tree(spark, sf_dir).select("account"), values, "zone")


@entry("j11_leafonly", "SELECT DISTINCT account FROM tree", TREE)
def j11_leafonly(spark, sf_dir):
    """Accounts that have no account below them, among the tree and its nations."""
    t = _tree(spark, sf_dir).select("account")
    every = t.unionByName(t.select(F.array_join(F.slice(F.split("account", ":"), 1, 3), ":").alias("account"))).distinct()
    parents = hierarchy.with_ancestors(every, itself=False).select(F.col("ancestor").alias("account")).distinct()
    return every.join(parents, "account", "left_anti")


@entry("j10_checkcommodity", "SELECT DISTINCT currency FROM lots WHERE l_partkey % 2 = 1 UNION ALL SELECT 'USD'", LOTS.replace("__UNIT__", "0"))
def j10_checkcommodity(spark, sf_dir):
    """Parts of odd numbers have no Commodity; nor has USD, in which prices are."""
    led = star.ledger(spark, sf_dir, lots=True)
    some = led.entries.where("type <> 'price' and (type <> 'commodity' or cast(substring(name, 2) as bigint) % 2 = 0)")
    diag = plugins.checkcommodity(plugins.changed(led, some))[1]
    return diag.select(F.regexp_replace("message", "no commodity ", "").alias("currency"))


@entry("j7_inactive", "SELECT account, count(*) AS n FROM (SELECT DISTINCT account, o_orderkey FROM post WHERE account LIKE '%1') GROUP BY account")
def j7_inactive(spark, sf_dir):
    return validate.inactive_accounts(star.ledger(spark, sf_dir)).groupBy("account").agg(F.count("*").alias("n"))


@entry("j12_closetree", "SELECT account, DATE '2002-01-01' AS date FROM (SELECT DISTINCT account FROM post WHERE account LIKE 'Assets:Inventory:%' AND account NOT LIKE '%1')")
def j12_closetree(spark, sf_dir):
    led = star.ledger(spark, sf_dir)
    close = spark.createDataFrame([(1 << 61, "close", "2002-01-01", "Assets:Inventory")], "seq long, type string, date string, account string").withColumn("date", F.to_date("date"))
    led = plugins.changed(led, led.entries.unionByName(conform(close, ENTRIES)))
    return plugins.closetree(led)[0].of("close").where("account <> 'Assets:Inventory'").select("account", "date")


@entry("w2_account_running", "SELECT o_orderkey::VARCHAR AS id, account, number::DECIMAL(38,2) AS number, sum(number) OVER (PARTITION BY account ORDER BY date, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::DECIMAL(38,2) AS balance FROM post")
def w2_account_running(spark, sf_dir):
    from ledgerlake.operators.inventory import running_sum

    p = star.ledger(spark, sf_dir).postings
    got = running_sum(p, ["account", "currency"], ["seq", "idx"], "number", "balance")
    return got.select("id", "account", F.col("number").cast(D2).alias("number"), F.col("balance").cast(D2).alias("balance"))


@entry("w4_noduplicates", """, t AS (SELECT o_orderdate::DATE AS date, row_number() OVER (PARTITION BY o_orderdate::DATE, o_orderpriority, floor(o_totalprice / 50000), o_custkey % 2 ORDER BY o_orderkey) AS n FROM orders)
SELECT date, count(*) AS n FROM t WHERE n > 1 GROUP BY date""", TXN)  # fmt: skip
def w4_noduplicates(spark, sf_dir):
    """Two legs an order, amounts in steps of 50,000: those that repeat an earlier one of their day, leg for leg."""
    o = star.table(spark, sf_dir, "orders")
    n = F.floor(F.col("o_totalprice") / 50000).cast("decimal(18,8)")
    leg = lambda i, account, n: F.struct(F.lit(i).alias("idx"), account.alias("account"), n.alias("number"))
    legs = F.array(leg(0, F.concat(F.lit("Assets:P"), F.substring("o_orderpriority", 1, 1)), n), leg(1, F.concat(F.lit("Equity:C"), (F.col("o_custkey") % 2).cast("string")), -n))
    p = o.select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("date"), F.lit("USD").alias("currency"), F.explode(legs).alias("x")).select("seq", "date", "currency", "x.*")
    led = Ledger(spark, spark.createDataFrame([], ENTRIES), p)
    return plugins.noduplicates(led)[1].groupBy("date").agg(F.count("*").alias("n"))


@entry("v2_balance_check", """, b AS (SELECT account, sum(number) FILTER (WHERE date < DATE '1998-01-01') AS actual FROM post GROUP BY account)
SELECT account, actual::DECIMAL(38,2) AS actual, (actual - 1000)::DECIMAL(38,2) AS discrepancy, abs(actual - 1000) <= 0.01 AS ok FROM b WHERE actual IS NOT NULL""")  # fmt: skip
def v2_balance_check(spark, sf_dir):
    led = star.ledger(spark, sf_dir)
    when = F.lit("1998-01-01").cast("date")
    asks = led.postings.where(F.col("date") < when).select("account").distinct().withColumns({"type": F.lit("balance"), "date": when, "scale": F.lit(2), "amount": F.struct(F.lit(1000).cast("decimal(18,8)").alias("number"), F.lit("USD").alias("currency"))})
    asks = asks.withColumn("seq", star._seq(2, F.col("date"), F.xxhash64("account")))
    led = plugins.changed(led, led.entries.unionByName(conform(asks, ENTRIES)))
    return validate.check_balances(led).select("account", F.col("actual").cast(D2).alias("actual"), F.col("discrepancy").cast(D2).alias("discrepancy"), "ok")


@entry("v7_transaction_balances", "SELECT o_orderkey AS k, sum(number)::DECIMAL(38,2) AS residual, abs(sum(number)) <= 0.005 AS ok FROM (SELECT o_orderkey, number FROM post WHERE idx = 0 UNION ALL SELECT o_orderkey, number * 0.5 FROM post WHERE idx = 1 AND tag = 'BUILDING' UNION ALL SELECT o_orderkey, number FROM post WHERE idx = 1 AND tag <> 'BUILDING') GROUP BY o_orderkey")
def v7_transaction_balances(spark, sf_dir):
    """Half of the building segment's payables is left out, so its orders do not balance."""
    led = star.ledger(spark, sf_dir)
    p = led.postings.withColumn("number", F.when(F.col("account").endswith(":BUILDING"), (F.col("number") * F.lit("0.5").cast("decimal(2,1)"))).otherwise(F.col("number")).cast("decimal(18,8)"))
    got = validate.transaction_balances(plugins.changed(led, None, p))
    return got.join(p.select("seq", "id").distinct(), "seq").select(F.col("id").cast("bigint").alias("k"), F.round("residual", 8).cast(D2).alias("residual"), "ok")


@entry("b1_weight", "SELECT id, w::DECIMAL(38,2) AS w FROM (SELECT l_orderkey::VARCHAR AS id, number * cost AS w FROM lots)", LOTS.replace("__UNIT__", UNIT))
def b1_weight(spark, sf_dir):
    from ledgerlake.plans.tables import weight

    p = star.ledger(spark, sf_dir, lots=True).postings
    return p.select("id", weight()[0].cast(D2).alias("w"))


@entry("b6_realised_gain", "SELECT id, g::DECIMAL(38,2) AS g FROM (SELECT l_orderkey::VARCHAR AS id, (price - cost) * -number AS g FROM lots WHERE price IS NOT NULL)", LOTS.replace("__UNIT__", UNIT))
def b6_realised_gain(spark, sf_dir):
    p = star.ledger(spark, sf_dir, lots=True).postings
    return booking.realised_gains(p).join(p.select("seq", "idx", "id"), ["seq", "idx"]).select("id", F.col("gain").cast(D2).alias("g"))


@entry("p_autoaccounts", "SELECT account, min(date) AS date FROM post WHERE account LIKE '%1' GROUP BY account")
def p_autoaccounts(spark, sf_dir):
    led = star.ledger(spark, sf_dir)
    new = plugins.autoaccounts(led)[0].of("open")
    return new.where(F.col("account").endswith("1")).select("account", "date")


@entry("p_coherentcost", "SELECT account, currency FROM (SELECT account, currency, bool_or(price IS NULL) AS a, bool_or(price IS NOT NULL) AS b FROM lots GROUP BY ALL) WHERE a AND b", LOTS.replace("__UNIT__", "0"))
def p_coherentcost(spark, sf_dir):
    """Lots whose returns are booked without a cost."""
    led = star.ledger(spark, sf_dir, lots=True)
    p = led.postings.withColumn("cost", F.when(F.col("price").isNull(), F.col("cost")))
    d = plugins.coherentcost(plugins.changed(led, None, p))[1]
    return d.select("account", F.substring_index("message", " ", 1).alias("currency"))


@entry("p_onecommodity", "SELECT account FROM lots GROUP BY account HAVING count(DISTINCT currency) > 1", LOTS.replace("__UNIT__", "0"))
def p_onecommodity(spark, sf_dir):
    return plugins.onecommodity(star.ledger(spark, sf_dir, lots=True))[1].select("account")


@entry("p_implicitprices", "SELECT DISTINCT date, currency AS base, CASE WHEN price IS NULL THEN cost ELSE price END::DECIMAL(38,4) AS rate FROM lots", LOTS.replace("__UNIT__", UNIT))
def p_implicitprices(spark, sf_dir):
    return plugins.implied_prices(star.ledger(spark, sf_dir, lots=True).postings).select("date", "base", F.col("rate").cast("decimal(38,4)").alias("rate"))


@entry("p_excludetag", "SELECT account, count(*) AS n FROM post WHERE tag <> 'BUILDING' GROUP BY account")
def p_excludetag(spark, sf_dir):
    return plugins.excludetag(star.ledger(spark, sf_dir), "BUILDING")[0].postings.groupBy("account").agg(F.count("*").alias("n"))


@entry("p_fiscalincomeexpense", "SELECT sum(number)::DECIMAL(38,2) AS actual FROM post WHERE account LIKE 'Assets:%' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def p_fiscalincomeexpense(spark, sf_dir):
    led = star.ledger(spark, sf_dir)
    custom = spark.createDataFrame([(1, "custom", "fiscal", "\x1f".join(["Assets", "1996-01-01", "1996-12-31", "0", "USD"]))], "seq long, type string, name string, value string")
    d = plugins.fiscalincomeexpense(plugins.changed(led, led.entries.unionByName(conform(custom, ENTRIES))))[1]
    return d.select(F.regexp_extract("message", r"is (\S+)$", 1).cast(D2).alias("actual"))


@entry("p_sellgains", "SELECT date, count(*) AS n, sum(p)::DECIMAL(38,2) AS proceeds FROM (SELECT l_orderkey, date, sum(-number * price) AS p FROM lots GROUP BY ALL HAVING bool_and(price IS NOT NULL)) GROUP BY date", LOTS.replace("__UNIT__", "0"))
def p_sellgains(spark, sf_dir):
    """Orders all of whose lots have a sale price: none has a cash leg, so all are reported, with their proceeds."""
    d = plugins.sellgains(star.ledger(spark, sf_dir, lots=True))[1]
    return d.groupBy("date").agg(F.count("*").alias("n"), F.sum(F.regexp_extract("message", r"^proceeds (\S+)", 1).cast(D2)).cast(D2).alias("proceeds"))


@entry("d1_route", "SELECT 'ledger/' || replace(account, ':', '/') || '/' || strftime(date, '%Y') || '.l' AS path, count(*) AS n FROM post GROUP BY ALL")
def d1_route(spark, sf_dir):
    p = star.ledger(spark, sf_dir).postings.select("seq", "account", "date")
    return route.route(p, "ledger/{account}/{yyyy}.l").groupBy("path").agg(F.count("*").alias("n"))


@entry("d1_route_override", "SELECT CASE WHEN account LIKE 'Assets:ASIA:%' THEN 'east.l' ELSE 'all/' || split_part(account, ':', 1) || '.l' END AS path, count(*) AS n FROM tree GROUP BY ALL", TREE)
def d1_route_override(spark, sf_dir):
    t = _tree(spark, sf_dir).withColumns({"date": F.lit(None).cast("date"), "seq": F.col("s_suppkey")})
    over = spark.createDataFrame([("Assets", "all/{root}.l"), ("Assets:ASIA", "east.l")], "account string, template string")
    return route.route(t, "none.l", over).groupBy("path").agg(F.count("*").alias("n"))


@entry("d2_dedup_exact", "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'exact' WHEN o_orderkey % 3 = 1 THEN 'structural' ELSE 'none' END AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", "")
def d2_dedup_exact(spark, sf_dir):
    """A third of the transactions comes again as it is, a third with other texts two days later, a third with other amounts."""
    p = star.ledger(spark, sf_dir).postings.withColumn("seq", F.col("id").cast("bigint")).withColumn("account", F.concat("account", F.lit(":"), F.col("id")))
    k = F.pmod("seq", F.lit(3))
    new = p.withColumns({"narration": F.when(k == 1, "other").otherwise(F.concat(F.lit(" "), "narration")), "date": F.when(k == 1, F.date_add("date", 2)).otherwise(F.col("date")), "number": F.when(k == 2, F.col("number") + 1).otherwise(F.col("number")).cast("decimal(18,8)")})
    return dedup.match(new, p, window=3).select("seq", "kind")


@entry("d9_display_precision", "SELECT currency, max_by(s, n * 10 + s)::INT AS digits FROM (SELECT 'P' || l_partkey AS currency, l_linenumber % 4 AS s, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY currency", "")
def d9_display_precision(spark, sf_dir):
    """Lines of number 0, 1, 2, 3 mod 4 with as many digits: each part's most common, the larger of equally common ones."""
    li = star.table(spark, sf_dir, "lineitem")
    return route.display_precision(li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("currency"), (F.col("l_linenumber") % 4).alias("scale")))


@entry("i12_terms", r"""WITH t AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS term FROM benchmark), d AS (SELECT term, count(DISTINCT item_id) AS df FROM t WHERE term <> '' GROUP BY term)
SELECT term, df, round(ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1, 9) AS idf FROM d""", "")  # fmt: skip
def i12_terms(spark, sf_dir):
    b = star.table(spark, sf_dir, "benchmark")
    terms = b.select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("term")).where("term <> ''")
    w = predict.idf(terms, "item_id", b.count())
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return w.join(df, "term").select("term", "df", F.round("idf", 9).alias("idf"))


@entry("i12_predict")
def i12_predict(spark, sf_dir):
    """The account of orders' first legs predicted from payee and narration: those from mid-1998 on, learned from all before."""
    o, c = star.table(spark, sf_dir, "orders"), star.table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("payee"), F.col("o_orderpriority").alias("narration"), F.lit("Assets:Cash").alias("account"), F.col("o_totalprice").cast("decimal(18,8)").alias("number"), F.lit("USD").alias("currency"), F.concat(F.lit("Liabilities:"), "c_mktsegment").alias("label"))
    return predict.predict(rows.where("date < '1998-07-01'"), rows.where("date >= '1998-07-01'").drop("label"))


@entry("pricecompletion")
def pricecompletion(spark, sf_dir):
    """Parts priced in USD through a chain: part -> USD, USD -> EUR; EUR prices by shortest paths."""
    p = star.prices(spark, sf_dir)
    usd = spark.createDataFrame([(0, "1995-01-01", "EUR", "USD")], "seq long, date string, base string, quote string").withColumns({"date": F.to_date("date"), "rate": F.lit("1.25").cast("decimal(18,4)")})
    return plugins.completed_prices(p.unionByName(usd), ("EUR",))


def _income_ledger(spark, sf_dir) -> Ledger:
    """The payables as income, so that there is something to clear."""
    led = star.ledger(spark, sf_dir)
    return plugins.changed(led, None, led.postings.withColumn("account", F.regexp_replace("account", "^Liabilities:Payable", "Income:Sales")))


@entry("r3_clear", """, i AS (SELECT date, replace(account, 'Liabilities:Payable', 'Income:Sales') AS account, number FROM post WHERE date < DATE '1999-01-01'),
c AS (SELECT account, sum(number) AS number FROM i WHERE account LIKE 'Income:%' GROUP BY account HAVING sum(number) <> 0),
u AS (SELECT account, number FROM i UNION ALL SELECT account, -number FROM c UNION ALL SELECT 'Equity:Earnings:Current', number FROM c)
SELECT account, sum(number)::DECIMAL(38,2) AS s FROM u GROUP BY account""")  # fmt: skip
def r3_clear(spark, sf_dir):
    df = query(_income_ledger(spark, sf_dir), "SELECT account, sum(number) AS s FROM CLOSE ON 1999-01-01 CLEAR GROUP BY account")
    return df.withColumn("s", F.col("s").cast(D2))


@entry("r1_open_income", """, i AS (SELECT date, replace(account, 'Liabilities:Payable', 'Income:Sales') AS account, number FROM post),
o AS (SELECT account, sum(number) AS number FROM i WHERE date < DATE '1998-01-01' GROUP BY account HAVING sum(number) <> 0),
u AS (SELECT CASE WHEN account LIKE 'Income:%' THEN 'Equity:Earnings:Previous' ELSE account END AS account, number FROM o UNION ALL SELECT 'Equity:Opening-Balances', -number FROM o UNION ALL SELECT account, number FROM i WHERE date >= DATE '1998-01-01')
SELECT account, sum(number)::DECIMAL(38,2) AS s FROM u GROUP BY account""")  # fmt: skip
def r1_open_income(spark, sf_dir):
    df = query(_income_ledger(spark, sf_dir), "SELECT account, sum(number) AS s FROM OPEN ON 1998-01-01 GROUP BY account")
    return df.withColumn("s", F.col("s").cast(D2))


bql("q17_balances_at_cost", "BALANCES AT cost", "SELECT account, '(' || rtrim(rtrim(sum((number * cost)::DECIMAL(38,6))::DECIMAL(38,6)::VARCHAR, '0'), '.') || ' USD)' AS sum FROM lots GROUP BY account", LOTS.replace("__UNIT__", UNIT), True)


@entry("j6_fifo_overlap", """WITH s AS (SELECT l_partkey, l_returnflag, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_partkey, l_returnflag = 'R' ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
c AS (SELECT *, sum(q) OVER (PARTITION BY l_partkey, l_returnflag = 'R' ORDER BY n) AS hi FROM s)
SELECT b.l_partkey, b.n AS lot, r.n AS sale, (least(b.hi, r.hi) - greatest(b.hi - b.q, r.hi - r.q))::BIGINT AS units FROM c b JOIN c r ON b.l_partkey = r.l_partkey AND b.l_returnflag <> 'R' AND r.l_returnflag = 'R' AND b.hi > r.hi - r.q AND r.hi > b.hi - b.q""", "")  # fmt: skip
def j6_fifo_overlap(spark, sf_dir):
    """FIFO matching of the sales of every part to its lots."""
    from ledgerlake.operators.inventory import fifo_overlap

    li = star.table(spark, sf_dir, "lineitem").withColumns({"sale": F.col("l_returnflag") == "R", "q": F.col("l_quantity").cast("bigint"), "day": F.unix_date(F.to_date("l_shipdate"))})
    return fifo_overlap(li, "l_partkey", ["day", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"])
