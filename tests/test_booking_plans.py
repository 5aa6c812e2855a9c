"""Queries over bookings compute no more of them than they keep."""

import __spark_entry__
from ledgerlake.operators import booking
from ledgerlake.proofs import trades

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sales_without_their_cash(spark):
    """missing amounts, which the query drops, are not computed."""
    got = plan(__spark_entry__.queries()["b5_reduce_lifo"](spark, SF))
    assert "sum(_w#" not in got and "collect_list" not in got


def test_strict_pools_are_hashed(spark):
    """the lots of a pool are compared without sorting it."""
    p = trades(spark, SF, "STRICT").postings.where("cost_spec is not null")
    assert "SortAggregate" not in booking._pools(p, {}, "STRICT")._jdf.queryExecution().executedPlan().toString()


def test_cash_of_purchases(spark):
    """lots are matched once, for the sums, and not for the legs at cost, which the query drops."""
    got = plan(__spark_entry__.queries()["b7_interpolation"](spark, SF))
    assert got.count("Window [sum(_w0") == 1 and "collect_list" not in got


def test_cash_of_purchases_reads_keys_once(spark):
    """the lines' keys are written down once, and sums of sales take their lots without joining the sales' postings."""
    got = plan(__spark_entry__.queries()["b7_interpolation"](spark, SF))
    assert "md5(" not in got and got.count("Join Inner") == 1 and "RepartitionByExpression [seq" in got


def test_inventory_matches_lots_once(spark):
    """sums of numbers and of positions come from one pass over the booked postings."""
    got = plan(__spark_entry__.queries()["b8_inventory_after"](spark, SF))
    assert got.count("Window [sum(_w0") == 1 and "md5(" not in got


def test_inspect_reads_one_account(spark):
    """lots of other accounts are not matched."""
    got = plan(__spark_entry__.queries()["b9_inspect"](spark, SF))
    assert got.count("Assets:Stock:P, cast(l_partkey") and all("Assets:Stock:P" in x for x in got.split("Relation [")[:-1]) and "'Assets:Cash" not in got
