import pandas as pd

from agora.plans import revenue
from agora.plans.fanout import build_fanout, master_rows
from agora.sources import tpch_marketplace
from tests.conftest import SF0001
from tests.handmade import money, order, tables
from tests.reference import literal_rows, pandas_master


def as_set(frame: pd.DataFrame, columns) -> list[tuple]:
    return sorted((tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in row)
                   for row in frame[columns].itertuples(index=False, name=None)))


def test_master_rows_equal_the_literal_join(spark):
    t = tpch_marketplace(spark, SF0001)
    naive = literal_rows(spark, t)
    ours = master_rows(build_fanout(t), t).select(*naive.columns)
    assert ours.count() == naive.count()
    assert ours.exceptAll(naive).count() == 0 and naive.exceptAll(ours).count() == 0


def small_tables(spark):
    return tables(
        spark,
        orders=[order("o1", "c1", "delivered", "2018-01-01 10:00:00", "2018-01-05 09:00:00"),
                order("o2", "c2", "delivered", "2018-01-02 10:00:00"),          # not delivered yet
                order("o3", "c3", "shipped", "2018-01-03 10:00:00")],           # no items, no payment
        items=[("o1", 1, "p1", "s1", money(10), money(1)),
               ("o1", 2, "p2", "s1", money(20), money(2)),
               ("o2", 1, "p3", "s2", money(5), money(1))],
        products=[("p1", "cat_a", 100.0, 10.0), ("p2", "cat_x", 50.0, 5.0), ("p3", None, None, None)],
        customers=[("c1", "u1", "SP"), ("c2", "u2", "RJ"), ("c3", "u3", "SP")],
        payments=[("o1", 1, "credit_card", 2, money(31)), ("o2", 1, "boleto", 1, money(6))],
        reviews=[("o1", 5), ("o1", 5), ("o2", 1), ("o2", 3)],   # equal pair collapses, unequal fans out
        translation=[("cat_a", "alpha")])


def test_master_semantics(spark):
    t = small_tables(spark)
    rows = {(r.order_id, r.order_item_id, r.review_score): r for r in master_rows(build_fanout(t), t).collect()}
    assert len(rows) == 2 + 2 + 1
    assert rows[("o1", 2, 5)].product_category_name_english == "unknown"
    assert rows[("o1", 1, 5)].product_category_name_english == "alpha"
    o3 = rows[("o3", None, None)]
    assert o3.payment_value is None and o3.delivery_status == "Late"
    assert rows[("o2", 1, 1)].delivery_status == "Late" and rows[("o2", 1, 1)].delivery_days is None
    o1 = rows[("o1", 1, 5)]
    assert (o1.delivery_days, o1.estimated_delivery_days, o1.delivery_status) == (3, 28, "On Time")
    assert (o1.order_year_month, o1.order_day_of_week, o1.order_hour) == ("2018-01", "Monday", 10)


def test_null_keys_are_kept_and_match_each_other(spark):
    """The merge rule: orders without an id keep their row and meet items without one."""
    t = tables(
        spark,
        orders=[order("o1", "c1", "delivered", "2018-01-01 10:00:00"), order(None, "c2", "delivered", "2018-01-02 10:00:00"),
                order("o3", None, "delivered", "2018-01-03 10:00:00")],
        items=[("o1", 1, "p1", "s1", money(10), money(1)), (None, 1, "p9", "s9", money(7), money(1)),
               (None, 2, "p1", "s9", money(8), money(1))],
        products=[("p1", "cat_a", 1.0, 1.0)],
        customers=[("c1", "u1", "SP"), ("c2", "u2", "RJ"), (None, "u0", "MG")],
        payments=[("o1", 1, "boleto", 1, money(11)), (None, 1, "voucher", 1, money(4)), ("o3", 1, "boleto", 1, money(2))],
        reviews=[(None, 3)], translation=[("cat_a", "alpha")])
    expect = pandas_master(t)
    got = master_rows(build_fanout(t), t).toPandas()
    assert len(got) == 4 and as_set(got, list(got.columns)) == as_set(expect, list(got.columns))
    states = {r.customer_state: r.revenue for r in revenue.revenue_by_state(build_fanout(t).delivered()).collect()}
    assert states == {"SP": 11.0, "RJ": 8.0, "MG": 2.0}


def test_master_equals_pandas(spark):
    t = small_tables(spark)
    got = master_rows(build_fanout(t), t).toPandas()
    assert as_set(got, list(got.columns)) == as_set(pandas_master(t), list(got.columns))
