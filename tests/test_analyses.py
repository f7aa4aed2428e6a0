import pytest

from pyspark.sql import functions as F

from agora.plans import (customers, delivery, payment_grain, payments, products, profile, revenue, reviews, rfm,
                         sellers)
from agora.plans.catalog import tpch_workspace
from agora.plans.fanout import build_fanout
from tests.conftest import SF001
from tests.handmade import money, order, tables
from tests.reference import literal_rows


@pytest.fixture(scope="module")
def small(spark):
    t = tables(
        spark,
        orders=[order("o1", "c1", "delivered", "2018-01-01 10:00:00", "2018-01-05 09:00:00"),
                order("o2", "c2", "delivered", "2018-02-06 10:00:00", "2018-03-09 10:00:00"),
                order("o3", "c3", "delivered", "2018-03-06 11:00:00", "2018-03-08 11:00:00"),
                order("o4", "c4", "delivered", "2018-03-07 11:00:00", "2018-03-07 20:00:00")],
        items=[("o1", 1, "p1", "s1", money(10), money(1)),
               ("o2", 1, "p2", "s2", money(20), money(2)),
               ("o3", 1, "p1", "s1", money(30), money(3)),
               ("o4", 1, "p1", "s3", money(40), money(4))],
        products=[("p1", "cat_a", 100.0, 10.0), ("p2", "cat_b", 50.0, 5.0)],
        customers=[("c1", "u1", "SP"), ("c2", "u2", None), ("c3", "u1", "SP"), ("c4", "u4", "RJ")],
        payments=[("o1", 1, "credit_card", 2, money(100)), ("o3", 1, "voucher", 1, money(0)),
                  ("o4", 1, "credit_card", 1, money(50))],
        reviews=[("o1", 5), ("o2", 2), ("o3", 4)],
        sellers=[("s1", "city1", "SP"), ("s2", "city2", "RJ")],
        translation=[("cat_a", "alpha"), ("cat_b", "beta")])
    return t, build_fanout(t).delivered()


def test_null_state_dropped_in_script_kept_in_sql(spark, small):
    t, d = small
    states = {r.customer_state for r in revenue.revenue_by_state(d).collect()}
    assert states == {"SP", "RJ"}
    sql_states = {r.customer_state for r in
                  payment_grain.state_revenue(t).collect()}
    assert None in sql_states or len(sql_states) == 2  # o2 has no payment, so no row


def test_all_null_sum_is_zero_and_zero_base_growth(spark, small):
    _, d = small
    monthly = {r.order_year_month: r for r in revenue.mom_growth(d).collect()}
    assert monthly["2018-02"].revenue == 0.0           # only unpaid order o2
    assert monthly["2018-02"].revenue_growth == -100.0
    assert monthly["2018-03"].revenue_growth is None    # previous month is 0
    assert monthly["2018-01"].revenue_growth is None
    assert monthly["2018-03"].growth_direction == "positive"


def test_missing_weekdays_are_null(spark, small):
    _, d = small
    rows = revenue.revenue_by_weekday(d).collect()
    assert [r.day for r in rows][0] == "Monday" and len(rows) == 7
    sunday = rows[-1]
    assert sunday.revenue is None and sunday.orders is None


def test_few_sellers_and_categories(spark, small):
    _, d = small
    conc = sellers.seller_concentration(d).first()
    assert conc.sellers == 3 and conc.top_decile_revenue == 0.0   # int(3 * 0.1) == 0
    assert conc.top_seller_revenue == 100.0
    best = products.best_categories(d, min_orders=1).collect()
    worst = products.worst_categories(d, min_orders=1).collect()
    assert {r.product_category_name_english for r in best} == {"alpha", "beta"}
    assert [r.product_category_name_english for r in worst] == [r.product_category_name_english
                                                                for r in best]


def test_delivery_and_loyalty(spark, small):
    _, d = small
    dd = d.delivery_rows()
    # o4 is delivered the same day (0 days) and is left out
    assert sorted(r.delivery_days for r in dd.select("delivery_days").collect()) == [2, 3, 31]
    k = delivery.delivery_kpis(dd).first()
    # every order shares the 2018-01-30 estimate: only o1 is on time
    assert k.median_days == 3.0 and k.on_time_pct == pytest.approx(100 / 3)
    loyal = {r.customer_type: r.customers for r in customers.customer_loyalty(d).collect()}
    assert loyal == {"Repeat": 1, "One-time": 2}


def test_rfm_golden_segment_counts(spark):
    w = tpch_workspace(spark, SF001)
    got = {r.segment: r["count"] for r in rfm.rfm_segments(w.rfm).collect()}
    assert got == {"Loyal Customers": 292, "At Risk": 272, "Champions": 254, "Lost": 231,
                   "Potential Loyalists": 139, "New Customers": 104, "Need Attention": 81,
                   "Cant Lose Them": 56}


def test_factorised_sums_equal_fan_out_rows(spark):
    """A heavy order (3 items x 2 payments x 2 reviews = 12 master rows) next to
    an order without items, payments or reviews: every factorised aggregate
    equals the same aggregate over the literal master rows."""
    t = tables(
        spark,
        orders=[order("o1", "c1", "delivered", "2018-01-01 10:00:00", "2018-01-05 09:00:00"),
                order("o2", "c2", "delivered", "2018-01-02 10:00:00", "2018-01-09 09:00:00")],
        items=[("o1", i, f"p{i}", f"s{i % 2}", money(10 * i), money(i)) for i in (1, 2, 3)],
        products=[("p1", "cat_a", 100.0, 10.0), ("p2", "cat_b", 50.0, 5.0),
                  ("p3", "cat_a", 70.0, 7.0)],
        customers=[("c1", "u1", "SP"), ("c2", "u2", "RJ")],
        payments=[("o1", 1, "credit_card", 2, money(31.5)), ("o1", 2, "voucher", 1, money(4.25))],
        reviews=[("o1", 5), ("o1", 2)],
        translation=[("cat_a", "alpha"), ("cat_b", "beta")])
    fd = build_fanout(t).delivered()
    rows = literal_rows(spark, t).where("order_status = 'delivered'")
    assert rows.count() == 13
    k = revenue.kpis(fd).first()
    assert k.total_revenue == float(rows.agg(F.sum("payment_value")).first()[0])
    assert k.avg_review_score == rows.agg(F.avg("review_score")).first()[0]
    cats = {r.product_category_name_english: r.revenue for r in products.top_categories(fd).collect()}
    expect = {r[0]: float(r[1] or 0) for r in
              rows.groupBy("product_category_name_english").agg(F.sum("payment_value")).collect()}
    assert cats == expect
    dist = {r.review_score: r.rows for r in reviews.review_distribution(fd).collect()}
    assert dist == {2: 6, 5: 6}
    pay = {r.payment_type: (r.total_value, r.avg_value) for r in payments.payment_methods(fd).collect()}
    assert pay["credit_card"] == (31.5 * 6, 31.5) and pay["voucher"] == (4.25 * 6, 4.25)
    rows_dd = rows.dropna(subset=["delivery_days", "estimated_delivery_days"]).where("delivery_days > 0")
    kp = delivery.delivery_kpis(fd.delivery_rows()).first()
    assert kp.avg_days == rows_dd.agg(F.avg("delivery_days")).first()[0]
    assert kp.median_days == rows_dd.agg(F.median("delivery_days")).first()[0]
    counts = {r.dataset: r.rows for r in profile.dataset_counts(t, build_fanout(t)).collect()}
    assert counts["master"] == 13 and counts["delivered"] == 13


def correlation_tables(spark, weights, lengths, prices):
    n = len(weights)
    return tables(
        spark,
        orders=[order(f"o{i}", f"c{i}", "delivered", "2018-01-01 10:00:00", f"2018-01-{3 + i % 9:02d} 09:00:00") for i in range(n)],
        items=[(f"o{i}", 1, f"p{i}", "s1", money(prices[i]), money(1 + i % 3)) for i in range(n)],
        products=[(f"p{i}", "cat", weights[i], lengths[i]) for i in range(n)],
        customers=[(f"c{i}", f"u{i}", "SP") for i in range(n)],
        payments=[(f"o{i}", 1, "boleto", 1, money(5 + i * i % 11)) for i in range(n)],
        reviews=[(f"o{i}", 1 + i % 5) for i in range(n)], translation=[("cat", "alpha")])


@pytest.mark.parametrize("weights, lengths", [
    ([0.001, 0.005, 0.002, 0.004, 0.003, 0.001], [0.005, 0.001, 0.004, 0.003, 0.002, 0.004]),     # below one cent
    ([1e8 + 0.01 * i for i in (3, 1, 4, 1, 5, 9)], [1e8 + 0.01 * i for i in (2, 7, 1, 8, 2, 8)]),  # large, small steps
])
def test_correlation_equals_pandas_without_rounding(spark, weights, lengths):
    t = correlation_tables(spark, weights, lengths, [10, 20, 15, 40, 35, 5])
    fd = build_fanout(t).delivered()
    cols = profile.CORRELATION_COLUMNS
    expect = literal_rows(spark, t).select(*cols).toPandas().astype(float).corr()
    got = {(r.col_a, r.col_b): r.corr for r in profile.correlation(fd, digits=None).collect()}
    for a in cols:
        for b in cols:
            assert got[a, b] == pytest.approx(expect.loc[a, b], abs=1e-6), (a, b)
    reported = {(r.col_a, r.col_b): r.corr for r in profile.correlation(fd).collect()}
    assert all(reported[k] == round(v, 10) for k, v in got.items())


def test_correlation_of_fan_out_and_constant_columns(spark):
    t = correlation_tables(spark, [3.0, 1.0, 2.0, 7.0], [1.0] * 4, [10, 20, 15, 40])
    more = spark.createDataFrame([("o1", 2, "p2", "s1", money(9), money(2))], t.order_items.schema)
    t = type(t)(**{**t.as_dict(), "order_items": t.order_items.unionByName(more)})
    cols = profile.CORRELATION_COLUMNS
    expect = literal_rows(spark, t).select(*cols).toPandas().astype(float).corr()
    for r in profile.correlation(build_fanout(t).delivered()).collect():
        if "product_length_cm" in (r.col_a, r.col_b):
            assert r.corr is None
        else:
            assert r.corr == pytest.approx(expect.loc[r.col_a, r.col_b], abs=1e-9)


def test_sorted_results_come_in_order(spark):
    w = tpch_workspace(spark, SF001)

    def values(df, *cols):
        return [tuple(r[c] for c in cols) for r in df.collect()]

    for df, col in ((revenue.monthly_revenue(w.delivered), "order_year_month"), (payment_grain.monthly_revenue(w.tables), "order_month"),
                    (payment_grain.mom_growth(w.tables), "month"), (rfm.segment_spend(w.rfm), "avg_monetary")):
        got = values(df, col)
        assert got == sorted(got) and len(got) > 3
    for df, col, tie in ((products.top_categories(w.delivered), "revenue", "product_category_name_english"),
                         (sellers.top_sellers(w.delivered), "total_revenue", "seller_id"),
                         (rfm.rfm_segments(w.rfm), "count", "segment"),
                         (payment_grain.state_revenue(w.tables), "total_revenue", "customer_state"),
                         (payment_grain.payment_methods(w.tables), "total_orders", "payment_type"),
                         (payment_grain.rfm_segments(w.tables), "customer_count", "segment"),
                         (payment_grain.top_sellers(w.tables), "total_revenue", "seller_id")):
        got = values(df, col, tie)
        assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) > 3
    hours = values(payment_grain.hour_weekday(w.tables), "day_of_week", "hour_of_day")
    assert hours == sorted(hours, key=lambda r: (payment_grain.WEEKDAYS.index(r[0]), r[1]))
