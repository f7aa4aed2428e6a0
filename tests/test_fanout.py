"""What an analysis writes: the sides it reads, and no others."""

import pytest

from agora.plans import fanout, profile, reviews
from agora.plans.catalog import Workspace
from agora.plans.fanout import master_rows, materialize_fanout
from agora.plans.rfm import rfm_scored
from agora.session import Scratch
from tests.handmade import money, order, tables
from tests.reference import pandas_master
from tests.test_master import as_set


class Recorder(Scratch):
    def __init__(self, spark):
        super().__init__(spark)
        self.written = []

    def stage(self, df):
        self.written.append(set(df.columns))
        return super().stage(df)

    def has(self, column):
        return any(column in columns for columns in self.written)


def some_tables(spark):
    """Repeated rows, customers and products that their keys do not tell apart, NULL keys."""
    items = [("o1", i, "p1", "s1", money(i), money(1)) for i in range(5)]
    return tables(
        spark,
        orders=[order("o1", "c1", "delivered", "2018-01-01 10:00:00", "2018-01-05 09:00:00")] * 2
        + [order("o1", "c2", "shipped", "2018-01-02 10:00:00"), order("o2", "c1", "delivered", "2018-01-02 10:00:00"),
           order(None, None, "delivered", "2018-01-03 10:00:00", "2018-01-04 10:00:00"), order("o3", "c9", "shipped", "2018-01-03 10:00:00")],
        items=items * 2 + [("o2", 1, "p2", "s2", money(5), money(1)), (None, 1, None, "s9", money(7), money(1)),
                           ("o8", 1, "p1", "s1", money(1), money(1))],
        products=[("p1", "cat_a", 1.0, 1.0), ("p1", "cat_b", 2.0, 1.0), ("p2", None, 3.0, 1.0)],
        customers=[("c1", "u1", "SP"), ("c1", "u1", "RJ"), ("c2", "u2", "RJ"), (None, "u0", "MG")],
        payments=[("o1", j, "boleto", 1, money(j)) for j in range(3)] + [(None, 1, "voucher", 1, money(4))],
        reviews=[("o1", 5), ("o1", 5), ("o1", 4), (None, 3), (None, None)],
        translation=[("cat_a", "alpha"), ("cat_a", "a"), ("cat_b", "beta")])


def test_dataset_counts_build_no_side(spark):
    t, scratch = some_tables(spark), Recorder(spark)
    got = {r.dataset: r.rows for r in profile.dataset_counts(t, materialize_fanout(t, scratch)).collect()}
    expect = pandas_master(t)
    assert got["master"] == len(expect) and got["delivered"] == (expect.order_status == "delivered").sum()
    assert not scratch.has("price") and not scratch.has("order_purchase_timestamp") and not scratch.has("has_delivered")
    scratch.close()


def test_review_distribution_writes_the_reviews_only(spark):
    t, scratch = some_tables(spark), Recorder(spark)
    got = {r.review_score: r.rows for r in reviews.review_distribution(materialize_fanout(t, scratch).delivered()).collect()}
    expect = pandas_master(t)
    expect = expect[(expect.order_status == "delivered") & expect.review_score.notna()]
    assert got == expect.groupby(expect.review_score.astype(int)).size().to_dict()
    assert not scratch.has("price") and not scratch.has("order_purchase_timestamp")
    scratch.close()


def test_customer_scores_write_the_orders_only(spark):
    t, scratch = some_tables(spark), Recorder(spark)
    rfm_scored(materialize_fanout(t, scratch).delivered())
    assert scratch.has("order_purchase_timestamp") and not scratch.has("price") and not scratch.has("payment_type")
    scratch.close()


def test_master_writes_no_side(spark):
    t, scratch = some_tables(spark), Recorder(spark)
    got, expect = master_rows(materialize_fanout(t, scratch), t).toPandas(), pandas_master(t)
    assert as_set(got, list(got.columns)) == as_set(expect, list(got.columns))
    assert not scratch.has("price") and not scratch.has("has_delivered")
    scratch.close()


def test_master_with_orders_above_the_cell(spark, monkeypatch):
    """o1 and the order without an id are formed in cells, the others are joined."""
    monkeypatch.setattr(fanout, "CELL", 1)
    t = some_tables(spark)
    with Workspace(spark, t, materialize=True) as w:
        got, expect = w.master.toPandas(), pandas_master(t)
    assert as_set(got, list(got.columns)) == as_set(expect, list(got.columns))


@pytest.fixture
def whole_plans(spark):
    """Joins by shuffle, and plans printed with all their columns."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.debug.maxToStringFields": "1000"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_order_statistics_shuffle_each_side_once_for_the_order(spark, whole_plans):
    """Four DISTINCTs, two joins with repeated keys, four groups; the groups are joined in place."""
    t = some_tables(spark)
    stats = fanout._order_stats(fanout._side_rows(t))
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4 + 2 * 2 + 4
    got = {r.order_id: r for r in stats.collect()}
    # o8 has items but no order row; o3 has no side row at all
    assert set(got) == {"o1", "o2", "o3", None}
    o1, o3, none = got["o1"], got["o3"], got[None]
    assert (o1.n_oc, o1.n_oc_del, o1.n_items, o1.n_pays, o1.n_revs) == (3, 2, 15, 3, 2)
    assert (o1.pay_sum, o1.pay_cnt, o1.rev_sum, o1.rev_cnt, o1.dd_sum_del, o1.dd_cnt_del) == (money(3), 3, 9, 2, 6, 2)
    assert (o3.n_oc, o3.n_items, o3.n_pays, o3.n_revs, o3.pay_sum, o3.pay_cnt, o3.rev_sum) == (1, 1, 1, 1, None, 0, None)
    assert not (o3.has_items or o3.has_pays or o3.has_revs)
    assert (none.n_items, none.n_pays, none.n_revs, none.pay_sum, none.rev_sum, none.rev_cnt) == (1, 1, 2, money(4), 3, 1)


def derived_below_a_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "AS order_year_month" in plan
    return "AS order_year_month" in plan[plan.index("Join "):]


def test_joins_of_the_order_side_shuffle_no_derived_column(spark, whole_plans):
    assert not derived_below_a_join(fanout.build_fanout(some_tables(spark)).orders)


def test_joins_of_the_master_shuffle_no_derived_column(spark, whole_plans):
    t, scratch = some_tables(spark), Scratch(spark)
    assert not derived_below_a_join(master_rows(fanout.build_fanout(t, scratch), t))
    scratch.close()
