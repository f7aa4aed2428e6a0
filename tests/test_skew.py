"""A hot order: the factorised plan stays O(input) and exact."""

import pytest
from pyspark.sql import functions as F

from agora.plans import payments, products, revenue, reviews
from agora.plans.fanout import build_fanout, master_rows, materialize_fanout
from agora.session import Scratch
from tests.handmade import money, order, tables
from tests.reference import literal_rows


def hot_tables(spark):
    orders = [order("hot", "c0", "delivered", "2018-01-01 10:00:00", "2018-01-04 09:00:00")]
    orders += [order(f"o{i}", f"c{i}", "delivered", "2018-01-02 10:00:00", "2018-01-06 09:00:00")
               for i in range(1, 40)]
    items = [("hot", i, f"p{i % 7}", f"s{i % 5}", money(i % 50 + 1), money(1)) for i in range(300)]
    items += [(f"o{i}", 1, "p1", "s1", money(10), money(1)) for i in range(1, 40)]
    pays = [("hot", j, "credit_card" if j % 2 else "voucher", 1, money(j + 0.5)) for j in range(20)]
    pays += [(f"o{i}", 1, "boleto", 1, money(20)) for i in range(1, 40)]
    revs = [("hot", s) for s in range(1, 6)] + [(f"o{i}", i % 5 + 1) for i in range(1, 40)]
    return tables(
        spark, orders=orders, items=items,
        products=[(f"p{k}", f"cat{k % 3}", 10.0 * k, float(k)) for k in range(7)],
        customers=[(f"c{i}", f"u{i % 10}", "SP") for i in range(40)],
        payments=pays, reviews=revs,
        translation=[(f"cat{k}", f"category_{k}") for k in range(3)])


def test_hot_order_sides_are_linear_and_exact(spark):
    t = hot_tables(spark)
    fan = build_fanout(t)
    fd = fan.delivered()
    rows = literal_rows(spark, t).where("order_status = 'delivered'")
    # 300 x 20 x 5 rows for the hot order alone, while the sides stay linear
    assert rows.count() == 300 * 20 * 5 + 39
    assert fan.items.count() == 339 and fan.payments.count() == 59 and fan.reviews.count() == 44

    k = revenue.kpis(fd).first()
    assert k.total_revenue == float(rows.agg(F.sum("payment_value")).first()[0])
    assert k.avg_review_score == rows.agg(F.avg("review_score")).first()[0]
    cats = {r.product_category_name_english: r.revenue for r in products.top_categories(fd).collect()}
    assert cats == {r[0]: float(r[1]) for r in rows.groupBy("product_category_name_english")
                    .agg(F.sum("payment_value")).collect()}
    dist = {r.review_score: r.rows for r in reviews.review_distribution(fd).collect()}
    assert dist == {r[0]: r[1] for r in rows.groupBy("review_score").count().collect()}
    pay = {r.payment_type: r.total_value for r in payments.payment_methods(fd).collect()}
    assert pay == {r[0]: float(r[1]) for r in rows.groupBy("payment_type")
                   .agg(F.sum("payment_value")).collect()}


def two_thirds_in_one_order(spark, rows):
    items = spark.range(rows).selectExpr(
        "if(id % 3 < 2, 'hot', concat('o', id)) order_id", "cast(id as int) order_item_id", "concat('p', id % 7) product_id",
        "concat('s', id % 5) seller_id", "cast(10 as decimal(18,2)) price", "cast(1 as decimal(18,2)) freight_value").repartition(8)
    orders = items.select("order_id").distinct().selectExpr(
        "order_id", "'c0' customer_id", "'delivered' order_status", "timestamp_ntz'2018-01-01 10:00:00' order_purchase_timestamp",
        "timestamp_ntz'2018-01-01 10:00:00' order_approved_at", "timestamp_ntz'2018-01-01 10:00:00' order_delivered_carrier_date",
        "timestamp_ntz'2018-01-04 10:00:00' order_delivered_customer_date", "timestamp_ntz'2018-01-30 10:00:00' order_estimated_delivery_date")
    t = hot_tables(spark)
    return type(t)(**{**t.as_dict(), "orders": orders, "order_items": items})


@pytest.fixture
def small_thresholds(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.coalescePartitions.enabled": "false",  # a split is by map tasks, so there must be some
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_order_is_split_by_the_plan_that_runs(spark, small_thresholds):
    """Two thirds of the items belong to one order; with small thresholds the executed plan of
    the item side has a skew join, and no join of the side's rows is without a split."""
    rows = 30_000
    side = build_fanout(two_thirds_in_one_order(spark, rows)).items
    got = side.select("order_id", "order_item_id", "price", F.spark_partition_id().alias("task"))
    tasks = [r["task"] for r in got.collect()]
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    assert max(map(tasks.count, set(tasks))) < rows / 3 and len(tasks) == rows


def test_a_hot_order_is_split_where_the_sides_are_written(spark, small_thresholds):
    """The same for the one job that writes all four sides: a task writes one file of the item
    side, and no file holds a third of its rows."""
    rows, scratch = 30_000, Scratch(spark)
    items = materialize_fanout(two_thirds_in_one_order(spark, rows), scratch).items
    files = [r["count"] for r in items.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == rows and max(files) < rows / 3
    scratch.close()


def test_master_of_a_hot_order_is_formed_in_cells(spark):
    t = hot_tables(spark)
    whole = master_rows(build_fanout(t), t)
    assert whole.count() == 300 * 20 * 5 + 39 and whole.distinct().count() == whole.count()
