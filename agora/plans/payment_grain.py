"""The ten SQL-style analyses, at payment, item and order grain (nothing is de-duplicated).

They are defined over inner joins of delivered orders with payments, items and customers, and a
left join with reviews, so a row counts once for each match.  Here each of payments, items and
reviews is first reduced to one row per order (and type, product or seller) with its sums and
row counts; the joins are then N:1, the counts become weights, and an order with very many
rows is one row after the map-side aggregate.  All sums are exact DECIMALs or integers.  A
rounded mean is the exact ratio of two of them, rounded half up once (``half_up``).  NULL keys
match nothing in joins but form a group of their own, as in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import calendar_days, field_position, half_up, month_period, weekday_name
from agora.operators.distinct import sums_with_distincts
from agora.operators.ranking import ntile_cuts, tile_of
from agora.session import stage
from agora.tables import MarketplaceTables

# The status that counts, the weekday order and the result sizes.
DELIVERED = "delivered"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TOP = 10


def delivered_orders(t: MarketplaceTables) -> DataFrame:
    return t.orders.where(F.col("order_status") == DELIVERED)


def order_rows(t: MarketplaceTables) -> DataFrame:
    """Delivered rows per order id (1 unless ids repeat)."""
    return delivered_orders(t).groupBy("order_id").agg(F.count(F.lit(1)).alias("order_rows"))


def payments_by_order(t: MarketplaceTables) -> DataFrame:
    return t.payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("pay_rows"), F.sum("payment_value").alias("paid"),
        F.count("payment_value").alias("paid_n"))


def reviews_by_order(t: MarketplaceTables) -> DataFrame:
    return t.reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("review_rows"), F.sum("review_score").alias("score"),
        F.count("review_score").alias("score_n"))


def review_weight() -> Column:
    """Rows that one row becomes when its order's reviews are joined to it."""
    return F.coalesce(F.col("review_rows"), F.lit(1))


def money(total: Column) -> Column:
    """A DECIMAL sum of cents as DOUBLE; it has two decimals already."""
    return total.cast("double")


def mean_money(total: Column, rows: Column) -> Column:
    return half_up(total, rows, 2)


def paid_orders(t: MarketplaceTables) -> DataFrame:
    """Delivered order rows that have payments, with the sums of these."""
    return delivered_orders(t).join(payments_by_order(t), "order_id")


def paid_sums() -> dict[str, Column]:
    return {"paid": F.sum("paid"), "paid_n": F.sum("paid_n")}


def kpi_overview(t: MarketplaceTables) -> DataFrame:
    rows = paid_orders(t).join(reviews_by_order(t), "order_id", "left")
    w = review_weight()
    found = sums_with_distincts(rows, [], ("order_id", "total_orders"), ("customer_id", "total_customers"), {
        "paid": F.sum(F.col("paid") * w), "paid_n": F.sum(F.col("paid_n") * w),
        "score": F.sum(F.col("score") * F.col("pay_rows")), "score_n": F.sum(F.col("score_n") * F.col("pay_rows"))}, null_a=False)
    return found.select(
        "total_orders", "total_customers", money(F.col("paid")).alias("total_revenue"),
        mean_money(F.col("paid"), F.col("paid_n")).alias("avg_order_value"),
        half_up(F.col("score"), F.col("score_n"), 2).alias("avg_review_score"))


def monthly_revenue(t: MarketplaceTables) -> DataFrame:
    rows = paid_orders(t).join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
    rows = rows.withColumn("order_month", month_period("order_purchase_timestamp"))
    found = sums_with_distincts(rows, ["order_month"], ("order_id", "total_orders"), ("customer_unique_id", "unique_customers"),
                                paid_sums(), null_a=False)
    return (found.select("order_month", "total_orders", "unique_customers", money(F.col("paid")).alias("revenue"),
                         mean_money(F.col("paid"), F.col("paid_n")).alias("avg_order_value"))
            .orderBy("order_month"))


def top_categories(t: MarketplaceTables) -> DataFrame:
    per_product = t.order_items.groupBy("order_id", "product_id").agg(
        F.count(F.lit(1)).alias("item_rows"), F.sum("price").alias("price"), F.sum("freight_value").alias("freight"))
    named = (t.products.select("product_id", "product_category_name")
             .join(t.category_translation, "product_category_name")
             .select("product_id", F.col("product_category_name_english").alias("category")))
    by_order = (per_product.join(named, "product_id").groupBy("order_id", "category")
                .agg(F.sum("item_rows").alias("item_rows"), F.sum("price").alias("price"), F.sum("freight").alias("freight")))
    rows = by_order.join(order_rows(t), "order_id").join(reviews_by_order(t), "order_id", "left")
    w, copies = review_weight() * F.col("order_rows"), F.col("item_rows") * F.col("order_rows")
    return (rows.groupBy("category")
            .agg(F.count("order_id").alias("total_orders"),  # one row for each category and order
                 money(F.sum(F.col("price") * w)).alias("product_revenue"),
                 money(F.sum(F.col("freight") * w)).alias("freight_revenue"),
                 half_up(F.sum(F.col("score") * copies), F.sum(F.col("score_n") * copies), 2).alias("avg_review"))
            .orderBy(F.desc("product_revenue"), "category").limit(TOP))


def state_revenue(t: MarketplaceTables) -> DataFrame:
    rows = paid_orders(t).join(t.customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id")
    found = sums_with_distincts(rows, ["customer_state"], ("order_id", "total_orders"), ("customer_unique_id", "total_customers"),
                                paid_sums(), null_a=False)
    return (found.select("customer_state", "total_customers", "total_orders", money(F.col("paid")).alias("total_revenue"),
                         mean_money(F.col("paid"), F.col("paid_n")).alias("avg_order_value"))
            .orderBy(F.desc("total_revenue"), "customer_state"))


def delivery(t: MarketplaceTables) -> DataFrame:
    arrived = F.col("order_delivered_customer_date")
    on_time = arrived <= F.col("order_estimated_delivery_date")
    rows = (delivered_orders(t).where(arrived.isNotNull())
            .withColumns({"delivery_status": F.when(on_time, "On Time").otherwise("Late"),
                          "days": calendar_days(arrived, F.col("order_purchase_timestamp"))})
            .join(reviews_by_order(t), "order_id", "left"))
    w = review_weight()
    return rows.groupBy("delivery_status").agg(
        F.sum(w).alias("order_count"),
        half_up(F.sum(F.col("days") * w), F.sum(F.when(F.col("days").isNotNull(), w)), 1).alias("avg_delivery_days"),
        half_up(F.sum("score"), F.sum("score_n"), 2).alias("avg_review_score")).orderBy("delivery_status")


def payment_methods(t: MarketplaceTables) -> DataFrame:
    by_order = t.payments.groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("paid"), F.count("payment_value").alias("paid_n"),
        F.sum("payment_installments").alias("parts"), F.count("payment_installments").alias("parts_n"))
    rows = by_order.join(order_rows(t), "order_id")
    total = {c: F.sum(F.col(c) * F.col("order_rows")) for c in ("paid", "paid_n", "parts", "parts_n")}
    return (rows.groupBy("payment_type")
            .agg(F.count("order_id").alias("total_orders"),  # one row for each type and order
                 money(total["paid"]).alias("total_revenue"),
                 mean_money(total["paid"], total["paid_n"]).alias("avg_payment"),
                 half_up(total["parts"], total["parts_n"], 1).alias("avg_installments"))
            .orderBy(F.desc("total_orders"), "payment_type"))


def rfm_segments(t: MarketplaceTables) -> DataFrame:
    """Quintiles of each customer's recency (most recent last), frequency and spending; ties go
    by customer_unique_id.  The customer table is written once; each ranking holds only the
    measure and the id, and gives the four rows where a quintile begins."""
    latest = t.orders.select(F.max("order_purchase_timestamp")).scalar()
    customers = (paid_orders(t).join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
                 .groupBy("customer_unique_id")
                 .agg(calendar_days(latest, F.max("order_purchase_timestamp")).alias("recency"),
                      F.countDistinct("order_id").alias("frequency"), F.sum("paid").alias("monetary")))
    base = stage(customers)
    measures = {"r": -F.col("recency"), "f": F.col("frequency"), "m": F.col("monetary")}
    scored = base.withColumns({
        k: tile_of(value, F.col("customer_unique_id"), ntile_cuts(base, value, "customer_unique_id", 5))
        for k, value in measures.items()})
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    # Rules and names; the first rule that holds names the segment.
    rules = [((r >= 4) & (f >= 4) & (m >= 4), "Champions"), ((r >= 3) & (f >= 3) & (m >= 3), "Loyal"),
             ((r >= 4) & (f <= 2), "New Customers"), ((r <= 2) & (f >= 3), "At Risk"),
             ((r <= 2) & (f <= 2) & (m <= 2), "Lost")]
    segment = F.coalesce(*[F.when(rule, name) for rule, name in rules], F.lit("Need Attention"))
    n = {c: F.count(c) for c in ("recency", "frequency", "monetary")}
    return (scored.groupBy(segment.alias("segment"))
            .agg(F.count(F.lit(1)).alias("customer_count"),
                 half_up(F.sum("recency"), n["recency"], 0).alias("avg_recency"),
                 half_up(F.sum("frequency"), n["frequency"], 1).alias("avg_frequency"),
                 half_up(F.sum("monetary"), n["monetary"], 2).alias("avg_monetary"))
            .orderBy(F.desc("customer_count"), "segment"))


def top_sellers(t: MarketplaceTables) -> DataFrame:
    sold = t.order_items.groupBy("order_id", "seller_id", "product_id").agg(
        F.count(F.lit(1)).alias("item_rows"), F.sum("price").alias("price"))
    sold = sold.join(order_rows(t), "order_id")
    by_order = sold.groupBy("seller_id", "order_id").agg(
        F.sum("item_rows").alias("item_rows"), F.sum("price").alias("price"), F.max("order_rows").alias("order_rows"))
    rows = by_order.join(reviews_by_order(t), "order_id", "left")
    w, copies = review_weight() * F.col("order_rows"), F.col("item_rows") * F.col("order_rows")
    sums = rows.groupBy("seller_id").agg(
        F.count("order_id").alias("total_orders"), F.sum(F.col("price") * w).alias("price"),
        F.sum(F.col("score") * copies).alias("score"), F.sum(F.col("score_n") * copies).alias("score_n"))
    products = (sold.select("seller_id", "product_id").distinct().groupBy("seller_id")
                .agg(F.count("product_id").alias("products_sold")))
    # a seller row that is listed twice counts twice
    places = t.sellers.groupBy("seller_id", "seller_city", "seller_state").agg(F.count(F.lit(1)).alias("listed"))
    return (places.join(sums, "seller_id").join(products, "seller_id")
            .select("seller_id", "seller_city", "seller_state", "total_orders", "products_sold",
                    money(F.col("price") * F.col("listed")).alias("total_revenue"),
                    half_up(F.col("score"), F.col("score_n"), 2).alias("avg_review"))
            .orderBy(F.desc("total_revenue"), "seller_id", "seller_city", "seller_state").limit(TOP))


def mom_growth(t: MarketplaceTables) -> DataFrame:
    by_month = (paid_orders(t).groupBy(month_period("order_purchase_timestamp").alias("month"))
                .agg(F.sum("paid").alias("now")))
    before = F.lag("now").over(Window.orderBy("month"))  # one row a month
    return (by_month.withColumn("before", before)
            .select("month", money(F.col("now")).alias("revenue"), money(F.col("before")).alias("prev_month_revenue"),
                    half_up((F.col("now") - F.col("before")) * 100, F.col("before"), 2).alias("growth_pct"))
            .orderBy("month"))


def hour_weekday(t: MarketplaceTables) -> DataFrame:
    at = F.col("order_purchase_timestamp")
    return (paid_orders(t).groupBy(weekday_name(at).alias("day_of_week"), F.hour(at).cast("bigint").alias("hour_of_day"))
            .agg(F.countDistinct("order_id").alias("total_orders"), money(F.sum("paid")).alias("revenue"))
            .orderBy(field_position("day_of_week", WEEKDAYS), "hour_of_day"))


QUERIES: dict[str, Callable[[MarketplaceTables], DataFrame]] = {
    "sql_kpi_overview": kpi_overview, "sql_monthly_revenue": monthly_revenue, "sql_top_categories": top_categories,
    "sql_state_revenue": state_revenue, "sql_delivery": delivery, "sql_payment_methods": payment_methods,
    "sql_rfm": rfm_segments, "sql_top_sellers": top_sellers, "sql_mom_growth": mom_growth, "sql_hour_weekday": hour_weekday}
