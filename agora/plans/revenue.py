"""Headline KPIs and revenue trends over the delivered master rows.

Revenue here is the sum of ``payment_value`` over master rows, i.e. over the
item x payment x review fan-out (the workload's own definition, kept on
purpose), computed from the factorised sides (``plans.fanout``); the
SQL-style queries in ``sql_queries`` use payment grain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import null_if_zero
from agora.operators.distinct import sums_with_distincts
from agora.operators.reshape import reindex
from agora.plans.fanout import (Fanout, fan_sum, pay_on_orders, pay_rows_on_orders, ratio_of_totals,
                                rev_on_orders, rev_rows_on_orders, total_or_zero)

# Weekday order of the weekday report.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def kpis(fd: Fanout) -> DataFrame:
    """One row: total_revenue, total_orders, total_customers (distinct
    customer_unique_id), avg_order_value (revenue / orders),
    avg_review_score, total_products_sold (distinct products)."""
    products = fd.items.select(F.countDistinct("product_id")).scalar()
    row = sums_with_distincts(
        fd.orders, [], ("order_id", "total_orders"), ("customer_unique_id", "total_customers"),
        {"pay": F.sum(pay_on_orders()), "rev": F.sum(rev_on_orders()), "rev_rows": F.sum(rev_rows_on_orders())})
    row = row.select(total_or_zero("pay").alias("total_revenue"), "total_orders", "total_customers",
                     ratio_of_totals("rev", "rev_rows").alias("avg_review_score"))
    return row.select(
        "total_revenue", "total_orders", "total_customers",
        (F.col("total_revenue") / null_if_zero(F.col("total_orders"))).alias("avg_order_value"),
        "avg_review_score", products.alias("total_products_sold"))


def monthly_revenue(fd: Fanout) -> DataFrame:
    """Per ``yyyy-MM``: revenue, distinct orders, distinct customers."""
    found = sums_with_distincts(
        fd.orders.where(F.col("order_year_month").isNotNull()), ["order_year_month"],
        ("order_id", "orders"), ("customer_unique_id", "customers"), {"pay": F.sum(pay_on_orders())})
    return (found.select("order_year_month", total_or_zero("pay").alias("revenue"), "orders", "customers")
            .orderBy("order_year_month"))


def revenue_by_weekday(fd: Fanout) -> DataFrame:
    """Seven rows Monday..Sunday: revenue and payment rows ("orders" counts
    master rows with a payment value).  A weekday without rows has NULLs."""
    per_day = (fd.orders.where(F.col("order_day_of_week").isNotNull())
               .groupBy(F.col("order_day_of_week").alias("day"))
               .agg(fan_sum(pay_on_orders()).alias("revenue"),
                    F.sum(pay_rows_on_orders()).alias("orders")))
    return (reindex(per_day, "day", WEEKDAYS)
            .orderBy("_order").select("day", "revenue", "orders"))


def revenue_by_hour(fd: Fanout) -> DataFrame:
    """Per purchase hour: revenue and master rows with a payment value."""
    return (fd.orders.where(F.col("order_hour").isNotNull())
            .groupBy(F.col("order_hour").alias("hour"))
            .agg(fan_sum(pay_on_orders()).alias("revenue"),
                 F.sum(pay_rows_on_orders()).alias("orders"))
            .orderBy("hour"))


def revenue_by_state(fd: Fanout) -> DataFrame:
    """Per customer state: distinct customers, revenue, distinct orders."""
    found = sums_with_distincts(
        fd.orders.where(F.col("customer_state").isNotNull()), ["customer_state"],
        ("order_id", "orders"), ("customer_unique_id", "customers"), {"pay": F.sum(pay_on_orders())})
    return (found.select("customer_state", "customers", total_or_zero("pay").alias("revenue"), "orders")
            .orderBy(F.desc("revenue"), "customer_state"))


def mom_growth(fd: Fanout) -> DataFrame:
    """Monthly revenue with month-over-month change in percent.

    Growth is relative to the previous *row* (previous month with data); the
    first month and a zero base give NULL.  ``growth_direction`` is
    ``positive`` for growth >= 0 (a NULL growth counts as 0).
    """
    # one row per month: the window input is small and bounded by the calendar
    w = Window.orderBy("order_year_month")

    def change(c: str):
        prev = F.lag(F.col(c).cast("double")).over(w)
        return (F.col(c).cast("double") / null_if_zero(prev) - 1) * 100

    return (monthly_revenue(fd)
            .withColumns({"revenue_growth": change("revenue"), "orders_growth": change("orders")})
            .withColumn("growth_direction",
                        F.when(F.coalesce(F.col("revenue_growth"), F.lit(0.0)) >= 0, "positive")
                         .otherwise("negative"))
            .orderBy("order_year_month"))
