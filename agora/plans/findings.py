"""Figures stated in the workload's report without code of their own, derived
from the same delivered master rows (script grain) or payment grain (SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import null_if_zero, pct_of
from agora.operators.reshape import with_share
from agora.plans.fanout import (CATEGORY, Fanout, fan_sum, pay_on_items, pay_on_orders,
                                pay_rows_on_orders, w_orders, weighted_mean)
from agora.plans.payment_grain import payment_methods
from agora.tables import MarketplaceTables

MONTHS = list(range(1, 13))


def top_category_share(fd: Fanout, k: int = 5) -> DataFrame:
    """Revenue of the ``k`` largest categories and their share of all revenue."""
    per_cat = fd.items.groupBy(CATEGORY).agg(
        F.coalesce(F.sum(pay_on_items()), F.lit(0)).alias("rev"))
    total = fd.orders.select(F.coalesce(F.sum(pay_on_orders()), F.lit(0))).scalar()
    top = per_cat.orderBy(F.desc("rev"), F.asc(CATEGORY)).limit(k)  # k rows at most
    return top.agg(F.count(F.lit(1)).alias("categories"),
                   F.sum("rev").alias("_top")).select(
        "categories",
        F.col("_top").cast("double").alias("top_revenue"),
        total.cast("double").alias("total_revenue"),
        pct_of(F.col("_top"), total).alias("share_pct"))


def peak_hour_share(fd: Fanout, start: int = 10, end: int = 22) -> DataFrame:
    """Share of payment rows (the hourly report's order count) placed in
    hours ``start`` .. ``end - 1``."""
    in_band = F.col("order_hour").between(start, end - 1)
    rows = pay_rows_on_orders()
    return fd.orders.agg(
        F.coalesce(F.sum(F.when(in_band, rows)), F.lit(0)).alias("peak_orders"),
        F.coalesce(F.sum(rows), F.lit(0)).alias("total_orders")).select(
        "peak_orders", "total_orders", pct_of(F.col("peak_orders"), F.col("total_orders"))
        .alias("share_pct"))


def yearly_revenue(fd: Fanout) -> DataFrame:
    """Revenue and distinct orders per year, with the ratio to the previous year."""
    per_year = (fd.orders.where(F.col("order_year").isNotNull())
                .groupBy("order_year")
                .agg(fan_sum(pay_on_orders()).alias("revenue"),
                     F.countDistinct("order_id").alias("orders")))
    w = Window.orderBy("order_year")  # one row per year
    return per_year.withColumn(
        "growth_ratio", F.col("revenue") / null_if_zero(F.lag("revenue").over(w))
    ).orderBy("order_year")


def revenue_pivot(fd: Fanout) -> DataFrame:
    """Revenue per year (rows) and month (columns m01 .. m12); 0 for a month
    without rows.  The month list is fixed, so the pivot needs no extra pass."""
    pivot = (fd.orders.where(F.col("order_year").isNotNull())
             .groupBy("order_year")
             .pivot("order_month", MONTHS)
             .agg(fan_sum(pay_on_orders())))
    return pivot.select("order_year", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"m{m:02d}")
                                        for m in MONTHS]).orderBy("order_year")


def state_delivery_days(dd: DataFrame) -> DataFrame:
    """Mean delivery days and rows for every customer state (slowest first)."""
    return (dd.where(F.col("customer_state").isNotNull())
            .groupBy("customer_state")
            .agg(weighted_mean(F.col("delivery_days") * w_orders(), w_orders())
                 .alias("avg_delivery_days"),
                 F.sum(w_orders()).alias("rows"))
            .orderBy(F.desc("avg_delivery_days"), "customer_state"))


def payment_share(t: MarketplaceTables) -> DataFrame:
    """Payment methods at payment grain with each type's share of orders."""
    return with_share(payment_methods(t), "total_orders").orderBy(F.desc("total_orders"), "payment_type")
