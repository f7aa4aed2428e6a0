"""Repeat purchasing: customer types, repeat rate, order-count distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import pct_of
from agora.operators.reshape import top_n, with_share
from agora.plans.fanout import Fanout


def customer_orders(fd: Fanout) -> DataFrame:
    """Distinct delivered orders per ``customer_unique_id`` (distinct counts
    need no fan-out weights)."""
    return (fd.orders.where(F.col("customer_unique_id").isNotNull())
            .groupBy("customer_unique_id")
            .agg(F.countDistinct("order_id").alias("total_orders")))


def customer_loyalty(fd: Fanout) -> DataFrame:
    """customer_type (Repeat: more than one order), customers, share_pct."""
    typed = customer_orders(fd).select(
        F.when(F.col("total_orders") > 1, "Repeat").otherwise("One-time").alias("customer_type"))
    counts = typed.groupBy("customer_type").agg(F.count(F.lit(1)).alias("customers"))
    return with_share(counts, "customers").orderBy(F.desc("customers"), "customer_type")


def repeat_rate(fd: Fanout) -> DataFrame:
    """One row: percentage of customers with more than one order."""
    return customer_orders(fd).agg(
        pct_of(F.count_if(F.col("total_orders") > 1), F.count(F.lit(1))).alias("repeat_rate"))


def order_frequency(fd: Fanout, n: int = 10) -> DataFrame:
    """Customers per order count, for the ``n`` smallest order counts."""
    dist = customer_orders(fd).groupBy("total_orders").agg(F.count(F.lit(1)).alias("customers"))
    return top_n(dist, n, F.asc("total_orders"))
