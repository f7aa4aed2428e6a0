"""Seller performance and revenue concentration (item side of the fan-out)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import pct_of
from agora.operators.selection import top_sum
from agora.plans.fanout import (Fanout, fan_sum, pay_on_items, rev_on_items, rev_rows_on_items,
                                weighted_mean)
from agora.session import checkpoint_dir, stage


TOP_SELLERS = 50  # fixed value: rows of the top-seller summary


def seller_performance(fd: Fanout) -> DataFrame:
    """Per seller: total_revenue, distinct orders, avg_review,
    avg_delivery_days, distinct products; by revenue descending.

    Item rows are first reduced to one row per (seller, order) and one per (seller, product);
    the distinct counts are then plain counts, and no row is expanded."""
    pr = F.col("n_pays") * F.col("n_revs")
    items = fd.items.where(F.col("seller_id").isNotNull())
    per_order = items.groupBy("seller_id", "order_id").agg(
        F.sum(pay_on_items()).alias("pay"),
        F.sum(rev_on_items()).alias("rev"), F.sum(rev_rows_on_items()).alias("rev_rows"),
        F.sum(F.col("dd_sum_del") * pr).alias("days"), F.sum(F.col("dd_cnt_del") * pr).alias("day_rows"))
    sums = per_order.groupBy("seller_id").agg(
        fan_sum(F.col("pay")).alias("total_revenue"), F.count("order_id").alias("total_orders"),
        weighted_mean(F.col("rev"), F.col("rev_rows")).alias("avg_review"),
        weighted_mean(F.col("days"), F.col("day_rows")).alias("avg_delivery_days"))
    products = (items.select("seller_id", "product_id").distinct()
                .groupBy("seller_id").agg(F.count("product_id").alias("products_sold")))
    return sums.join(products, "seller_id").orderBy(F.desc("total_revenue"), "seller_id")


def top_sellers(fd: Fanout, n: int = TOP_SELLERS) -> DataFrame:
    """The first ``n`` rows of :func:`seller_performance`."""
    return seller_performance(fd).limit(n)


def seller_concentration(fd: Fanout, top_fraction: float = 0.1) -> DataFrame:
    """One row: sellers, top_seller_revenue, top_decile_revenue (sum over the
    first ``floor(sellers * top_fraction)`` sellers by revenue) and
    top_decile_pct of the KPI revenue (which includes rows without seller).

    The top-k sum is tie-independent; k grows with the data, so the k-th
    largest revenue is selected by histograms and the larger ones are summed;
    no seller is ranked.
    """
    checkpoint_dir(fd.items.sparkSession)
    per_seller = (fd.items.groupBy("seller_id")
                  .agg(F.coalesce(F.sum(pay_on_items()), F.lit(0)).alias("revenue")))
    per_seller = stage(per_seller)  # read by the total and by the passes of the selection
    total = per_seller.select(F.sum("revenue")).scalar()
    sellers = per_seller.where(F.col("seller_id").isNotNull())
    _, top = top_sum(sellers, F.col("revenue"), lambda n: int(n * top_fraction))
    row = sellers.agg(F.count(F.lit(1)).alias("sellers"),
                      F.max("revenue").cast("double").alias("top_seller_revenue"),
                      F.lit(top if top is not None else 0).alias("_top"))
    return row.select("sellers", "top_seller_revenue",
                      F.col("_top").cast("double").alias("top_decile_revenue"),
                      pct_of(F.col("_top"), total).alias("top_decile_pct"))
