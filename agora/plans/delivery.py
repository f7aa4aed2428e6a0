"""Delivery punctuality over delivered order rows with both day counts and a
positive delivery time (``Fanout.delivery_rows``).

Delivery columns belong to the order, so each order row stands for
``n_items * n_pays * n_revs`` master rows; every statistic is weighted by
that count (an exact weighted median is Spark's ``percentile`` with a
frequency argument).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import pct_of
from agora.operators.binning import equal_width_histogram
from agora.operators.reshape import top_n, with_share
from agora.plans.fanout import rev_on_orders, rev_rows_on_orders, w_orders, weighted_mean

HISTOGRAM_BINS = 50


def delivery_kpis(dd: DataFrame) -> DataFrame:
    """avg_days, exact median_days and on_time_pct.  The median uses Spark's
    exact ``percentile``; day counts have a bounded number of distinct values."""
    w = w_orders()
    return dd.agg(
        weighted_mean(F.col("delivery_days") * w, w).alias("avg_days"),
        F.percentile(F.col("delivery_days").cast("double"), F.lit(0.5), w).alias("median_days"),
        pct_of(F.sum(F.when(F.col("delivery_status") == "On Time", w).otherwise(0)), F.sum(w))
        .alias("on_time_pct"))


def delivery_histogram(dd: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of delivery days, empty bins included."""
    weighted = dd.withColumn("_w", w_orders())
    return equal_width_histogram(weighted, "delivery_days", bins, weight="_w").orderBy("bin")


def delivery_status_share(dd: DataFrame) -> DataFrame:
    """Master rows per delivery status and their share in percent."""
    counts = dd.groupBy("delivery_status").agg(F.sum(w_orders()).alias("rows"))
    return with_share(counts, "rows").orderBy(F.desc("rows"), "delivery_status")


def slowest_states(dd: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` customer states with the longest mean delivery time."""
    per_state = (dd.where(F.col("customer_state").isNotNull())
                 .groupBy("customer_state")
                 .agg(weighted_mean(F.col("delivery_days") * w_orders(), w_orders())
                      .alias("avg_delivery_days")))
    return top_n(per_state, n, F.desc("avg_delivery_days"), F.asc("customer_state"))


def review_by_delivery(dd: DataFrame) -> DataFrame:
    """Mean review score of on-time versus late rows."""
    return (dd.groupBy("delivery_status")
            .agg(weighted_mean(rev_on_orders(), rev_rows_on_orders()).alias("avg_review_score"))
            .orderBy("delivery_status"))
