"""Review score distribution and monthly satisfaction (delivered rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.plans.fanout import Fanout, rev_on_orders, rev_rows_on_orders, w_revs, weighted_mean


def review_distribution(fd: Fanout) -> DataFrame:
    """Master rows per review score (fan-out rows, NULL scores skipped)."""
    return (fd.reviews.where(F.col("review_score").isNotNull())
            .groupBy(F.col("review_score").cast("bigint").alias("review_score"))
            .agg(F.sum(w_revs()).alias("rows"))
            .orderBy("review_score"))


def monthly_review(fd: Fanout) -> DataFrame:
    """Mean review score per ``yyyy-MM`` (NULL for a month without scores)."""
    return (fd.orders.where(F.col("order_year_month").isNotNull())
            .groupBy("order_year_month")
            .agg(weighted_mean(rev_on_orders(), rev_rows_on_orders()).alias("avg_review_score"))
            .orderBy("order_year_month"))
