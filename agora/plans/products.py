"""Category revenue and category satisfaction (item side of the fan-out)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.reshape import top_n
from agora.plans.fanout import (CATEGORY, Fanout, fan_sum, pay_on_items, rev_on_items,
                                rev_rows_on_items, weighted_mean)


def top_categories(fd: Fanout, n: int = 15) -> DataFrame:
    """Top ``n`` categories by revenue: revenue, distinct orders, avg_review."""
    per_cat = fd.items.groupBy(CATEGORY).agg(
        fan_sum(pay_on_items()).alias("revenue"),
        F.countDistinct("order_id").alias("orders"),
        weighted_mean(rev_on_items(), rev_rows_on_items()).alias("avg_review"))
    return top_n(per_cat, n, F.desc("revenue"), F.asc(CATEGORY))


def category_reviews(fd: Fanout, min_orders: int = 100) -> DataFrame:
    """Categories with at least ``min_orders`` distinct orders, by avg_review."""
    return (fd.items.groupBy(CATEGORY)
            .agg(weighted_mean(rev_on_items(), rev_rows_on_items()).alias("avg_review"),
                 F.countDistinct("order_id").alias("total_orders"))
            .where(F.col("total_orders") >= min_orders)
            .orderBy(F.desc_nulls_last("avg_review"), F.asc(CATEGORY)))


def best_categories(fd: Fanout, n: int = 10, min_orders: int = 100) -> DataFrame:
    """The first ``n`` rows of :func:`category_reviews`."""
    return top_n(category_reviews(fd, min_orders), n,
                 F.desc_nulls_last("avg_review"), F.asc(CATEGORY))


def worst_categories(fd: Fanout, n: int = 10, min_orders: int = 100) -> DataFrame:
    """The last ``n`` rows of :func:`category_reviews` (lowest ratings;
    categories without any rating sort last there, so they come first here)."""
    bottom = top_n(category_reviews(fd, min_orders), n,
                   F.asc_nulls_first("avg_review"), F.desc(CATEGORY))
    return bottom.orderBy(F.desc_nulls_last("avg_review"), F.asc(CATEGORY))
