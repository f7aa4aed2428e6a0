"""Derived columns of the order-level master frame.

The frame itself (orders LEFT JOIN items, products, customers, payments,
category translation and reviews, de-duplicated) is kept in factorised form;
see ``plans.fanout``, whose ``master_rows`` returns its literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import elapsed_days, month_period, weekday_name
# Names of the derived columns.
DERIVED_COLUMNS = (
    "order_year", "order_month", "order_year_month", "order_day_of_week",
    "order_hour", "delivery_days", "estimated_delivery_days", "delivery_status",
)


def with_order_attributes(orders: DataFrame) -> DataFrame:
    """Calendar and delivery attributes; they depend on the order row only, so
    they are computed once per order, before the fan-out."""
    ts = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return orders.withColumns({
        "order_year": F.year(ts).cast("bigint"),
        "order_month": F.month(ts).cast("bigint"),
        "order_year_month": month_period(ts),
        "order_day_of_week": weekday_name(ts),
        "order_hour": F.hour(ts).cast("bigint"),
        "delivery_days": elapsed_days(delivered, ts),
        "estimated_delivery_days": elapsed_days(estimated, ts),
        # a NULL comparison is not true, so an undelivered order is 'Late'
        "delivery_status": F.when(delivered <= estimated, "On Time").otherwise("Late"),
    })
