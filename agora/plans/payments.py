"""Payment methods over delivered rows (payment side of the fan-out)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators.reshape import with_share
from agora.plans.fanout import Fanout, fan_sum, w_pays, weighted_mean


def payment_methods(fd: Fanout) -> DataFrame:
    """Per payment type: distinct orders (``count``), total_value, avg_value
    (mean per master row) and share_pct of ``count``."""
    value = F.col("payment_value")
    per_type = (fd.payments.where(F.col("payment_type").isNotNull())
                .groupBy("payment_type")
                .agg(F.countDistinct("order_id").alias("count"),
                     fan_sum(value * w_pays()).alias("total_value"),
                     weighted_mean(value * w_pays(), F.when(value.isNotNull(), w_pays())
                                   .otherwise(0)).alias("avg_value")))
    return with_share(per_type, "count").orderBy(F.desc("count"), "payment_type")
