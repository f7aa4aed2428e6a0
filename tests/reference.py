"""The master frame as the workload writes it, in pandas: merge, de-duplicate, fill, derive."""

import pandas as pd

from agora.plans.master import DERIVED_COLUMNS, with_order_attributes


def pandas_master(t) -> pd.DataFrame:
    """Left merges (where NULL keys match each other), then DISTINCT over the whole row."""
    frames = {k: df.toPandas() for k, df in t.as_dict().items()}
    frames["orders"] = with_order_attributes(t.orders).toPandas()
    m = (frames["orders"].merge(frames["order_items"], on="order_id", how="left")
         .merge(frames["products"], on="product_id", how="left")
         .merge(frames["customers"], on="customer_id", how="left")
         .merge(frames["payments"], on="order_id", how="left")
         .merge(frames["category_translation"], on="product_category_name", how="left")
         .merge(frames["reviews"][["order_id", "review_score"]], on="order_id", how="left"))
    m = m.astype(object).where(m.notna(), None).drop_duplicates()
    name = "product_category_name_english"
    m[name] = m[name].where(m[name].notna(), "unknown")
    return m


def literal_rows(spark, t):
    """The same frame as a Spark DataFrame (NULL keys do not match; for inputs without any)."""
    rev = t.reviews.select("order_id", "review_score")
    from pyspark.sql import functions as F

    return (with_order_attributes(t.orders).join(t.order_items, "order_id", "left")
            .join(t.products, "product_id", "left").join(t.customers, "customer_id", "left")
            .join(t.payments, "order_id", "left").join(t.category_translation, "product_category_name", "left")
            .join(rev, "order_id", "left").dropDuplicates()
            .withColumn("product_category_name_english", F.coalesce("product_category_name_english", F.lit("unknown"))))


__all__ = ["DERIVED_COLUMNS", "literal_rows", "pandas_master"]
