"""Types of the columns the analyses use, per marketplace table.

Columns not listed here are carried as strings: they take part in the
full-row de-duplication of the master frame but are never computed on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Column names of the workload's tables.
TIMESTAMP_COLUMNS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)

COLUMN_TYPES: dict[str, dict[str, T.DataType]] = {
    "orders": {
        "order_id": T.StringType(),
        "customer_id": T.StringType(),
        "order_status": T.StringType(),
        **{c: T.TimestampNTZType() for c in TIMESTAMP_COLUMNS},
    },
    "order_items": {
        "order_id": T.StringType(),
        "order_item_id": T.IntegerType(),
        "product_id": T.StringType(),
        "seller_id": T.StringType(),
        "price": MONEY,
        "freight_value": MONEY,
    },
    "products": {
        "product_id": T.StringType(),
        "product_category_name": T.StringType(),
        "product_weight_g": T.DoubleType(),
        "product_length_cm": T.DoubleType(),
    },
    "customers": {
        "customer_id": T.StringType(),
        "customer_unique_id": T.StringType(),
        "customer_state": T.StringType(),
    },
    "payments": {
        "order_id": T.StringType(),
        "payment_sequential": T.IntegerType(),
        "payment_type": T.StringType(),
        "payment_installments": T.IntegerType(),
        "payment_value": MONEY,
    },
    "reviews": {
        "order_id": T.StringType(),
        "review_score": T.IntegerType(),
    },
    "sellers": {
        "seller_id": T.StringType(),
        "seller_city": T.StringType(),
        "seller_state": T.StringType(),
    },
    "category_translation": {
        "product_category_name": T.StringType(),
        "product_category_name_english": T.StringType(),
    },
}


def typed(column: Column, dtype: T.DataType) -> Column:
    """Cast to a declared type.  A money value that has more than two decimals or too many digits
    raises an error; it is never rounded."""
    if dtype != MONEY:
        return column.cast(dtype)
    money, whole = column.cast(MONEY), column.cast("decimal(38,18)")
    wrong = F.raise_error(F.concat(F.lit("not an amount with two decimals: "), column.cast("string")))
    return F.when(whole.isNull() | (whole == money), money).otherwise(wrong.cast(MONEY))
