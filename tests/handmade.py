"""Tiny in-memory marketplace tables for edge cases."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from agora.tables import MarketplaceTables

ORDERS = ("order_id string, customer_id string, order_status string, "
          "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
          "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
          "order_estimated_delivery_date timestamp_ntz")
ITEMS = ("order_id string, order_item_id int, product_id string, seller_id string, "
         "price decimal(18,2), freight_value decimal(18,2)")
PRODUCTS = ("product_id string, product_category_name string, product_weight_g double, "
            "product_length_cm double")
CUSTOMERS = "customer_id string, customer_unique_id string, customer_state string"
PAYMENTS = ("order_id string, payment_sequential int, payment_type string, "
            "payment_installments int, payment_value decimal(18,2)")
REVIEWS = "order_id string, review_score int"
SELLERS = "seller_id string, seller_city string, seller_state string"
TRANSLATION = "product_category_name string, product_category_name_english string"


def ts(s: str | None) -> datetime | None:
    return None if s is None else datetime.fromisoformat(s)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def order(oid, cid, status, purchase, delivered=None, estimated="2018-01-30 00:00:00"):
    return (oid, cid, status, ts(purchase), ts(purchase), ts(purchase), ts(delivered), ts(estimated))


def tables(spark, orders, items=(), products=(), customers=(), payments=(), reviews=(),
           sellers=(), translation=()) -> MarketplaceTables:
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return MarketplaceTables(
        orders=df(orders, ORDERS), order_items=df(items, ITEMS), products=df(products, PRODUCTS),
        customers=df(customers, CUSTOMERS), payments=df(payments, PAYMENTS),
        reviews=df(reviews, REVIEWS), sellers=df(sellers, SELLERS),
        category_translation=df(translation, TRANSLATION))
