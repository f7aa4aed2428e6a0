"""Map the driver's TPC-H-like Parquet tables onto the marketplace model.

The test tables carry no marketplace columns, no NULLs and no clock times, so
each marketplace column is one deterministic expression of TPC-H columns
(see FIXTURES.md, section C).  The same mapping is written independently as
SQL for the DuckDB oracle in ``checks/oracle.py``.

Scale notes: every view is a narrow projection of one scan except
``customers`` and ``sellers``, which join ``nation``; Spark picks the join from
its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.sources.schemas import MONEY
from agora.tables import MarketplaceTables


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_orders(orders: DataFrame) -> DataFrame:
    k, day, status = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    delivered_at = (F.when((status == "F") & (k % 17 != 0),
                           day + _days(k % 29) + _hours(F.lit(23))))
    return orders.select(
        k.alias("order_id"),
        (k + 1000000).alias("customer_id"),
        F.when(status == "F", "delivered").when(status == "O", "shipped")
         .otherwise("processing").alias("order_status"),
        (day + _hours(k % 24)).alias("order_purchase_timestamp"),
        (day + _hours(k % 24 + 1)).alias("order_approved_at"),
        (day + _days(1 + k % 3)).alias("order_delivered_carrier_date"),
        delivered_at.alias("order_delivered_customer_date"),
        (day + _days(20 + k % 7)).alias("order_estimated_delivery_date"),
    )


def map_customers(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    cust = customer.select("c_custkey", "c_nationkey").join(
        nation.select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey"))
    return (orders.select("o_orderkey", "o_custkey")
            .join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .select((F.col("o_orderkey") + 1000000).alias("customer_id"),
                    F.col("o_custkey").alias("customer_unique_id"),
                    F.col("n_name").alias("customer_state")))


def map_order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("freight_value"),
    )


def map_payments(orders: DataFrame) -> DataFrame:
    k, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    paid = orders.where(k % 23 != 0)
    first = paid.select(
        k.alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.when(prio == "3-MEDIUM", "boleto").when(prio == "4-NOT SPECIFIED", "debit_card")
         .when(prio == "5-LOW", "voucher").otherwise("credit_card").alias("payment_type"),
        (1 + k % 10).cast("int").alias("payment_installments"),
        F.col("o_totalprice").cast(MONEY).alias("payment_value"),
    )
    second = paid.where(k % 7 == 0).select(
        k.alias("order_id"),
        F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        (10 + k % 90).cast(MONEY).alias("payment_value"),
    )
    return first.unionByName(second)


def map_reviews(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reviewed = orders.where(k % 11 != 0)
    first = reviewed.select(k.alias("order_id"),
                            (1 + (k * 7 + c) % 5).cast("int").alias("review_score"))
    # even keys repeat the first score (collapses in the de-duplication),
    # odd keys get a different one (fans out)
    second = reviewed.where(k % 13 == 0).select(
        k.alias("order_id"), (1 + (k * 7 + c + k % 2) % 5).cast("int").alias("review_score"))
    return first.unionByName(second)


def map_products(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        key.alias("product_id"),
        F.when(key % 31 != 0, F.col("p_brand")).alias("product_category_name"),
        (F.col("p_size") * 100).cast("double").alias("product_weight_g"),
        (F.col("p_size") + key % 20).cast("double").alias("product_length_cm"),
    )


def map_category_translation(part: DataFrame) -> DataFrame:
    return (part.where(F.col("p_brand") != "Brand#25")
            .select(F.col("p_brand").alias("product_category_name"),
                    F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
                    .alias("product_category_name_english"))
            .distinct())


def map_sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return (supplier.join(nation.select("n_nationkey", "n_name"),
                          F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("seller_id"),
                    F.col("s_name").alias("seller_city"),
                    F.col("n_name").alias("seller_state")))


def tpch_marketplace(spark: SparkSession, sf_dir: str) -> MarketplaceTables:
    """Marketplace view of ``sf_dir``'s TPC-H-like tables (lazy)."""
    orders = _read(spark, sf_dir, "orders")
    nation = _read(spark, sf_dir, "nation")
    part = _read(spark, sf_dir, "part")
    return MarketplaceTables(
        orders=map_orders(orders),
        order_items=map_order_items(_read(spark, sf_dir, "lineitem")),
        products=map_products(part),
        customers=map_customers(orders, _read(spark, sf_dir, "customer"), nation),
        payments=map_payments(orders),
        reviews=map_reviews(orders),
        sellers=map_sellers(_read(spark, sf_dir, "supplier"), nation),
        category_translation=map_category_translation(part),
    )
