"""Small reshaping operators applied to already-aggregated results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import pct_of


def with_share(df: DataFrame, value_col: str, out_col: str = "share_pct") -> DataFrame:
    """``value / total * 100`` per row.

    Meant for grouped results (one row per category, state, status ...); the
    empty window collects that small result into one partition, which avoids
    evaluating the upstream plan a second time for the total.
    """
    total = F.sum(value_col).over(Window.partitionBy())
    return df.withColumn(out_col, pct_of(F.col(value_col), total))


def reindex(df: DataFrame, key: str, domain: Sequence[str]) -> DataFrame:
    """Rows for exactly the values in ``domain`` (a fixed, small list), with
    the domain position in ``_order``; keys missing from ``df`` get NULL
    measures.  Only the rows of ``df`` whose key is in the domain are joined.
    """
    spark = df.sparkSession
    dom = spark.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{key} string, _order int")
    return dom.join(df.where(F.col(key).isin(list(domain))), key, "left")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows in ``order`` (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
