"""Marketplace tables stored as Parquet (one dataset folder per table)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from agora.sources.schemas import COLUMN_TYPES, typed
from agora.tables import MarketplaceTables


def read_marketplace_parquet(spark: SparkSession, folder: str) -> MarketplaceTables:
    """Read ``<folder>/<table>`` Parquet datasets; known columns are cast to
    their declared types (a no-op when the files already carry them)."""
    frames = {}
    for table, types in COLUMN_TYPES.items():
        df = spark.read.parquet(f"{folder.rstrip('/')}/{table}")
        frames[table] = df.withColumns(
            {c: typed(F.col(c), t) for c, t in types.items() if c in df.columns})
    return MarketplaceTables(**frames)
