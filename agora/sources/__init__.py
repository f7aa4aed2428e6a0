"""Readers for the marketplace tables, the TPC-H test mapping and sinks."""

from agora.sources.csv_reader import read_marketplace_csv
from agora.sources.parquet_reader import read_marketplace_parquet
from agora.sources.tpch_fixture import tpch_marketplace

__all__ = ["read_marketplace_csv", "read_marketplace_parquet", "tpch_marketplace"]
