"""Verification helpers (DuckDB oracle SQL and a Spark-vs-oracle comparer)."""
