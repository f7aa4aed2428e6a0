"""agora: marketplace analytics on Spark DataFrames.

Layout
------
``agora.sources``    typed readers (CSV, Parquet), the TPC-H test mapping, sinks
``agora.functions``  column expressions (elapsed days, exact means, rounding)
``agora.operators``  reusable DataFrame operators (global rank / NTILE, qcut,
                     histogram, correlation, null profile, shares)
``agora.plans``      the order-level master frame, the script-style analyses
                     (``py_*``) and the SQL-style queries (``sql_*``)
``agora.streaming``  note on streaming (the workload is batch only)
"""

from agora.tables import MarketplaceTables

__all__ = ["MarketplaceTables"]
