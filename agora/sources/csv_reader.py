"""Typed CSV scan of a marketplace export folder (header row, RFC-4180 quoting).

Every column is first read as a string (no ``inferSchema`` pass over the
data), then the known columns are cast to their types.  Casting runs under
ANSI mode, so a malformed date or number fails the job instead of turning
into NULL.  Spark's CSV reader drops a UTF-8 byte-order mark on the header.

``multiline=True`` (the default) keeps quoted newlines (free-text fields)
inside one record and still reads every file by many tasks: the files are
scanned once for the quotes that are open at the start of each byte range
(``csv_ranges``).  ``multiline=False`` saves that scan for files known to
have no embedded newlines; ``multiline="whole"`` parses each file in one
task with Spark's multi-line reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.sources.csv_ranges import read_csv_ranges
from agora.sources.schemas import COLUMN_TYPES, typed
from agora.tables import MarketplaceTables


# The strings that a data-frame CSV reader takes for a missing value by default.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_typed_csv(spark: SparkSession, path: str, table: str,
                   multiline: bool | str = True, missing_values: Sequence[str] = MISSING) -> DataFrame:
    """One table; a field that equals one of ``missing_values`` is NULL in every column."""
    if multiline is True:
        raw = read_csv_ranges(spark, path)
    else:
        raw = (spark.read
               .option("header", True)
               .option("multiLine", multiline == "whole")
               .option("escape", '"')
               .option("mode", "FAILFAST")
               .csv(path))
    types = COLUMN_TYPES[table]
    missing = [c for c in types if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    values = {c: F.when(~F.col(c).isin(list(missing_values)), F.col(c)) for c in raw.columns}
    for name, dtype in types.items():
        if dtype.typeName() != "string":  # strings keep their white space
            values[name] = typed(F.trim(values[name]), dtype)
    return raw.withColumns(values)


def read_marketplace_csv(spark: SparkSession, folder: str,
                         files: dict[str, str] | None = None,
                         multiline: bool | str = True,
                         missing_values: Sequence[str] = MISSING) -> MarketplaceTables:
    """Read the eight tables from ``folder``.

    ``files`` maps a table name (``orders``, ``order_items``, ``products``,
    ``customers``, ``payments``, ``reviews``, ``sellers``,
    ``category_translation``) to its file name; the default is
    ``<table>.csv``.
    """
    names = {t: (files or {}).get(t, f"{t}.csv") for t in COLUMN_TYPES}
    frames = {t: read_typed_csv(spark, f"{folder.rstrip('/')}/{f}", t, multiline, missing_values)
              for t, f in names.items()}
    return MarketplaceTables(**frames)
