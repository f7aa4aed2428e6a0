"""Several exact distinct counts of one pass, without expanding its rows.

``count(distinct a), count(distinct b)`` in one aggregate makes Spark copy every row once per
count. Here rows are reduced to the pairs (a, b) of a group, the first pair of each ``a`` is marked,
and the marks travel as a sum through the reduction to one row per ``b``; a group then counts its
rows and adds up its marks. Every step reduces inside the tasks before it shuffles, and a large
group is spread by ``a`` and ``b`` until its last, small, sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = "_first_pair"


def sums_with_distincts(rows: DataFrame, groups: Sequence[str], a: tuple[str, str], b: tuple[str, str],
                        sums: dict[str, Column], null_a: bool = True) -> DataFrame:
    """Per ``groups`` (none: one row for all): the named sums and the distinct non-NULL values of
    the columns ``a`` and ``b``, each given as (column, name of its count).

    ``null_a=False`` promises that ``a`` is never NULL, which saves reading ``rows`` twice. Pairs
    of rows without ``a`` take no part in the marking, so they are no hot group of it."""
    (a_col, a_name), (b_col, b_name) = a, b
    again = {name: F.sum(name).alias(name) for name in sums}
    reduced = rows.groupBy(*groups, a_col, b_col).agg(*[s.alias(n) for n, s in sums.items()])
    known = reduced.where(F.col(a_col).isNotNull()) if null_a else reduced
    order = Window.partitionBy(*groups, a_col).orderBy(b_col)
    marked = known.withColumn(_MARK, (F.row_number().over(order) == 1).cast("bigint")).drop(a_col)
    if null_a:
        marked = marked.unionByName(reduced.where(F.col(a_col).isNull()).withColumn(_MARK, F.lit(0).cast("bigint")).drop(a_col))
    per_b = marked.groupBy(*groups, b_col).agg(*again.values(), F.sum(_MARK).alias(_MARK))
    return per_b.groupBy(*groups).agg(F.coalesce(F.sum(_MARK), F.lit(0)).cast("bigint").alias(a_name),
                                      F.count(b_col).alias(b_name), *again.values())
