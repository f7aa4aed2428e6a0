"""Exact quantiles with linear interpolation (the NumPy / SQL ``quantile_cont``
definition): position ``p * (n - 1)``, value ``lo + (hi - lo) * frac``.

Two strategies with the same result:

* ``percentile`` - Spark's exact ``percentile`` aggregate.  Its buffer is a
  value -> count map, and a global aggregate merges all maps in one task, so
  use it only for columns with a bounded number of distinct values (day
  counts, small integers).
* ``rank`` - a scalable global rank (range partitioning, no single task),
  then only the at most ``2 * len(probs)`` rows at the needed ranks are kept.
  Use it for continuous values (money).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.ranking import global_rank


def quantiles_percentile(df: DataFrame, col: str, probs: Sequence[float]) -> Column:
    """Scalar array column of exact quantiles via the ``percentile`` aggregate."""
    return df.select(
        F.percentile(F.col(col).cast("double"), F.array(*[F.lit(float(p)) for p in probs]))
    ).scalar()


def quantiles_by_rank(df: DataFrame, col: str, probs: Sequence[float],
                      tie_break: str) -> Column:
    """Scalar array column of exact quantiles computed from a global rank."""
    values = df.where(F.col(col).isNotNull()).select(
        F.col(col).cast("double").alias("_q_v"), F.col(tie_break).alias("_q_id"))
    ranked = global_rank(values, [F.col("_q_v"), F.col("_q_id")], "_q_rank", "_q_n")
    pos = [(F.col("_q_n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[F.floor(x) for x in pos] + [F.ceil(x) for x in pos])
    picked = ranked.where(F.array_contains(wanted, F.col("_q_rank")))
    # at most 2 * len(probs) rows survive the filter
    edges = []
    for x in pos:
        lo_v = F.max(F.when(F.col("_q_rank") == F.floor(x), F.col("_q_v")))
        hi_v = F.max(F.when(F.col("_q_rank") == F.ceil(x), F.col("_q_v")))
        edges.append(lo_v + (hi_v - lo_v) * (F.max(x) - F.floor(F.max(x))))
    return picked.agg(F.array(*edges)).scalar()
