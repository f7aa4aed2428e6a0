"""Pearson correlation from centred co-moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(n: Column, sum_a: Column, sum_b: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """Correlation from co-moments about any centre close to the means; the sums of the deviations
    take out what the centre misses.  NULL for a constant column or without rows."""
    cov, var_a, var_b = ab - sum_a * sum_b / n, aa - sum_a * sum_a / n, bb - sum_b * sum_b / n
    return F.when((n > 0) & (var_a > 0) & (var_b > 0), cov / (F.sqrt(var_a) * F.sqrt(var_b)))


def correlation_from_moments(moments: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """Long-form Pearson matrix (col_a, col_b, corr, is_lower) from a one-row frame with the
    columns n, s_<c> and p_<a>__<b> (a before b in ``cols``, squares included), rounded to
    ``digits`` decimals if given."""
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            ab = f"p_{a}__{b}" if i <= j else f"p_{b}__{a}"
            corr = pearson(*[F.col(c).cast("double") for c in ("n", f"s_{a}", f"s_{b}", ab, f"p_{a}__{a}", f"p_{b}__{b}")])
            rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                 (corr if digits is None else F.round(corr, digits)).alias("corr"),
                                 F.lit(i > j).alias("is_lower")))
    return moments.select(F.inline(F.array(*rows)))
