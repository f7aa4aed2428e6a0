"""Binning operators: equal-frequency (qcut), fixed-edge (cut) and an
equal-width histogram that also reports empty bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_by_edges(x: Column, edges: Sequence[Column | float], labels: Sequence[int],
                 include_lowest: bool = False) -> Column:
    """Right-closed intervals ``(e0, e1], (e1, e2], ...`` -> ``labels``.

    ``include_lowest`` also puts ``x == e0`` in the first bin.  Values outside
    all intervals (or NULL) give NULL.
    """
    e = [F.lit(v) if not isinstance(v, Column) else v for v in edges]
    if len(labels) != len(e) - 1:
        raise ValueError("need exactly one label per interval")
    first = (x >= e[0]) if include_lowest else (x > e[0])
    expr = None
    for i, label in enumerate(labels):
        cond = (first if i == 0 else (x > e[i])) & (x <= e[i + 1])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.cast("bigint")


def qcut(x: Column, edges: Column, labels: Sequence[int]) -> Column:
    """Equal-frequency binning from exact quantile edges.

    ``edges`` is an array column (usually a scalar subquery) holding the
    ``len(labels) + 1`` quantiles at 0, 1/k, ..., 1 (so min and max are the
    outer edges).  Intervals are right-closed with the minimum included; as in
    an equal-frequency cut, duplicate edges are an error, raised at run time.
    """
    e = [edges[i] for i in range(len(labels) + 1)]
    unique = F.lit(True)
    for a, b in zip(e, e[1:]):
        unique = unique & (a < b)
    binned = bin_by_edges(x, e, labels, include_lowest=True)
    return F.when(unique, binned).otherwise(
        F.raise_error(F.lit("quantile bin edges must be unique")).cast("bigint"))


def equal_width_histogram(df: DataFrame, col: str, bins: int = 50,
                          weight: str | None = None) -> DataFrame:
    """``bins`` equal-width bins over [min, max] of ``col``: (bin, lower, upper, n).

    Bin i holds lower_i <= x < upper_i; the last bin also holds x == max.
    Edges are ``min + i * (max - min) / bins`` (the last edge is max itself);
    a constant column is widened to [v - 0.5, v + 0.5]; an empty input uses
    [0, 1].  Every bin is reported, empty ones with n = 0.  With ``weight``
    each row counts that many times (rows standing for several identical rows).

    Plan: one global min/max aggregate (a scalar subquery, computed once and
    reused), one partial/final count per bin, and a ``bins``-row domain.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    values = (df.select(F.col(col).cast("double").alias("_h_x"), w.alias("_h_w"))
              .where(F.col("_h_x").isNotNull()))
    stats = values.agg(F.min("_h_x").alias("lo0"), F.max("_h_x").alias("hi0"))
    lo0, hi0 = F.col("lo0"), F.col("hi0")
    bounds = stats.select(F.struct(
        F.when(lo0.isNull(), F.lit(0.0)).when(lo0 == hi0, lo0 - 0.5).otherwise(lo0).alias("lo"),
        F.when(hi0.isNull(), F.lit(1.0)).when(lo0 == hi0, hi0 + 0.5).otherwise(hi0).alias("hi"),
    )).scalar()
    lo, hi = F.col("_h_b.lo"), F.col("_h_b.hi")

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi).otherwise(i.cast("double") * ((hi - lo) / F.lit(float(bins))) + lo)

    x = F.col("_h_x")
    guess = F.floor((x - lo) / (hi - lo) * F.lit(float(bins))).cast("bigint")
    binned = (values.withColumn("_h_b", bounds)
              .withColumn("_h_g", F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1)))
              # correct floating-point misplacement against the reported edges
              .withColumn("_h_d", F.when((x < edge(F.col("_h_g"))) & (F.col("_h_g") > 0),
                                         F.col("_h_g") - 1).otherwise(F.col("_h_g")))
              .withColumn("bin", F.when((x >= edge(F.col("_h_d") + 1)) & (F.col("_h_d") < bins - 1),
                                        F.col("_h_d") + 1).otherwise(F.col("_h_d"))))
    counts = binned.groupBy("bin").agg(F.sum("_h_w").alias("n"))

    domain = (df.sparkSession.range(bins).withColumnRenamed("id", "bin")  # fixed size
              .withColumn("_h_b", bounds))
    # counts has at most ``bins`` rows
    return (domain.join(F.broadcast(counts), "bin", "left")
            .select(F.col("bin").cast("bigint").alias("bin"),
                    edge(F.col("bin")).alias("lower"),
                    edge(F.col("bin") + 1).alias("upper"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))
