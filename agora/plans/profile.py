"""Data profiling (row counts, missing values) and the correlation study."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.joins import join_on_key
from agora.operators.stats import correlation_from_moments
from agora.plans.fanout import Fanout, w_items, w_orders, w_pays, w_revs
from agora.session import stage
from agora.tables import MarketplaceTables

# Measures of the correlation study, in report order; the side each lives on.
CORRELATION_COLUMNS = ["price", "freight_value", "payment_value", "review_score",
                       "delivery_days", "product_weight_g", "product_length_cm"]
_SIDE_OF = {"price": "i", "freight_value": "i", "product_weight_g": "i", "product_length_cm": "i",
            "payment_value": "p", "review_score": "r", "delivery_days": "o"}

# Bookkeeping columns of the factorised sides (not master columns).
HELPER_COLUMNS = {"n_oc", "n_oc_del", "dd_sum_del", "dd_cnt_del", "n_items", "n_pays", "n_revs",
                  "pay_sum", "pay_cnt", "rev_sum", "rev_cnt", "has_delivered"}


def dataset_counts(t: MarketplaceTables, fa: Fanout) -> DataFrame:
    """(dataset, rows) for six raw tables, the master frame and its delivered
    part; master rows are the products of the per-order row counts, so no side is built."""
    named = [("orders", t.orders), ("order_items", t.order_items), ("products", t.products),
             ("customers", t.customers), ("payments", t.payments), ("reviews", t.reviews)]
    counts = [df.agg(F.count(F.lit(1)).alias("rows"))
                .select(F.lit(name).alias("dataset"), F.col("rows").cast("bigint"))
              for name, df in named]
    for name, per_order in (("master", fa.per_order), ("delivered", fa.delivered().per_order)):
        counts.append(per_order.agg(F.coalesce(F.sum(F.col("n_oc") * w_orders()), F.lit(0)).alias("rows"))
                      .select(F.lit(name).alias("dataset"), F.col("rows").cast("bigint")))
    return reduce(DataFrame.unionByName, counts)


def missing_values(fa: Fanout) -> DataFrame:
    """(column, nulls) for master columns with at least one NULL: each
    side row with a NULL stands for as many master rows as its weight."""
    parts = []
    for side, weight, skip in ((fa.orders, w_orders(), set()),
                               (fa.items, w_items(), {"order_id"}),
                               (fa.payments, w_pays(), {"order_id"}),
                               (fa.reviews, w_revs(), {"order_id"})):
        cols = [c for c in side.columns if c not in HELPER_COLUMNS and c not in skip]
        sums = side.agg(*[F.coalesce(F.sum(F.when(F.col(c).isNull(), weight)), F.lit(0))
                          .cast("bigint").alias(c) for c in cols])
        parts.append(sums.unpivot([], cols, "column", "nulls"))
    return (reduce(DataFrame.unionByName, parts)
            .where(F.col("nulls") > 0)
            .select("column", F.col("nulls").cast("bigint").alias("nulls")))


def _per_order(fd: Fanout) -> DataFrame:
    """One row per order that has complete rows on every side: per side its rows (c_<side>), the
    means of its measures (m_<measure>) and their co-moments about these (q_<a>__<b>). Spark's
    covariance buffers are merged by (n, means, co-moment), so one pass gives them without
    cancellation."""
    frames = {"i": fd.items, "o": fd.orders, "p": fd.payments, "r": fd.reviews}
    parts = []
    for s, side in frames.items():
        measures = [c for c in CORRELATION_COLUMNS if _SIDE_OF[c] == s]
        src = side.dropna(subset=measures).select("order_id", *[F.col(c).cast("double").alias(c) for c in measures])
        rows = F.count(F.lit(1))
        aggs = [rows.alias(f"c_{s}"), *[F.avg(c).alias(f"m_{c}") for c in measures]]
        aggs += [(F.covar_pop(a, b) * rows).alias(f"q_{a}__{b}") for a, b in combinations_with_replacement(measures, 2)]
        parts.append(src.groupBy("order_id").agg(*aggs))
    return reduce(lambda a, b: join_on_key(a, b, "order_id"), parts)


def _others(*sides: str) -> Column:
    """Rows that the remaining sides multiply a combination by."""
    return reduce(lambda a, b: a * b, [F.col(f"c_{s}").cast("double") for s in "iopr" if s not in sides], F.lit(1.0))


def correlation(fd: Fanout, digits: int | None = 10) -> DataFrame:
    """Pearson matrix of the seven measures over delivered master rows with
    no NULL among them (listwise), long form, to ``digits`` decimals (None: unrounded).

    A master row combines one row of each side, and the row survives iff
    each side's own measures are non-NULL, so an order's master rows are the
    product of its side rows: their number is the product of the sides' rows,
    measures of different sides have no co-moment within an order, and those
    of one side have that side's times the other sides' rows; nothing of size
    items x payments is formed.  The sides are read and joined once, into one
    buffer (rows, means, co-moments) per order, which is written; the buffers
    are then merged about the mean of all rows in two passes over this table
    alone.  Everything is taken about means in DOUBLE, so neither large values
    nor small differences cancel.  The last bits depend on the order of
    summation, which is why the reported figures are rounded.
    """
    cols = CORRELATION_COLUMNS
    orders = stage(_per_order(fd).withColumn("rows", _others()))
    n = F.sum("rows")
    centre = orders.agg(F.struct(*[
        F.coalesce(F.sum(F.col(f"m_{c}") * F.col("rows")) / F.when(n != 0, n), F.lit(0.0)).alias(c) for c in cols])).scalar()
    off = {c: F.col(f"m_{c}") - F.col("centre")[c] for c in cols}
    sums = [n.alias("n"), *[F.sum(off[c] * F.col("rows")).alias(f"s_{c}") for c in cols]]
    for a, b in combinations_with_replacement(cols, 2):
        between = off[a] * off[b] * F.col("rows")
        side = _SIDE_OF[a]
        within = F.col(f"q_{a}__{b}") * _others(side) if side == _SIDE_OF[b] else F.lit(0.0)
        sums.append(F.sum(between + within).alias(f"p_{a}__{b}"))
    return correlation_from_moments(orders.withColumn("centre", centre).agg(*sums), cols, digits)
