"""Recency / frequency / monetary scoring and segments (script rules).

* reference date = latest delivered purchase + 1 day;
* recency = whole days from the customer's last purchase to it (floored),
  frequency = distinct orders, monetary = fan-out payment sum (0 if none);
* R = equal-frequency quintile of recency, labels reversed (most recent = 5);
  F = fixed edges 0,1,2,3,5,inf; M = equal-frequency quintile of monetary;
* the first matching segment rule wins.

Plan: one shuffle by customer over the order side of the factorised master
builds the per-customer table (monetary = sum of pay_sum * n_items * n_revs),
which is written once (``session.stage``) because several passes read it;
recency quintiles use Spark's exact ``percentile`` (day counts: a bounded
number of distinct values), monetary quintiles are selected by histograms
of narrowing ranges (no sort).  The edge arrays are bound once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions import elapsed_days, exact_mean
from agora.operators.binning import bin_by_edges, qcut
from agora.operators.quantiles import quantiles_percentile
from agora.operators.selection import quantiles_by_selection
from agora.plans.fanout import Fanout, pay_on_orders
from agora.session import checkpoint_dir, stage

QUINTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
# Frequency score edges (right-closed) and their scores.
FREQUENCY_EDGES = [0.0, 1.0, 2.0, 3.0, 5.0, float("inf")]
FREQUENCY_LABELS = [1, 2, 3, 4, 5]


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Segment name; rules are tried in this order and the first match wins."""
    # The segment rules and names.
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
            .when((r >= 4) & (f <= 2), "New Customers")
            .when((r >= 3) & (f >= 1) & (m >= 2), "Potential Loyalists")
            .when((r <= 2) & (f >= 3), "At Risk")
            .when((r <= 2) & (f <= 2) & (m <= 2), "Lost")
            .when((r <= 2) & (f >= 2) & (m >= 2), "Cant Lose Them")
            .otherwise("Need Attention"))


def rfm_scored(fd: Fanout) -> DataFrame:
    """Per-customer RFM table; ``monetary_exact`` keeps the exact DECIMAL sum
    (payments of the customer's order rows times their item and review fan-out)."""
    d = fd.orders
    checkpoint_dir(d.sparkSession)
    ts = F.col("order_purchase_timestamp")
    reference = d.select(F.max(ts) + F.make_dt_interval(F.lit(1))).scalar()
    base = (d.where(F.col("customer_unique_id").isNotNull())
            .groupBy("customer_unique_id")
            .agg(F.max(ts).alias("last_purchase"),
                 F.countDistinct("order_id").alias("frequency"),
                 F.coalesce(F.sum(pay_on_orders()), F.lit(0)).alias("monetary_exact"))
            .select("customer_unique_id",
                    elapsed_days(reference, F.col("last_purchase")).alias("recency"),
                    "frequency", "monetary_exact"))
    base = stage(base)  # read by three passes

    r_edges = quantiles_percentile(base, "recency", QUINTILES)
    m_edges = quantiles_by_selection(base, F.col("monetary_exact").cast("double"), QUINTILES)
    # bind each edge array once; the scores then refer to the column, so the
    # quantile subqueries appear once in the plan however often they are used
    scored = (base.withColumns({"_r_edges": r_edges, "_m_edges": m_edges})
              .withColumns({
                  "R_score": qcut(F.col("recency").cast("double"), F.col("_r_edges"), [5, 4, 3, 2, 1]),
                  "F_score": bin_by_edges(F.col("frequency").cast("double"), FREQUENCY_EDGES,
                                          FREQUENCY_LABELS),
                  "M_score": qcut(F.col("monetary_exact").cast("double"), F.col("_m_edges"),
                                  [1, 2, 3, 4, 5]),
              })
              .drop("_r_edges", "_m_edges"))
    return scored.withColumns({
        "RFM_score": F.col("R_score") + F.col("F_score") + F.col("M_score"),
        "segment": segment_of(F.col("R_score"), F.col("F_score"), F.col("M_score")),
    })


def rfm(scored: DataFrame) -> DataFrame:
    """customer_unique_id, recency, frequency, monetary, R/F/M scores,
    RFM_score, segment of the table that :func:`rfm_scored` gives."""
    return scored.select(
        "customer_unique_id", "recency", "frequency",
        F.col("monetary_exact").cast("double").alias("monetary"),
        "R_score", "F_score", "M_score", "RFM_score", "segment")


def rfm_segments(scored: DataFrame) -> DataFrame:
    """Per segment: customers and mean recency / frequency / monetary."""
    return (scored.groupBy("segment")
            .agg(F.count("customer_unique_id").alias("count"),
                 exact_mean("recency").alias("avg_recency"),
                 exact_mean("frequency").alias("avg_frequency"),
                 exact_mean("monetary_exact").alias("avg_monetary"))
            .orderBy(F.desc("count"), "segment"))


def segment_spend(scored: DataFrame) -> DataFrame:
    """Mean monetary value per segment, ascending."""
    return (scored.groupBy("segment")
            .agg(exact_mean("monetary_exact").alias("avg_monetary"))
            .orderBy("avg_monetary", "segment"))
