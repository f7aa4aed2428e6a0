"""Sinks: the RFM table as CSV and the summary datasets.

The single-machine spreadsheet of the original workload (one sheet per
summary) is re-aimed at a folder with one dataset per summary; each is
written by the executors in parallel (no coalesce to one file, no driver
round trip).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from agora.plans import payments, products, revenue, rfm, sellers
from agora.plans.fanout import Fanout
from agora.session import delete_folder, folder_exists, move_folder, write_text

# Summary names and row limits of the summary export.
SUMMARY_SHEETS = {
    "monthly_revenue": "Monthly Revenue",
    "category_revenue": "Category Revenue",
    "state_revenue": "State Revenue",
    "rfm_segments": "RFM Segments",
    "payment_methods": "Payment Methods",
    "top_sellers": "Top Sellers",
}
TOP_CATEGORIES = 15
#: File that holds the id of the run that a folder's six summaries come from.
MARKER = "_EXPORTED"


def summary_frames(delivered: Fanout, scored: DataFrame) -> dict[str, DataFrame]:
    """The six summaries (monthly revenue carries the growth columns)."""
    return {
        "monthly_revenue": revenue.mom_growth(delivered).drop("growth_direction"),
        "category_revenue": products.top_categories(delivered, TOP_CATEGORIES),
        "state_revenue": revenue.revenue_by_state(delivered),
        "rfm_segments": rfm.rfm_segments(scored),
        "payment_methods": payments.payment_methods(delivered).drop("share_pct"),
        "top_sellers": sellers.top_sellers(delivered),
    }


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV dataset (one part file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)


def export_rfm(scored: DataFrame, out_dir: str, mode: str = "overwrite") -> str:
    """Write the per-customer RFM table as CSV under ``out_dir/rfm_customer_segments``."""
    path = f"{out_dir.rstrip('/')}/rfm_customer_segments"
    write_csv(rfm.rfm(scored), path, mode)
    return path


def export_summaries(delivered: Fanout, scored: DataFrame, out_dir: str, fmt: str = "parquet",
                     mode: str = "overwrite") -> dict[str, str]:
    """Write each summary to ``out_dir/<name>`` as Parquet (default) or CSV.

    All six are written aside first and then moved into place, so a run that fails while it computes
    leaves the former export whole. ``out_dir/_EXPORTED`` names the run that all six are of; it is
    taken away before the moves and written after them. With a ``mode`` other than "overwrite" an
    existing summary is an error."""
    spark, out = scored.sparkSession, out_dir.rstrip("/")
    run = uuid.uuid4().hex
    aside, marker = f"{out}/_export-{run}", f"{out}/{MARKER}"
    paths = {name: f"{out}/{name}" for name in SUMMARY_SHEETS}
    if mode != "overwrite" and (there := [p for p in paths.values() if folder_exists(spark, p)]):
        raise FileExistsError(", ".join(there))
    try:
        for name, df in summary_frames(delivered, scored).items():
            if fmt == "csv":
                write_csv(df, f"{aside}/{name}", "error")
            else:
                df.write.parquet(f"{aside}/{name}")
        delete_folder(spark, marker)
        for name, path in paths.items():
            move_folder(spark, f"{aside}/{name}", path)
        write_text(spark, marker, run)
    finally:
        delete_folder(spark, aside)
    return paths
