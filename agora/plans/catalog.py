"""Registry of every query: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.plans import (customers, delivery, findings, payment_grain, payments, products, profile, revenue,
                         reviews, rfm, sellers)
from agora.plans.fanout import Fanout, build_fanout, master_rows, materialize_fanout
from agora.session import Scratch
from agora.sources import sinks
from agora.sources.tpch_fixture import tpch_marketplace
from agora.tables import MarketplaceTables


class Workspace:
    """Plans shared by the analyses of one table set, and owner of what they write.

    ``fanout`` is the factorised master frame (``plans.fanout``).  With
    ``materialize`` its four sides are written once per workspace and every
    analysis scans them; without it each analysis plans the joins itself.
    ``master`` is the literal joined frame, assembled from the sides (only the
    query that returns it needs it).  :meth:`close` deletes the written data.
    """

    def __init__(self, spark: SparkSession, tables: MarketplaceTables, materialize: bool = False):
        self.spark = spark
        self.tables = tables
        self.materialize = materialize
        self.scratch = Scratch(spark)
        self._lock = threading.Lock()
        self._fanout: Fanout | None = None
        self._rfm: DataFrame | None = None

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        with self._lock:
            self._fanout = self._rfm = None
            self.scratch.close()

    @property
    def master(self) -> DataFrame:
        return master_rows(self.fanout, self.tables)

    @property
    def fanout(self) -> Fanout:
        with self._lock:
            if self._fanout is None:
                self._fanout = (materialize_fanout(self.tables, self.scratch) if self.materialize
                                else build_fanout(self.tables, self.scratch))
            return self._fanout

    @property
    def delivered(self) -> Fanout:
        return self.fanout.delivered()

    @property
    def delivery(self) -> DataFrame:
        return self.delivered.delivery_rows()

    @property
    def rfm(self) -> DataFrame:
        """The scored customers, computed and written once."""
        delivered = self.delivered
        with self._lock:
            if self._rfm is None:
                self._rfm = self.scratch.stage(rfm.rfm_scored(delivered))
            return self._rfm


Analysis = Callable[[Workspace], DataFrame]


def master_report(master: DataFrame) -> DataFrame:
    """The master frame as delivered to users: money as DOUBLE (the plans keep
    DECIMAL internally for exact sums)."""
    return master.withColumns({c: F.col(c).cast("double") for c, t in master.dtypes
                               if t.startswith("decimal")})

PY_ANALYSES: dict[str, Analysis] = {
    "py_master": lambda w: master_report(w.master),
    "py_dataset_counts": lambda w: profile.dataset_counts(w.tables, w.fanout),
    "py_missing_values": lambda w: profile.missing_values(w.fanout),
    "py_kpis": lambda w: revenue.kpis(w.delivered),
    "py_monthly_revenue": lambda w: revenue.monthly_revenue(w.delivered),
    "py_revenue_by_weekday": lambda w: revenue.revenue_by_weekday(w.delivered),
    "py_revenue_by_hour": lambda w: revenue.revenue_by_hour(w.delivered),
    "py_top_categories": lambda w: products.top_categories(w.delivered),
    "py_category_reviews": lambda w: products.category_reviews(w.delivered),
    "py_best_categories": lambda w: products.best_categories(w.delivered),
    "py_worst_categories": lambda w: products.worst_categories(w.delivered),
    "py_revenue_by_state": lambda w: revenue.revenue_by_state(w.delivered),
    "py_customer_loyalty": lambda w: customers.customer_loyalty(w.delivered),
    "py_repeat_rate": lambda w: customers.repeat_rate(w.delivered),
    "py_order_frequency": lambda w: customers.order_frequency(w.delivered),
    "py_rfm": lambda w: rfm.rfm(w.rfm),
    "py_rfm_segments": lambda w: rfm.rfm_segments(w.rfm),
    "py_segment_spend": lambda w: rfm.segment_spend(w.rfm),
    "py_delivery_kpis": lambda w: delivery.delivery_kpis(w.delivery),
    "py_delivery_histogram": lambda w: delivery.delivery_histogram(w.delivery),
    "py_delivery_status_share": lambda w: delivery.delivery_status_share(w.delivery),
    "py_slowest_states": lambda w: delivery.slowest_states(w.delivery),
    "py_review_by_delivery": lambda w: delivery.review_by_delivery(w.delivery),
    "py_review_distribution": lambda w: reviews.review_distribution(w.delivered),
    "py_monthly_review": lambda w: reviews.monthly_review(w.delivered),
    "py_payment_methods": lambda w: payments.payment_methods(w.delivered),
    "py_correlation": lambda w: profile.correlation(w.delivered),
    "py_seller_performance": lambda w: sellers.seller_performance(w.delivered),
    "py_top_sellers": lambda w: sellers.top_sellers(w.delivered),
    "py_seller_concentration": lambda w: sellers.seller_concentration(w.delivered),
    "py_mom_growth": lambda w: revenue.mom_growth(w.delivered),
    # figures the workload reports without code of their own
    "py_top_category_share": lambda w: findings.top_category_share(w.delivered),
    "py_peak_hour_share": lambda w: findings.peak_hour_share(w.delivered),
    "py_yearly_revenue": lambda w: findings.yearly_revenue(w.delivered),
    "py_revenue_pivot": lambda w: findings.revenue_pivot(w.delivered),
    "py_state_delivery_days": lambda w: findings.state_delivery_days(w.delivery),
}

def _on_tables(query: Callable[[MarketplaceTables], DataFrame], w: Workspace) -> DataFrame:
    return query(w.tables)


SQL_ANALYSES: dict[str, Analysis] = {
    **{name: partial(_on_tables, query) for name, query in payment_grain.QUERIES.items()},
    "sql_payment_share": lambda w: findings.payment_share(w.tables),
}


def _exported(name: str, w: Workspace) -> DataFrame:
    """A summary as it is read back after its export."""
    frame = sinks.summary_frames(w.delivered, w.rfm)[name]
    path = w.scratch.new_path(f"export-{name}")
    frame.write.parquet(path)
    return w.spark.read.parquet(path)


def _exported_rfm(w: Workspace) -> DataFrame:
    """The RFM table as it is read back after its CSV export."""
    frame = rfm.rfm(w.rfm)
    path = sinks.export_rfm(w.rfm, w.scratch.new_path("export"))
    return w.spark.read.schema(frame.schema).option("header", True).csv(path)


EXPORTS: dict[str, Analysis] = {
    "export_rfm_csv": _exported_rfm,
    **{f"export_{name}": partial(_exported, name) for name in sinks.SUMMARY_SHEETS}}

ALL_ANALYSES: dict[str, Analysis] = {**PY_ANALYSES, **SQL_ANALYSES, **EXPORTS}


# (application id, session, folder) -> (state of the folder, its workspace).  A workspace holds
# lazy plans only (and the location of what it wrote); no data is cached in memory.
_WORKSPACES: dict[tuple, tuple[tuple, Workspace]] = {}
_LOCK = threading.Lock()


def _folder_state(spark: SparkSession, folder: str) -> tuple:
    """Path, size and modification time of all files below the folder, whatever its file system
    (a table may be a folder itself, and object stores have no times of folders)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(files))


def tpch_workspace(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Workspace:
    """The workspace of a folder (a path or URI); a changed folder gets a new one."""
    folder = sf_dir.rstrip("/")
    if not materialize:
        return Workspace(spark, tpch_marketplace(spark, folder))
    key = (spark.sparkContext.applicationId, id(spark), folder)
    state = _folder_state(spark, folder)
    with _LOCK:
        known = _WORKSPACES.get(key)
        if known is None or known[0] != state:
            if known is not None:
                known[1].close()
            known = _WORKSPACES[key] = (state, Workspace(spark, tpch_marketplace(spark, folder), True))
        return known[1]


def close_workspaces() -> None:
    """Delete what the workspaces of :func:`tpch_workspace` have written."""
    with _LOCK:
        for _, workspace in _WORKSPACES.values():
            workspace.close()
        _WORKSPACES.clear()


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ALL_ANALYSES[name](tpch_workspace(spark, sf_dir))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query as ``callable(spark, sf_dir)`` over the TPC-H test tables."""
    return {name: partial(_run, name) for name in ALL_ANALYSES}
