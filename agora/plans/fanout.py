"""The master frame in factorised form: four sides plus per-order multiplicities.

The master frame joins each order with all of its items, payments and
reviews, so an order with ``i`` items, ``p`` payments and ``r`` reviews has
``i * p * r`` rows and every aggregate of the analyses is taken over those
rows.  Materialising that product is quadratic in the size of a large order,
and one order's rows would sit in one task.  Every aggregate the analyses
need is a sum, a count, a distinct count, a min/max or an exact weighted
quantile, so it can be computed from the sides instead:

* ``orders``   - order rows joined with their customer rows (plus the derived
  calendar and delivery columns);
* ``items``    - item rows joined with product and category translation;
* ``payments`` - payment rows;
* ``reviews``  - (order_id, review_score) rows.

Each side is restricted to orders present in ``orders`` and holds one
NULL row for an order without rows on that side (the LEFT-join rule).  Every
side row carries the row counts of the four sides of its order (``n_oc``,
``n_items``, ``n_pays``, ``n_revs``, each >= 1) and the per-order sums of the
others where an analysis needs them.  A master row is one combination of side
rows of an order, so

    sum over master rows of payment_value  =  sum over order rows of
        pay_sum * n_items * n_revs,

all in exact DECIMAL arithmetic, hence bit-identical to the row-level sum.
The four sides are O(input) in size whatever the fan-out is.

Full-row de-duplication is applied to every input before the split.  Because
every input column survives into the master frame, a join of duplicate-free
inputs is duplicate-free, so this equals de-duplicating the joined frame
without shuffling the fan-out on all of its columns.

Keys follow the merge rule of the workload: NULL matches NULL, so an order
without an id keeps its master row.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.joins import distinct_rows, join_on_key, salted_product
from agora.plans.master import DERIVED_COLUMNS, with_order_attributes
from agora.session import Scratch, stage
from agora.tables import MarketplaceTables

CATEGORY = "product_category_name_english"


class Fanout:
    """Factorised master frame (see module docstring).

    ``per_order`` holds one row per order id with the row counts and sums of its sides.  Each
    part is built when it is first read, so an analysis pays for the sides it uses only.  In the
    view returned by :meth:`delivered`, ``n_oc`` counts only delivered order rows and sides of
    orders without a delivered row are dropped.
    """

    def __init__(self, build: Callable[[str], DataFrame], written: Callable[[DataFrame], DataFrame]):
        self._build = build
        self.written = written  # writes a frame where this one's parts are written
        self._lock = threading.RLock()
        self._parts: dict[str, DataFrame] = {}

    def _part(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._parts:
                self._parts[name] = self._build(name)
            return self._parts[name]

    @property
    def orders(self) -> DataFrame:
        return self._part("orders")

    @property
    def items(self) -> DataFrame:
        return self._part("items")

    @property
    def payments(self) -> DataFrame:
        return self._part("payments")

    @property
    def reviews(self) -> DataFrame:
        return self._part("reviews")

    @property
    def per_order(self) -> DataFrame:
        return self._part("per_order")

    def delivered(self) -> Fanout:
        def keep(name: str) -> DataFrame:
            part = self._part(name)
            if name == "orders":
                return part.where(F.col("has_delivered"))
            delivered = F.col("n_oc_del") > 0 if name == "per_order" else F.col("has_delivered")
            return part.where(delivered).withColumn("n_oc", F.col("n_oc_del"))

        return Fanout(keep, self.written)

    def delivery_rows(self) -> DataFrame:
        """Order rows with both day counts and a positive delivery time (call on
        the delivered view); their master-row weight is :func:`w_orders`."""
        return (self.orders
                .dropna(subset=["delivery_days", "estimated_delivery_days"])
                .where(F.col("delivery_days") > 0))


# ----------------------------------------------------------------- weights
# Number of master rows a side row stands for: the product of the other sides' counts.

def w_orders() -> Column:
    return F.col("n_items") * F.col("n_pays") * F.col("n_revs")


def w_items() -> Column:
    return F.col("n_oc") * F.col("n_pays") * F.col("n_revs")


def w_pays() -> Column:
    return F.col("n_oc") * F.col("n_items") * F.col("n_revs")


def w_revs() -> Column:
    return F.col("n_oc") * F.col("n_items") * F.col("n_pays")


# Payment value and review score summed over the master rows of a side row.

def pay_on_orders() -> Column:
    return F.col("pay_sum") * F.col("n_items") * F.col("n_revs")


def pay_rows_on_orders() -> Column:
    return F.col("pay_cnt") * F.col("n_items") * F.col("n_revs")


def rev_on_orders() -> Column:
    return F.col("rev_sum") * F.col("n_items") * F.col("n_pays")


def rev_rows_on_orders() -> Column:
    return F.col("rev_cnt") * F.col("n_items") * F.col("n_pays")


def pay_on_items() -> Column:
    return F.col("pay_sum") * F.col("n_revs") * F.col("n_oc")


def rev_on_items() -> Column:
    return F.col("rev_sum") * F.col("n_pays") * F.col("n_oc")


def rev_rows_on_items() -> Column:
    return F.col("rev_cnt") * F.col("n_pays") * F.col("n_oc")


def ratio_of_totals(value: Column | str, rows: Column | str) -> Column:
    """Mean from an exact total and its number of rows; NULL without rows."""
    value, rows = (F.col(c) if isinstance(c, str) else c for c in (value, rows))
    return value.cast("double") / F.when(rows != 0, rows).cast("double")


def weighted_mean(value_sum: Column, value_rows: Column) -> Column:
    """Mean over master rows from exact weighted sum and weighted count."""
    return ratio_of_totals(F.sum(value_sum), F.sum(value_rows))


def total_or_zero(total: Column | str) -> Column:
    """A total over master rows; 0 when there is no value (pandas semantics)."""
    return F.coalesce(F.col(total) if isinstance(total, str) else total, F.lit(0)).cast("double")


def fan_sum(value_sum: Column) -> Column:
    """Sum over master rows; 0 when there is no value (pandas semantics)."""
    return total_or_zero(F.sum(value_sum))


# ------------------------------------------------------------------- build

def _at_least_one(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(1)).cast("bigint")


@dataclass(frozen=True)
class _Rows:
    """De-duplicated rows of each side; ``bare_orders`` and ``bare_items`` are the rows before
    their customers and products are joined, which ``customers`` and ``products`` hold.  Order
    rows come without their derived columns: whoever needs these adds them behind the joins, so
    that no join shuffles them."""

    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    bare_orders: DataFrame
    bare_items: DataFrame
    customers: DataFrame
    products: DataFrame


def _side_rows(t: MarketplaceTables) -> _Rows:
    """De-duplicated rows of each side (lazy)."""
    bare_orders, bare_items = distinct_rows(t.orders), distinct_rows(t.order_items)
    customers, products = distinct_rows(t.customers), distinct_rows(t.products)
    translation = distinct_rows(t.category_translation)
    items = join_on_key(bare_items, products, "product_id", "left")
    return _Rows(
        orders=join_on_key(bare_orders, customers, "customer_id", "left"),
        items=join_on_key(items, translation, "product_category_name", "left"),
        payments=distinct_rows(t.payments), reviews=distinct_rows(t.reviews.select("order_id", "review_score")),
        bare_orders=bare_orders, bare_items=bare_items, customers=customers,
        products=join_on_key(products, translation, "product_category_name", "left"))


COPIES = "_copies"


def _with_copies(rows: DataFrame, dimension: DataFrame, key: str, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the number of rows that a left join with ``dimension`` makes of each.

    Only keys that the dimension repeats are joined.  They are few as a rule, and written, so
    Spark knows their size and need not shuffle ``rows`` for them."""
    repeated = dimension.groupBy(key).agg(F.count(F.lit(1)).alias(COPIES)).where(F.col(COPIES) > 1)
    return (join_on_key(rows, written(repeated), key, "left")
            .withColumn(COPIES, F.coalesce(F.col(COPIES), F.lit(1)).cast("bigint")))


def _order_stats(rows: _Rows, written: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """One row per order id (NULL is an id of its own): side row counts (NULL-extended: at
    least 1) and the per-order sums the analyses weight with."""
    delivered, days, copies = F.col("order_status") == "delivered", F.col("delivery_days"), F.col(COPIES)
    orders = _with_copies(with_order_attributes(rows.bare_orders).select("order_id", "customer_id", "order_status", "delivery_days"),
                          rows.customers, "customer_id", written)
    items = _with_copies(rows.bare_items.select("order_id", "product_id"), rows.products, "product_id", written)

    def per_order(side: DataFrame, *sums: Column) -> DataFrame:
        # grouped by the columns that the join is on, so it takes the groups where they are; a
        # null-safe join of groups by order_id would shuffle each side once more
        order_id = F.col("order_id")
        return (side.groupBy(F.coalesce(order_id, F.lit(0).cast(side.schema["order_id"].dataType)).alias("_id"),
                             order_id.isNull().alias("_no_id")).agg(*sums))

    # every input is one row per order id, so these joins are 1:1 (no skew)
    stats = per_order(
        orders, F.sum(copies).alias("n_oc"),
        F.sum(F.when(delivered, copies).otherwise(0)).alias("n_oc_del"),
        F.sum(F.when(delivered, days * copies)).alias("dd_sum_del"),
        F.sum(F.when(delivered & days.isNotNull(), copies).otherwise(0)).alias("dd_cnt_del"))
    for other in (
            per_order(items, F.sum(copies).alias("_ni")),
            per_order(rows.payments, F.count(F.lit(1)).alias("_np"), F.sum("payment_value").alias("pay_sum"),
                      F.count("payment_value").alias("pay_cnt")),
            per_order(rows.reviews, F.count(F.lit(1)).alias("_nr"), F.sum("review_score").alias("rev_sum"),
                      F.count("review_score").alias("rev_cnt"))):
        stats = stats.join(other, ["_id", "_no_id"], "left")
    return stats.select(
        F.when(~F.col("_no_id"), F.col("_id")).alias("order_id"), "n_oc", "n_oc_del", "dd_sum_del", "dd_cnt_del",
        _at_least_one("_ni").alias("n_items"), _at_least_one("_np").alias("n_pays"),
        _at_least_one("_nr").alias("n_revs"),
        "pay_sum", F.coalesce("pay_cnt", F.lit(0)).alias("pay_cnt"),
        "rev_sum", F.coalesce("rev_cnt", F.lit(0)).alias("rev_cnt"),
        F.col("_ni").isNotNull().alias("has_items"),
        F.col("_np").isNotNull().alias("has_pays"),
        F.col("_nr").isNotNull().alias("has_revs"))


SIDE_COUNTS = ["n_oc", "n_items", "n_pays", "n_revs"]


def _assemble(rows: _Rows, stats: DataFrame, name: str) -> DataFrame:
    """One side.  ``stats`` should be a written table: a join of two scans is one that AQE can split."""
    def side(side_rows: DataFrame, keep: list[str], has_rows: str) -> DataFrame:
        # rows of order ids absent from ``orders`` never reach the master, so the match is an
        # INNER join of this side with the per-order table.  Orders without rows on this side
        # get their one NULL row from a union.
        per_order = stats.select("order_id", has_rows, *SIDE_COUNTS, "n_oc_del", *keep)
        matched = join_on_key(side_rows, per_order, "order_id")
        empty = per_order.where(~F.col(has_rows))
        return (matched.unionByName(empty, allowMissingColumns=True).drop(has_rows)
                .withColumn("has_delivered", F.col("n_oc_del") > 0))

    if name == "orders":
        orders = join_on_key(rows.orders, stats.select("order_id", *SIDE_COUNTS, "pay_sum", "pay_cnt", "rev_sum", "rev_cnt"), "order_id")
        return with_order_attributes(orders).withColumn("has_delivered", F.coalesce(F.col("order_status") == "delivered", F.lit(False)))
    if name == "items":
        items = side(rows.items, ["pay_sum", "pay_cnt", "rev_sum", "rev_cnt", "dd_sum_del", "dd_cnt_del"], "has_items")
        return items.withColumn(CATEGORY, F.coalesce(F.col(CATEGORY), F.lit("unknown")))
    return side(rows.payments, [], "has_pays") if name == "payments" else side(rows.reviews, [], "has_revs")


def _fanout(t: MarketplaceTables, written: Callable[[DataFrame], DataFrame], write_sides: bool) -> Fanout:
    rows = _side_rows(t)

    def build(name: str) -> DataFrame:
        if name == "per_order":
            return written(_order_stats(rows, written))
        side = _assemble(rows, fan.per_order, name)
        return written(side) if write_sides else side

    fan = Fanout(build, written)
    return fan


def build_fanout(t: MarketplaceTables, scratch: Scratch | None = None) -> Fanout:
    """The four sides with per-order multiplicities and sums.

    The narrow per-order statistics are written once (to ``scratch``, else to the application's
    scratch folder), so that each side's match is a join of its rows with a scan: AQE splits an
    order that holds a large part of a side's rows."""
    return _fanout(t, scratch.stage if scratch else stage, False)


def materialize_fanout(t: MarketplaceTables, scratch: Scratch) -> Fanout:
    """The same with each side written to ``scratch`` when it is first read.

    About thirty analyses read these sides; planning the joins for each would
    shuffle every input thirty times.  The sides are written as Parquet under
    the shared checkpoint folder (surviving executor loss and cutting the
    lineage).  Each is a table of its own, without partition columns: no
    analysis pays for the rows of a side it does not read, nor for the sort
    by partition that Spark puts before such a write.
    """
    return _fanout(t, scratch.stage, True)


# ------------------------------------------------------------- literal rows

#: Orders with more rows than this on a side are formed in cells.
CELL = 256


def _large_orders(t: MarketplaceTables, rows: _Rows, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Order ids that may have more than ``CELL`` rows on a side: rows are counted before
    de-duplication, which shuffles only counts."""
    orders = _with_copies(t.orders.select("order_id", "customer_id"), rows.customers, "customer_id", written)
    items = _with_copies(t.order_items.select("order_id", "product_id"), rows.products, "product_id", written)
    one = F.lit(1).cast("bigint")
    sides = [orders, items, *[s.select("order_id", one.alias(COPIES)) for s in (t.payments, t.reviews)]]
    large = None
    for side in sides:
        ids = side.groupBy("order_id").agg(F.sum(COPIES).alias(COPIES)).where(F.col(COPIES) > CELL).select("order_id")
        large = ids if large is None else large.unionByName(ids)
    return large.distinct()


def _of_orders(t: MarketplaceTables, ids: DataFrame, how: str) -> MarketplaceTables:
    """The tables with the rows of these orders only (``left_semi``) or without them (``left_anti``)."""
    ids = ids.select(F.col("order_id").alias("__id"))

    def match(df: DataFrame) -> DataFrame:
        return df.join(ids, df["order_id"].eqNullSafe(ids["__id"]), how)

    return replace(t, orders=match(t.orders), order_items=match(t.order_items),
                   payments=match(t.payments), reviews=match(t.reviews))


def _rest(df: DataFrame, *keys: str) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _master_columns(t: MarketplaceTables) -> list[str]:
    return (t.orders.columns + _rest(t.order_items, "order_id") + _rest(t.products, "product_id")
            + _rest(t.customers, "customer_id") + _rest(t.payments, "order_id")
            + _rest(t.category_translation, "product_category_name") + ["review_score", *DERIVED_COLUMNS])


def _joined(t: MarketplaceTables) -> DataFrame:
    """The master frame of tables whose orders have at most ``CELL`` rows on every side."""
    rows = _side_rows(t)
    master = rows.orders
    for side in (rows.items, rows.payments, rows.reviews):
        master = join_on_key(master, side, "order_id", "left")
    return with_order_attributes(master).withColumn(CATEGORY, F.coalesce(F.col(CATEGORY), F.lit("unknown"))).select(*_master_columns(t))


def _formed_in_cells(fan: Fanout, t: MarketplaceTables) -> DataFrame:
    """The master frame from its sides: every side holds its NULL row for an order without rows
    there, so inner joins on ``order_id`` give the LEFT-join fan-out."""
    items = fan.items.select("order_id", *SIDE_COUNTS, *_rest(t.order_items, "order_id"),
                             *_rest(t.products, "product_id"), CATEGORY)
    pays = fan.payments.select("order_id", *SIDE_COUNTS, *_rest(t.payments, "order_id"))
    revs = fan.reviews.select("order_id", *SIDE_COUNTS, "review_score")
    orders = fan.orders.select("order_id", *SIDE_COUNTS, *_rest(t.orders, "order_id"),
                               *_rest(t.customers, "customer_id"), *DERIVED_COLUMNS)
    joined = salted_product("order_id", [(orders, "n_oc"), (items, "n_items"), (pays, "n_pays"), (revs, "n_revs")], CELL)
    return joined.select(*_master_columns(t))


def master_rows(fan: Fanout, t: MarketplaceTables) -> DataFrame:
    """The literal master frame (orders x items x payments x reviews, LEFT joins).  Only the query
    that returns the master frame itself uses this.  Orders with more than ``CELL`` rows on a
    side, if there are any, are formed in cells (``salted_product``) from sides of their own; all
    others are joined as they are, each input shuffled once more for it and nothing written."""
    large = fan.written(_large_orders(t, _side_rows(t), fan.written))
    if large.isEmpty():
        return _joined(t)
    own = _of_orders(t, large, "left_semi")
    return _joined(_of_orders(t, large, "left_anti")).unionByName(
        _formed_in_cells(_fanout(own, fan.written, False), own))
