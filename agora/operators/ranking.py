"""Global ranking and NTILE without funnelling rows through one task.

NTILE needs no rank of every row: ``ntile_cuts`` selects the rows at which
tiles begin (``operators.selection``). ``global_rank`` is for results that do
need every row's position.

``ROW_NUMBER() / NTILE() OVER (ORDER BY ...)`` with no PARTITION BY makes
Spark move every row into a single partition.  Here the rank is built from
pieces that all scale out:

1. ``repartitionByRange`` on the full sort order.  The order ends in a unique
   tie-break column, so even a value shared by a third of all rows is spread
   over many range partitions;
2. ``sortWithinPartitions`` and the position inside the partition (the low 33
   bits of ``monotonically_increasing_id``);
3. the result is written once to the shared ``spark.checkpoint.dir``
   (``session.stage``), so partition ids and positions are stored values,
   fixed even if executors are lost and tasks re-run;
4. rows per partition (one row per partition, a bounded table), their
   running total as the partition offset, broadcast back.

rank = offset(partition) + position, 0-based, dense and unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.selection import rows_at_ranks
from agora.session import checkpoint_dir, stage

_PART, _POS, _MID, _OFFSET, _TOTAL = "_rk_part", "_rk_pos", "_rk_mid", "_rk_offset", "_rk_total"


def global_rank(df: DataFrame, order_by: Sequence[Column], rank_col: str = "rank0",
                total_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``rank_col``: the 0-based position of each row in ``order_by`` order.

    ``order_by`` must define a total order (end it with a unique key) for the
    rank to be deterministic.  With ``total_col`` the row count is attached too.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n_parts, *order_by)
               .sortWithinPartitions(*order_by)
               .withColumn(_MID, F.monotonically_increasing_id()))
    # written once: partition ids and positions become plain stored values
    ordered = stage(ordered)
    part = F.shiftright(F.col(_MID), 33)
    ordered = ordered.withColumns({_PART: part, _POS: F.col(_MID) - F.shiftleft(part, 33)})

    # one row per range partition: a table bounded by n_parts, safe to broadcast
    per_part = ordered.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        _PART,
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias(_OFFSET),
        F.sum("_n").over(Window.partitionBy()).alias(_TOTAL))
    ranked = ordered.join(F.broadcast(offsets), _PART).withColumn(
        rank_col, F.col(_OFFSET) + F.col(_POS))
    if total_col:
        ranked = ranked.withColumnRenamed(_TOTAL, total_col)
    return ranked.drop(_MID, _PART, _POS, _OFFSET, _TOTAL)


def ntile_cuts(df: DataFrame, value: Column, id_col: str, tiles: int) -> list[tuple[Column, Column]]:
    """The (value, id) literals where tiles 2 .. ``tiles`` of ``NTILE(tiles) OVER (ORDER BY value,
    id)`` begin, found by selection: nothing is sorted or written."""
    def starts(n: int) -> list[int]:
        return [k * (n // tiles) + min(k, n % tiles) for k in range(1, tiles)]

    types = df.select(value.alias("v"), F.col(id_col).alias("i")).schema
    _, rows = rows_at_ranks(df, value, starts, id_col)
    return [(F.lit(v).cast(types["v"].dataType), F.lit(i).cast(types["i"].dataType)) for _, (v, i) in sorted(rows.items())]


def tile_of(value: Column, row_id: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """The tile of a row, from the cuts that :func:`ntile_cuts` gives (NULL sorts first)."""
    own = F.struct(value.alias("v"), row_id.alias("i"))
    tile = F.lit(1).cast("bigint")
    for v, i in cuts:
        tile = tile + F.when(own >= F.struct(v.alias("v"), i.alias("i")), 1).otherwise(0)
    return tile
