"""Join helpers: null-safe key joins, salted row products and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on one column where NULL matches NULL (the rule of a data-frame merge), with the
    left side's key column kept.  Null-safe equality is still a hash or sort-merge key, so AQE
    may broadcast a side or split a skewed partition as usual."""
    other = f"__{key}"
    renamed = right.withColumnRenamed(key, other)
    return left.join(renamed, left[key].eqNullSafe(renamed[other]), how).drop(other)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row DISTINCT, hashed on all columns.

    Duplicates are first removed inside each input partition (partial
    aggregate), then rows are exchanged on the hash of the whole row.  A join
    key shared by a third of all rows (a very large customer, a best-selling
    product) is therefore still spread over all tasks; pre-partitioning on the
    join key would save one exchange but put that whole group in one task.
    """
    return df.dropDuplicates()


def salted_product(key: str, sides: list[tuple[DataFrame, str]], cell: int = 256) -> DataFrame:
    """All combinations of the sides' rows with equal (null-safe) ``key``, without ever forming
    one key's whole product in one task.

    ``sides``: each side with the name of a column, present on *every* side, that holds the
    side's number of rows for the key.  The rows of a key form a grid with one dimension per
    side, cut into cells of at most ``cell`` rows a side; a row belongs to one slice of its own
    dimension and is repeated for each slice of the others.  Keys with at most ``cell`` rows on
    every side (nearly all) are one cell, and nothing is repeated for them.
    """
    counts = [count for _, count in sides]
    slices = {c: F.ceil(F.greatest(F.col(c), F.lit(1)) / F.lit(float(cell))).cast("int") for c in counts}
    joined = None
    for i, (side, count) in enumerate(sides):
        payload = [c for c in side.columns if c != key and c not in counts]
        row_hash = F.xxhash64(*payload) if payload else F.lit(0)
        salted = side
        for j, other in enumerate(counts):
            if other == count:
                salted = salted.withColumn(f"_cell{j}", F.pmod(row_hash, slices[count]).cast("int"))
            else:
                salted = salted.withColumn(f"_cell{j}", F.explode(F.sequence(F.lit(0), slices[other] - 1)))
        salted = salted.drop(*counts)
        if joined is None:
            joined = salted
            continue
        cells = [f"_cell{j}" for j in range(len(counts))]
        right = salted.withColumnRenamed(key, "__key")
        for c in cells:
            right = right.withColumnRenamed(c, f"__{c}")
        on = joined[key].eqNullSafe(right["__key"])
        for c in cells:
            on = on & (joined[c] == right[f"__{c}"])
        joined = joined.join(right, on).drop("__key", *[f"__{c}" for c in cells])
    return joined.drop(*[f"_cell{j}" for j in range(len(counts))])
