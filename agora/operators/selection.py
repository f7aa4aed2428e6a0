"""Exact order statistics without a sort: iterative histogram selection.

To find the rows at given ranks of ``ORDER BY value, id``, each pass counts the rows in ``BINS``
equal-width bins of the ranges that may still hold a rank, by one aggregate of at most (ranges x
bins) groups; nothing else is shuffled. The bin that a rank falls into, with the least and largest
value seen in it, is the next range. A range of one value goes on to the ids, a range of at most
``LEAF`` rows is fetched. So n rows take about log(n) / log(BINS) passes over two columns and the
driver holds bins and leaves only. The order of equal values is that of the ids (bytes of strings,
in steps of ``CHUNK`` bytes), so a value that a third of all rows share costs no more than others.

Bin numbers are rounded DOUBLE arithmetic, but never decrease as values grow and separate the
least value from the largest; the counts and the ends of the ranges are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
LEAF = 4096
CHUNK = 6
_V, _ID = "_sel_v", "_sel_id"


def _chunk(number: int) -> Column:
    """Bytes ``number * CHUNK`` .. of the id with how many of them there are, as one number."""
    piece = F.substring(F.col(_ID).cast("binary"), number * CHUNK + 1, CHUNK)
    filled = F.rpad(F.hex(piece), 2 * CHUNK, "0")
    return F.coalesce(F.conv(filled, 16, 10).cast("bigint") * 16 + F.octet_length(piece), F.lit(-1).cast("bigint"))


def _whole_id() -> Column:
    """A whole-number id as a key that is never NULL (NULLs first)."""
    return F.coalesce(F.col(_ID).cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)"))


@dataclass(frozen=True)
class _Range:
    """Rows that hold some of the ranks: those of ``inside`` whose ``key`` is from ``low`` to ``high``."""

    inside: Column
    key: Column
    low: Any
    high: Any
    rows: int
    #: rank inside the range, for each rank looked for
    ranks: dict[int, int]
    #: number of the id's chunk that the key is; None: the value, -1: a whole number id
    chunk: int | None = None

    def rows_in(self) -> Column:
        return self.inside if self.low is None else self.inside & self.key.between(F.lit(self.low), F.lit(self.high))


def _bin(r: _Range) -> Column:
    span = float(r.high - r.low) or 1.0
    place = F.floor((r.key - F.lit(r.low)).cast("double") / F.lit(span) * BINS)
    return F.greatest(F.least(place, F.lit(BINS - 1)), F.lit(0)).cast("int")


def _split(df: DataFrame, ranges: list[_Range]) -> list[_Range]:
    """The bins of ``ranges`` that hold their ranks."""
    def choose(pick: Callable[[_Range], Column]) -> Column:
        first, *rest = ranges
        return reduce(lambda c, r: c.when(r.rows_in(), pick(r)), rest, F.when(first.rows_in(), pick(first)))

    numbered = {id(r): i for i, r in enumerate(ranges)}
    cells = (df.select(choose(lambda r: F.lit(numbered[id(r)])).alias("r"), choose(_bin).alias("b"), choose(lambda r: r.key).alias("k"))
             .where("r is not null").groupBy("r", "b").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")))
    found: dict[int, list] = {}
    for cell in cells.collect():  # at most len(ranges) * BINS rows
        found.setdefault(cell["r"], []).append(cell)
    out = []
    for i, r in enumerate(ranges):
        before = 0
        for cell in sorted(found[i], key=lambda c: c["b"]):
            ranks = {k: rank - before for k, rank in r.ranks.items() if before <= rank < before + cell["n"]}
            if ranks:
                out.append(replace(r, low=cell["low"], high=cell["high"], rows=cell["n"], ranks=ranks))
            before += cell["n"]
    return out


def _all_alike(r: _Range) -> bool:
    """Whether the range is one id: a whole number, NULL or the last bytes of a string."""
    return r.low == r.high and r.chunk is not None and (r.chunk < 0 or r.low < 0 or r.low % 16 < CHUNK)


def _next_key(r: _Range, text_id: bool) -> _Range:
    """A range of one key goes on to the next key (its bounds are found by the next pass)."""
    inside = r.inside & (r.key == F.lit(r.low))
    if not text_id:
        return replace(r, inside=inside, key=_whole_id(), chunk=-1)
    number = 0 if r.chunk is None else r.chunk + 1
    return replace(r, inside=inside, key=_chunk(number), chunk=number)


def _bounded(df: DataFrame, ranges: list[_Range]) -> list[_Range]:
    """Least and largest key of ranges that are not known yet."""
    if not ranges:
        return []
    one = df.agg(*[f(F.when(r.inside, r.key)).alias(f"{n}{i}") for i, r in enumerate(ranges) for n, f in (("low", F.min), ("high", F.max))]).first()
    return [replace(r, low=one[f"low{i}"], high=one[f"high{i}"]) for i, r in enumerate(ranges)]


def rows_at_ranks(df: DataFrame, value: Column, ranks: Callable[[int], Sequence[int]], id_col: str | None = None,
                  leaf: int | None = None) -> tuple[int, dict[int, tuple[Any, Any]]]:
    """The number of rows, and (value, id) of the rows at ``ranks(number)`` (0-based) of
    ``ORDER BY value, id`` (NULLs first). Without ``id_col`` rows of equal value are alike and the
    id is None. Values are numbers (no NaN or infinity), ids strings or whole numbers, both may
    be NULL. Ranks outside the table are left out."""
    leaf = LEAF if leaf is None else leaf
    whole = isinstance(df.select(value.alias(_V)).schema[_V].dataType, T.IntegralType)
    narrow = df.select((value.cast("decimal(20,0)") if whole else value).alias(_V), F.col(id_col).alias(_ID) if id_col else F.lit(None).cast("bigint").alias(_ID))
    text_id = isinstance(narrow.schema[_ID].dataType, T.StringType)
    first = narrow.agg(F.count(F.lit(1)).alias("n"), F.count(_V).alias("known"), F.min(_V).alias("low"), F.max(_V).alias("high")).first()
    n, nulls = first["n"], first["n"] - first["known"]
    wanted = sorted({k for k in ranks(n) if 0 <= k < n})
    answers: dict[int, tuple[Any, Any]] = {}
    live: list[_Range] = []
    if some := {k: k - nulls for k in wanted if k >= nulls}:
        live.append(_Range(F.col(_V).isNotNull(), F.col(_V), first["low"], first["high"], first["known"], some))
    unknown: list[_Range] = []
    if some := {k: k for k in wanted if k < nulls}:
        if id_col:
            chunk = 0 if text_id else -1
            unknown.append(_Range(F.col(_V).isNull(), _chunk(0) if text_id else _whole_id(), None, None, nulls, some, chunk))
        else:
            answers.update({k: (None, None) for k in some})
    leaves: list[_Range] = []
    while live or unknown:
        pending, live = live + _bounded(narrow, [r for r in unknown if r.rows > leaf]), []
        leaves += [r for r in unknown if r.rows <= leaf]
        unknown = []
        split: dict[str, list[_Range]] = {}
        for r in pending:
            if id_col is None and r.low == r.high:
                answers.update({k: (r.low, None) for k in r.ranks})
            elif r.rows <= leaf:
                leaves.append(r)
            elif _all_alike(r):
                leaves.append(r)
            elif r.low == r.high:
                unknown.append(_next_key(r, text_id))
            else:  # ranges of values and of ids have keys of different types
                split.setdefault("value" if r.chunk is None else "id", []).append(r)
        for same_type in split.values():
            live += _split(narrow, same_type)
    answers |= _fetched(narrow, leaves)
    return n, {k: (int(v) if whole and v is not None else v, i) for k, (v, i) in answers.items()}


def _fetched(df: DataFrame, leaves: list[_Range]) -> dict[int, tuple[Any, Any]]:
    """Values at the ranks of small ranges, and of ranges whose rows are all alike: the distinct
    rows of all of them in one scan."""
    if not leaves:
        return {}
    number = reduce(lambda c, i: c.when(leaves[i].rows_in(), F.lit(i)), range(1, len(leaves)), F.when(leaves[0].rows_in(), F.lit(0)))
    rows: dict[int, list] = {}
    cells = df.select(number.alias("r"), _V, _ID).where("r is not null").groupBy("r", _V, _ID).agg(F.count(F.lit(1)).alias("n"))
    for row in cells.collect():  # at most len(leaves) * LEAF rows
        rows.setdefault(row["r"], []).append(row)

    def order(row):
        v, i = row[_V], row[_ID]
        return v is not None, v if v is not None else 0, i is not None, i.encode() if isinstance(i, str) else i or 0

    answers = {}
    for i, r in enumerate(leaves):
        before = 0
        for row in sorted(rows[i], key=order):
            answers.update({k: (row[_V], row[_ID]) for k, rank in r.ranks.items() if before <= rank < before + row["n"]})
            before += row["n"]
    return answers


def quantiles_by_selection(df: DataFrame, value: Column, probs: Sequence[float]) -> Column:
    """Array of exact quantiles (linear interpolation) of the non-NULL values, as DOUBLE; NULLs if
    there is no value."""
    known = df.select(value.alias("v")).where("v is not null")

    def around(n: int, p: float) -> tuple[int, int]:
        place = (n - 1) * p
        return math.floor(place), math.ceil(place)

    n, rows = rows_at_ranks(known, F.col("v"), lambda n: [k for p in probs for k in around(n, p)])
    if not n:
        return F.array(*[F.lit(None).cast("double") for _ in probs])
    out = []
    for p in probs:
        low, high = (float(rows[k][0]) for k in around(n, p))
        out.append(F.lit(low + (high - low) * ((n - 1) * p - around(n, p)[0])))
    return F.array(*out)


def top_sum(df: DataFrame, value: Column, size: Callable[[int], int]) -> tuple[int, Any]:
    """The number of rows, and the sum of the ``size(number)`` largest values (NULL: none); ties
    at the limit do not matter. Values are not NULL."""
    values = df.select(value.alias("v"))
    n, rows = rows_at_ranks(values, F.col("v"), lambda n: [n - size(n)] if size(n) else [])
    if not rows:
        return n, None
    k, (limit, _) = size(n), next(iter(rows.values()))
    above = values.where(F.col("v") > F.lit(limit)).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).first()
    return n, (above["total"] or 0) + limit * (k - above["n"])
