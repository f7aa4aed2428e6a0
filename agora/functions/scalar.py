"""Scalar and aggregate column helpers.

Determinism rules used throughout the package:

* money stays ``DECIMAL`` until the final projection, so sums are exact and
  independent of partitioning; results are converted to ``DOUBLE`` once;
* a mean is ``CAST(SUM(x) AS DOUBLE) / COUNT(x)`` over an exact sum (one
  correctly rounded division), never a running floating-point average;
* rounding of a ratio is half-up, once, in integer arithmetic;
* day arithmetic on ``TIMESTAMP_NTZ`` is wall-clock (time-zone free).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed_days(end: Column | str, start: Column | str) -> Column:
    """Whole 24-hour periods from ``start`` to ``end``, floored (so -22h is -1).

    ``timestamp_diff`` on TIMESTAMP_NTZ counts wall-clock microseconds; the
    floor division is done on integers (``x - pmod(x, D)`` is a multiple of D).
    """
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return ((micros - F.pmod(micros, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("bigint")


def calendar_days(end: Column | str, start: Column | str) -> Column:
    """Difference of the calendar dates (SQL ``DATEDIFF``)."""
    return F.datediff(_col(end), _col(start)).cast("bigint")


def month_period(ts: Column | str) -> Column:
    """``yyyy-MM`` month label."""
    return F.date_format(_col(ts), "yyyy-MM")


def weekday_name(ts: Column | str) -> Column:
    """Full English weekday name (``Monday`` ... ``Sunday``)."""
    return F.date_format(_col(ts), "EEEE")


def null_if_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def half_up(total: Column | str, count: Column | str, digits: int) -> Column:
    """``total / count`` rounded half up (away from zero) to ``digits`` decimals, as DOUBLE.

    ``total`` is an exact integer or DECIMAL with at most ``digits`` decimals and ``count`` an
    exact number; the ratio is rounded once, in integer arithmetic.  NULL for a NULL or zero
    ``count``."""
    total, count = _col(total), _col(count)
    unit = 10 ** digits
    down = (total.cast("decimal(38,2)") * F.lit(unit).cast("decimal(9,0)")).cast("decimal(38,0)")
    over = count.cast("decimal(38,2)")
    # the same factor above and below makes both whole numbers
    n = (F.abs(down) * 100).cast("decimal(38,0)")
    d = F.abs((over * 100).cast("decimal(38,0)"))
    twice, room = (n * 2 + d).cast("decimal(38,0)"), (d * 2).cast("decimal(38,0)")
    whole = ((twice - F.pmod(twice, room)) / room).cast("decimal(38,0)").cast("double")
    sign = F.when((down < 0) != (over < 0), -1.0).otherwise(1.0)
    return F.when(over != 0, sign * whole / F.lit(float(unit)))


def exact_mean(c: Column | str) -> Column:
    """Mean of an integer or decimal column: exact sum / non-null count.

    NULL for a group without values (a pandas mean gives NaN there).
    """
    c = _col(c)
    return F.sum(c).cast("double") / null_if_zero(F.count(c))


def pct_of(part: Column | str, whole: Column | str) -> Column:
    """``part / whole * 100`` in DOUBLE, NULL for a zero ``whole``."""
    return _col(part).cast("double") / null_if_zero(_col(whole).cast("double")) * 100


def field_position(c: Column | str, values: Sequence[str]) -> Column:
    """1-based position of ``c`` in ``values``; 0 when absent or NULL (SQL FIELD)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.array_position(arr, _col(c)), F.lit(0))
