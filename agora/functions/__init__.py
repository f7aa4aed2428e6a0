"""Column expressions shared by the analyses (all JVM-side, codegen friendly)."""

from agora.functions.scalar import (
    calendar_days, elapsed_days, exact_mean, field_position, half_up, month_period,
    null_if_zero, pct_of, weekday_name,
)

__all__ = [
    "calendar_days", "elapsed_days", "exact_mean", "field_position", "half_up", "month_period",
    "null_if_zero", "pct_of", "weekday_name",
]
