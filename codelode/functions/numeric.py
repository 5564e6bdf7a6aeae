"""Numbers: rounding halves up, as floor(x + 0.5), and guarded shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def round2(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL where the whole is 0 (not measured is never 0)."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def clamp(x: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def token_estimate(chars: Column, up: bool = True) -> Column:
    """Tokens of so many characters, four to one: rounded up for renderers, half up for telemetry."""
    return F.ceil(chars / 4) if up else round_half_up(chars / 4)
