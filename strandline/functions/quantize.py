"""Float precision: stored values are rounded up to a number of decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_PRECISION = 4


def effective_precision(precision: int) -> int:
    """0 stands for the default at table level; more than 15 decimals mean nothing for a double."""
    if precision < 0:
        raise ValueError("precision must not be negative")
    return min(precision or DEFAULT_PRECISION, 15)


def quantize(value: Column, precision: int) -> Column:
    """ceil(v * 10^p - 1e-9) / 10^p as a double; a value whose scaling overflows, null, NaN and infinities stay as they are."""
    scale = float(10 ** min(precision, 15))
    scaled = value.cast("double") * F.lit(scale)
    # ceil() gives a LONG; beyond its range a double has no decimals left to round
    safe = F.abs(scaled) < F.lit(9.0e18)
    return F.when(safe, F.ceil(scaled - F.lit(1e-9)).cast("double") / F.lit(scale)).otherwise(value.cast("double"))
