"""Rounding rules of the data: half-even on the binary value, and half-up toward +infinity.

``F.round`` and ``F.bround`` round the *shortest decimal text* of a double. The figures to be
matched were rounded from the exact binary value, so 6.175 (stored slightly below) becomes 6.17.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves of 26 bits


def _product_error(x: Column, scale: float) -> Column:
    """Exact value of ``x * scale`` minus its rounded double (Dekker's product)."""
    high_part = float(scale) * _SPLIT
    s_hi = high_part - (high_part - float(scale))
    s_lo = float(scale) - s_hi
    big = x * _SPLIT
    x_hi = big - (big - x)
    x_lo = x - x_hi
    return ((x_hi * s_hi - x * scale) + x_hi * s_lo + x_lo * s_hi) + x_lo * s_lo


def round_even(x: Column, digits: int = 0) -> Column:
    """Correctly rounded half-even rounding of a double to ``digits`` decimals (below 1e8)."""
    x = x.cast("double")
    scale = 10.0**digits
    doubled = x * (2 * scale)
    half_steps = F.floor(doubled / 2).cast("double")
    rest = doubled - half_steps * 2
    error = _product_error(x, 2 * scale)
    tie_up = (error > 0) | ((error == 0) & (half_steps % 2 != 0))
    up = (rest > 1) | ((rest == 1) & tie_up)
    return (half_steps + F.when(up, 1.0).otherwise(0.0)) / scale


def round_half_up(x: Column) -> Column:
    """Nearest integer, ties toward +infinity, as BIGINT."""
    x = x.cast("double")
    whole = F.floor(x)
    return (whole + F.when(x - whole >= 0.5, 1).otherwise(0)).cast("bigint")
