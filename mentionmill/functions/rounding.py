"""Decimal rounding of the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 splits a double into two halves whose products are exact.
_SPLIT = 134217729


def round_exact(column: str, digits: int) -> Column:
    """Round a double column like a correctly rounded decimal conversion does.

    ``round`` and ``bround`` look at the shortest decimal form of a double, so 1/80 (slightly above
    0.0125) counts as a tie there. Here the error of ``value * 10**digits`` is computed exactly and
    decides such cases. Meant for moderate magnitudes (scores and shares).
    """
    scale = f"{10**digits}D"
    product = f"({column} * {scale})"
    high = f"({column} * {_SPLIT}D - ({column} * {_SPLIT}D - {column}))"
    # scale has few bits, so both partial products are exact
    error = f"(({high} * {scale} - {product}) + ({column} - {high}) * {scale})"
    below = f"CAST(floor({product}) AS DOUBLE)"
    side = f"({product} - {below} - 0.5D)"
    up = f"{side} > 0 OR ({side} = 0 AND ({error} > 0 OR ({error} = 0 AND pmod({below}, 2D) = 1)))"
    return F.expr(f"CASE WHEN {up} THEN {below} + 1 ELSE {below} END / {scale}")
