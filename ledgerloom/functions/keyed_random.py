"""Uniform draws that depend only on their key.

A draw is a pure function of (salt, seed, key), so it needs no state, no ordering and no join, gives the same
value on every recomputation, and does not move when other entities come or go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DRAW_BITS = 52  # 13 hex digits, exact in a double


def unit_draw(*key: Column) -> Column:
    """Value in [0, 1) from the leading 52 bits of sha256(key parts joined by '|')."""
    digest = F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256)
    return F.conv(F.substring(digest, 1, _DRAW_BITS // 4), 16, 10).cast("double") / F.lit(float(2**_DRAW_BITS))


def uniform(low: float, high: float, *key: Column) -> Column:
    return F.lit(low) + unit_draw(*key) * F.lit(high - low)
