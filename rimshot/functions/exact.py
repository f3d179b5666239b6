"""Sums of doubles that do not depend on the order of the rows.

A double is cut into four integers: its whole part and three limbs of 20 bits, so everything down to 2^-60 is kept.
Integers add up to the same sum in any order, in partial aggregates too, and whole-stage code generation adds them as
longs. Their total is put together as a decimal and becomes a double once, at the end. Whole parts may add up to 2^63,
limbs hold for 2^43 rows of a group. Values of 2^40 and more, infinities and NaN are added as doubles beside these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB, LIMBS = 20, 3
LARGEST = float(1 << 40)


def _limbs(x: Column) -> list[Column]:
    """Whole part and limbs as longs; each step is exact, as powers of two only move the exponent."""
    out = []
    for k in range(LIMBS + 1):
        whole = F.floor(x)
        out.append(whole)
        if k < LIMBS:
            x = (x - whole.cast("double")) * float(1 << LIMB)
    return out


def exact_sum(c: Column | str) -> Column:
    """The sum of a numeric column as a double, null without values, as ``sum`` but independent of the order."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    small = F.abs(x) < LARGEST  # false for NaN, which is greater than all numbers
    parts = [F.sum(part) for part in _limbs(F.when(small, x))]
    total = F.lit(None).cast("decimal(38,0)")
    for k, part in enumerate(parts):
        part = part.cast("decimal(20,0)")
        total = part.cast("decimal(38,0)") if k == 0 else (total * F.lit(1 << LIMB)).cast("decimal(38,0)") + part
        total = total.cast("decimal(38,0)")
    small_sum = total.cast("double") / float(1 << (LIMB * LIMBS))
    large_sum = F.sum(F.when(~small, x))
    return F.when(large_sum.isNull(), small_sum).otherwise(F.coalesce(small_sum, F.lit(0.0)) + large_sum)


def exact_avg(c: Column | str) -> Column:
    """The mean of a numeric column, null without values, independent of the order."""
    return exact_sum(c) / F.nullif(F.count(c), F.lit(0))
