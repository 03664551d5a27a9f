"""Number helpers shared by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_TOLERANCE = 1e-6
"""Added (in units of the last kept digit) before rounding half up, so that an exact tie rounds
the same way no matter in which order the partial sums were added."""


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: str | Column, digits: int = 2) -> Column:
    """Half-up rounding that does not depend on partial-sum order."""
    scale = float(10**digits)
    return F.floor(col(x).cast("double") * scale + (0.5 + TIE_TOLERANCE)) / F.lit(scale)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Double division, NULL when the denominator is zero or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def percent(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    return rounded(ratio(col(num) * F.lit(100.0), den), digits)


def either_total(*cols: str) -> Column:
    """Sum that treats a missing part as zero unless every part is missing."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.when(cond, 1).otherwise(0)


def sum_columns(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total
