"""Column functions over the three-period vector of one measure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast import PERIODS


def vector(measure: str) -> list[Column]:
    return [F.col(f"{measure}_{p}") for p in PERIODS]


def every(cols: list[Column], test) -> Column:
    out = test(cols[0])
    for c in cols[1:]:
        out = out & test(c)
    return out


def some(cols: list[Column], test) -> Column:
    out = test(cols[0])
    for c in cols[1:]:
        out = out | test(c)
    return out


def is_null(c: Column) -> Column:
    return c.isNull()


def is_zero(c: Column) -> Column:
    return c == 0


def steps(measure: str, test) -> Column:
    """``test(earlier, later)`` holds for both neighbouring pairs of periods."""
    first, second, third = vector(measure)
    return test(first, second) & test(second, third)


def rising(a: Column, b: Column) -> Column:
    return a < b


def falling(a: Column, b: Column) -> Column:
    return a > b


def last_two(measure: str) -> tuple[Column, Column]:
    return F.col(f"{measure}_7"), F.col(f"{measure}_8")


def fell(measure: str) -> Column:
    """The last period is below the one before it."""
    before, now = last_two(measure)
    return now < before
