"""Declarative report specs: what to group by and what to show, as plain data.

``holdfast.operators.profile`` turns a spec into a DataFrame plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

MIN_CUSTOMERS = 100
"""Groups below this size are dropped (or flagged) where a report asks for it."""

EXPECTED_ROWS = 69_999
"""Row count the quality gates expect unless told otherwise."""


@dataclass(frozen=True)
class Ladder:
    """Labels for consecutive intervals of one measure.

    ``steps`` are (upper edge, label), lowest first. ``closed`` says which side an interval keeps:
    ``left`` means x < edge, ``right`` means x <= edge. A NULL gets ``missing``, or ``top`` when
    no missing label is given.
    """

    measure: str
    steps: tuple[tuple[float, str], ...]
    top: str
    missing: str | None = None
    negative: str | None = None
    zero: str | None = None
    closed: str = "left"


@dataclass(frozen=True)
class Count:
    pass


@dataclass(frozen=True)
class Churners:
    pass


@dataclass(frozen=True)
class Retained:
    pass


@dataclass(frozen=True)
class Rate:
    """Churners per 100 customers of the group."""


@dataclass(frozen=True)
class Share:
    """Customers of the group per 100 customers of all shown groups (or of its ``by`` partition)."""

    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contribution:
    """Churners of the group per 100 churners of all shown groups (or of its ``by`` partition)."""

    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mean:
    measure: str
    digits: int = 2


@dataclass(frozen=True)
class Total:
    """Sum of a measure; a churned_only total counts churned customers alone."""

    measure: str
    churned_only: bool = False


@dataclass(frozen=True)
class TotalShare:
    measure: str
    churned_only: bool = False


@dataclass(frozen=True)
class Lowest:
    measure: str


@dataclass(frozen=True)
class Highest:
    measure: str


@dataclass(frozen=True)
class SizeFlag:
    """Text flag for groups smaller than ``below``."""

    small: str
    standard: str
    below: int = MIN_CUSTOMERS


@dataclass(frozen=True)
class Standing:
    """1, 2, 3 … over the shown groups by another shown column, highest first, with gaps after ties."""

    of: object
    unique: bool = False
    tie: str | None = None


Metric = object


@dataclass(frozen=True)
class Profile:
    """Group customers by named bands and show metrics per group.

    A ``ranked`` profile adds the value rank first. ``before_rank`` names the bands computed ahead
    of it, so that only those, the shown measures and the rank keys are sorted and stored.
    """

    keys: dict[str, str]
    show: dict[str, Metric]
    where: str | None = None
    min_customers: int = 0
    guard: str = "before_share"
    min_share: float | None = None
    ranked: bool = False
    before_rank: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Stacked:
    """Several bandings or cohorts of the same customers under one another, from a single scan.

    ``parts`` are (first key value, band name or None, condition name or None). With a band the
    second key column holds the band's label; with a condition only customers that meet it count.
    """

    keys: tuple[str, ...]
    parts: tuple[tuple[str, str | None, str | None], ...]
    show: dict[str, Metric]
    min_customers: int = 0
    guard: str = "before_share"
    min_share: float | None = None
    min_population_share: float | None = None
