"""Named bands and conditions over the panel.

Ladders are data; rules with more than one measure are small column functions. Labels and edges
are fixed values of the reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.specs import Ladder

LADDERS: dict[str, Ladder] = {}
RULES: dict[str, Callable[[], Column]] = {}
CONDITIONS: dict[str, Callable[[], Column]] = {}


def rule(fn: Callable[[], Column]) -> Callable[[], Column]:
    RULES[fn.__name__] = fn
    return fn


def where(fn: Callable[[], Column]) -> Callable[[], Column]:
    CONDITIONS[fn.__name__] = fn
    return fn


def first_match(*cases: tuple[Column, str], otherwise: str) -> Column:
    """Label of the first true condition."""
    out = None
    for cond, label in cases:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def climb(ladder: Ladder) -> Column:
    x = F.col(ladder.measure)
    cases = []
    if ladder.missing is not None:
        cases.append((x.isNull(), ladder.missing))
    if ladder.negative is not None:
        cases.append((x < 0, ladder.negative))
    if ladder.zero is not None:
        cases.append((x == 0, ladder.zero))
    cases += [((x < edge) if ladder.closed == "left" else (x <= edge), label) for edge, label in ladder.steps]
    return first_match(*cases, otherwise=ladder.top)


def band(name: str) -> Column:
    """The band column for a name; ``const:text`` is the text itself, ``col:name`` a column."""
    if name.startswith("col:"):
        return F.col(name.removeprefix("col:"))
    if name.startswith("const:"):
        return F.lit(name.removeprefix("const:"))
    return climb(LADDERS[name]) if name in LADDERS else RULES[name]()


def condition(name: str) -> Column:
    return CONDITIONS[name]()
