"""Quality gates: one aggregate row of counters and checks, optionally turned into one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.specs import EXPECTED_ROWS


def status(ok: Column, passed: str = "PASS", failed: str = "REVIEW") -> Column:
    return F.when(ok, passed).otherwise(failed)


def unknown_label() -> Column:
    return F.col("label").isNull() | ~F.col("label").isin(0, 1)


def check_rows(df: DataFrame, checks: dict[str, Column], prefix: str = "check") -> DataFrame:
    """Aggregate every check in one pass, then lay the single row out as (name, pass, status)."""
    flags = df.agg(*[ok.alias(f"c{i}") for i, ok in enumerate(checks.values())])
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.when(F.col(f"c{i}"), 1).otherwise(0).alias("check_pass"),
            status(F.col(f"c{i}")).alias("status"),
        )
        for i, name in enumerate(checks)
    ]
    return flags.select(F.inline(F.array(*rows)))


def check_summary(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    rows = check_rows(df, checks)
    n, ok = F.count(F.lit(1)), F.sum("check_pass")
    return rows.agg(
        n.alias("validation_checks"),
        ok.alias("passed_checks"),
        (n - ok).alias("failed_checks"),
        status(ok == n).alias("overall_validation_status"),
    )


def counter_gate(
    df: DataFrame,
    counters: dict[str, Column],
    names: dict[str, str],
    status_name: str,
    zero: tuple[str, ...],
    expected_rows: int | None = EXPECTED_ROWS,
) -> DataFrame:
    """Row, distinct-id and duplicate counts plus counters, and a status.

    ``names`` maps rows / distinct / duplicates to output names (leave one out to hide it);
    ``zero`` lists the counters that must be zero.
    """
    rows = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("id").alias("_distinct"),
        *[F.count_if(c).alias(k) for k, c in counters.items()],
    )
    ok = F.col("_distinct") == F.col("_rows")
    if expected_rows is not None:
        ok = ok & (F.col("_rows") == expected_rows)
    for k in zero:
        ok = ok & (F.col(k) == 0)
    base = {"rows": F.col("_rows"), "distinct": F.col("_distinct"), "duplicates": F.col("_rows") - F.col("_distinct")}
    return rows.select(*[base[k].alias(v) for k, v in names.items()], *counters, status(ok).alias(status_name))
