"""Customer value and revenue exposure: value table, summaries, concentration and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.gate import check_rows
from holdfast.operators.quantiles import medians_wide
from holdfast.operators.ranking import average_rank_percent, global_rank
from holdfast.operators.risk import RISK_SCHEMA, risk_rows, risk_table
from holdfast.operators.scoring import LEVELS, PRIMARY_THRESHOLD
from holdfast.session import materialise
from holdfast.specs import EXPECTED_ROWS

MONTHS = 12
CONCENTRATION = (1, 5, 10, 20, 50)
TIERS = ((25, "Lower Value"), (50, "Mid-Lower Value"), (75, "Mid-Upper Value"))
TOP_TIER = "Higher Value"
MONEY = 4
"""Decimals kept for sums of money."""

P, EXPOSURE = "calibrated_churn_probability", "potential_monthly_revenue_exposure"
VALUE_SCHEMA = RISK_SCHEMA | {
    "arpu_8": "double",
    "customer_value_proxy_arpu_8": "double",
    "exposure_eligible_arpu_8": "double",
    "customer_value_percentile": "double",
    "customer_value_tier": "string",
    EXPOSURE: "double",
    "annualized_scenario_exposure": "double",
    "customer_exposure_share_pct": "double",
    "revenue_exposure_percentile": "double",
    "revenue_exposure_rank": "bigint",
}
VALUE_COLUMNS = tuple(VALUE_SCHEMA)


def exposure_rows(scores: DataFrame, primary: float = PRIMARY_THRESHOLD) -> DataFrame:
    """Risk columns plus eligible value and monthly exposure per customer; no ranks, so no sort."""
    return with_exposure(risk_rows(scores, primary))


def with_exposure(rows: DataFrame) -> DataFrame:
    eligible = F.greatest(F.col("arpu_8"), F.lit(0.0))
    return (
        rows.withColumn("exposure_eligible_arpu_8", eligible)
        .withColumn(EXPOSURE, F.col(P) * F.col("exposure_eligible_arpu_8"))
        .withColumn("annualized_scenario_exposure", F.col(EXPOSURE) * MONTHS)
    )


def value_tier(percentile: Column) -> Column:
    out = F.when(percentile <= TIERS[0][0], TIERS[0][1])
    for edge, name in TIERS[1:]:
        out = out.when(percentile <= edge, name)
    return out.otherwise(TOP_TIER)


def with_tier(rows: DataFrame) -> DataFrame:
    ranked = average_rank_percent(rows, "exposure_eligible_arpu_8", "customer_value_percentile")
    return ranked.withColumn("customer_value_tier", value_tier(F.col("customer_value_percentile")))


def exposure_order() -> list[Column]:
    return [F.col(EXPOSURE).desc(), F.col(P).desc(), F.col("exposure_eligible_arpu_8").desc(), F.col("id").asc()]


def value_table(scores: DataFrame) -> DataFrame:
    """The full value table. ``scores`` holds id, label, score and arpu_8, one row per customer."""
    scores = materialise(scores.select("id", "label", "score", "arpu_8"))
    risk = risk_table(scores)
    joined = materialise(with_exposure(risk.join(scores.select("id", "arpu_8"), "id")))
    tiered = materialise(with_tier(joined))
    whole = joined.groupBy(F.lit(1).alias("_one")).agg(F.sum(EXPOSURE).alias("_all"))
    placed = average_rank_percent(tiered, EXPOSURE, "revenue_exposure_percentile")
    ranked = global_rank(placed, exposure_order(), "revenue_exposure_rank", "_n")
    shares = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")
    share = F.coalesce(ratio(F.col(EXPOSURE) * 100.0, "_all"), F.lit(0.0))
    return (
        shares.withColumn("customer_exposure_share_pct", share)
        .withColumn("customer_value_proxy_arpu_8", F.col("arpu_8"))
        .select(*VALUE_COLUMNS)
    )


def shown_value_table(scores: DataFrame) -> DataFrame:
    """The value table with derived numbers rounded for display."""
    rounding = {
        "customer_value_percentile": 6,
        EXPOSURE: 6,
        "annualized_scenario_exposure": 5,
        "customer_exposure_share_pct": 6,
        "revenue_exposure_percentile": 6,
    }
    table = value_table(scores)
    return table.select(*[rounded(c, rounding[c]).alias(c) if c in rounding else F.col(c) for c in VALUE_COLUMNS])


def value_summary(scores: DataFrame) -> DataFrame:
    """(metric, value) rows of the whole customer base."""
    rows = materialise(exposure_rows(scores.select("id", "label", "score", "arpu_8")))
    one = F.lit(1).alias("_one")
    arpu, eligible = F.col("arpu_8"), F.col("exposure_eligible_arpu_8")
    named = {
        "Customer Count": F.count(F.lit(1)).cast("double"),
        "Customers With August ARPU": F.count("arpu_8").cast("double"),
        "Negative August ARPU Customers": F.count_if(arpu < 0).cast("double"),
        "Exposure Eligible ARPU Customers": F.count_if(eligible > 0).cast("double"),
        "Minimum August ARPU": rounded(F.min("arpu_8"), MONEY),
        "Maximum August ARPU": rounded(F.max("arpu_8"), MONEY),
        "Average August ARPU": rounded(F.avg("arpu_8"), MONEY),
        "Total Exposure-Eligible ARPU": rounded(F.sum(eligible), MONEY),
        "Total Potential Monthly Exposure": rounded(F.sum(EXPOSURE), MONEY),
        "Total Annualized Scenario Exposure": rounded(F.sum("annualized_scenario_exposure"), MONEY),
    }
    sums = rows.groupBy(one).agg(*[c.alias(f"m{i}") for i, c in enumerate(named.values())])
    middle = medians_wide(rows, ["arpu_8"])
    both = sums.join(F.broadcast(middle), "_one")
    entries = [F.struct(F.lit(k).alias("metric"), F.col(f"m{i}").alias("value")) for i, k in enumerate(named)]
    entries.append(F.struct(F.lit("Median August ARPU").alias("metric"), rounded("arpu_8", MONEY).alias("value")))
    return both.select(F.inline(F.array(*entries)))


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per group plus the exposure share of all groups."""
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(P).alias("p"),
        F.avg("arpu_8").alias("arpu"),
        F.sum("exposure_eligible_arpu_8").alias("eligible"),
        F.sum(EXPOSURE).alias("exposure"),
    )
    whole = Window.partitionBy()
    share = F.coalesce(ratio(F.col("exposure") * 100.0, F.sum("exposure").over(whole)), F.lit(0.0))
    return groups.withColumns(
        {
            "exposure_share": share,
            "customer_share": ratio(F.col("customers") * 100.0, F.sum("customers").over(whole)),
        }
    )


MEANS = (("p", "avg_churn_probability", 6), ("arpu", "avg_arpu", MONEY))


def _shown_sums() -> list[Column]:
    out = [rounded(src, d).alias(name) for src, name, d in MEANS]
    out.append(rounded("exposure", MONEY).alias(EXPOSURE))
    out.append(rounded(F.col("exposure") * MONTHS, MONEY).alias("annualized_scenario_exposure"))
    out.append(rounded("exposure_share", 6).alias("exposure_share_pct"))
    return out


def exposure_by_risk(scores: DataFrame) -> DataFrame:
    return _grouped(exposure_rows(scores), ["risk_level"]).select(
        "risk_level",
        "customers",
        rounded("customer_share", 6).alias("customer_share_pct"),
        *_shown_sums(),
        rounded("eligible", MONEY).alias("total_exposure_eligible_arpu"),
        rounded(F.col("exposure_share") - F.col("customer_share"), 6).alias("exposure_minus_customer_share_pp"),
    )


def _tiered(scores: DataFrame) -> DataFrame:
    return with_tier(materialise(exposure_rows(scores.select("id", "label", "score", "arpu_8"))))


def exposure_by_tier(scores: DataFrame) -> DataFrame:
    return _grouped(_tiered(scores), ["customer_value_tier"]).select(
        "customer_value_tier",
        "customers",
        *_shown_sums(),
        rounded("customer_share", 6).alias("customer_share_pct"),
    )


def risk_value_matrix(scores: DataFrame) -> DataFrame:
    keys = ["risk_level", "customer_value_tier"]
    return _grouped(_tiered(scores), keys).select(*keys, "customers", *_shown_sums())


def ranked_exposure(scores: DataFrame) -> DataFrame:
    """Customers ranked by exposure, probability, value (all falling) and id."""
    rows = exposure_rows(scores.select("id", "label", "score", "arpu_8"))
    return global_rank(rows, exposure_order(), "exposure_rank", "universe")


def concentration(scores: DataFrame, percents: tuple[int, ...] = CONCENTRATION) -> DataFrame:
    """Exposure of the top ceil(n * percent) customers: one ranking, five conditional sums."""
    k = {p: F.greatest(F.ceil(F.col("universe") * p / 100.0), F.lit(1)) for p in percents}
    sums = ranked_exposure(scores).agg(
        F.sum(EXPOSURE).alias("whole"),
        *[F.max(k[p]).alias(f"k{p}") for p in percents],
        *[F.sum(F.when(F.col("exposure_rank") <= k[p], F.col(EXPOSURE))).alias(f"v{p}") for p in percents],
    )
    rows = [
        F.struct(
            F.lit(p).alias("top_customer_percent"),
            F.col(f"k{p}").alias("customer_count"),
            F.col(f"v{p}").alias("v"),
        )
        for p in percents
    ]
    return sums.select("whole", F.inline(F.array(*rows))).select(
        "top_customer_percent",
        "customer_count",
        rounded("v", MONEY).alias("monthly_exposure"),
        rounded(F.coalesce(ratio(F.col("v") * 100.0, "whole"), F.lit(0.0)), 6).alias("exposure_share_pct"),
    )


def top_exposure(scores: DataFrame, k: int = 100) -> DataFrame:
    """The k customers with the largest exposure: a top-k, not a full sort."""
    return (
        exposure_rows(scores.select("id", "label", "score", "arpu_8"))
        .orderBy(*exposure_order())
        .limit(k)
        .select("id", P, "risk_level", "arpu_8", rounded(EXPOSURE, 6).alias(EXPOSURE))
    )


def _every(cond: Column) -> Column:
    return F.count_if(~F.coalesce(cond, F.lit(False))) == 0


def value_gate(table: DataFrame, expected_rows: int = EXPECTED_ROWS) -> DataFrame:
    """Checks of a value table. Zero is an eligible value that was not negative, so <= is used."""
    schema_holds = table.dtypes == list(VALUE_SCHEMA.items())
    table = materialise(table.select(*VALUE_COLUMNS))
    nxt = table.select(
        (F.col("revenue_exposure_rank") - 1).alias("revenue_exposure_rank"), F.col(EXPOSURE).alias("next_exposure")
    )
    rows = table.join(nxt, "revenue_exposure_rank", "left")
    n, p, exposure = F.count(F.lit(1)), F.col(P), F.col(EXPOSURE)
    eligible = F.col("exposure_eligible_arpu_8")
    checks = {  # fixed values: check names
        "Customer universe": n == expected_rows,
        "Unique customer IDs": F.count_distinct("id") == n,
        "No missing customer IDs": _every(F.col("id").isNotNull()),
        "Calibrated probabilities present": _every(p.isNotNull()),
        "Calibrated probabilities valid": _every(p.between(0.0, 1.0)),
        "Risk levels valid": _every(F.col("risk_level").isin(*LEVELS)),
        "Primary threshold preserved": _every(F.col("primary_threshold") == PRIMARY_THRESHOLD),
        "August ARPU complete": _every(F.col("arpu_8").isNotNull()),
        "Raw negative ARPU preserved": _every(F.col("arpu_8").isNull() | ((F.col("arpu_8") <= 0) == (eligible == 0))),
        "Monthly exposure formula": _every(F.abs(exposure - p * eligible) <= 1e-9),
        "Annualized exposure formula": _every(
            F.abs(F.col("annualized_scenario_exposure") - exposure * MONTHS) <= 1e-6
        ),
        "No negative revenue exposure": _every(exposure >= 0),
        "Exposure shares valid": _every(F.col("customer_exposure_share_pct").between(0.0, 100.0)),
        "Customer exposure shares sum correctly": F.abs(F.sum("customer_exposure_share_pct") - 100.0) <= 1e-6,
        "Revenue exposure ranking": (F.min("revenue_exposure_rank") == 1)
        & (F.max("revenue_exposure_rank") == n)
        & (F.count_distinct("revenue_exposure_rank") == n),
        "Exposure sorted descending": _every(
            F.col("next_exposure").isNull() | (exposure >= F.col("next_exposure"))
        ),
        "Output schema": F.lit(schema_holds) & (n >= 0),
    }
    return check_rows(rows, checks)


def customer_lookup(table: DataFrame, customer_id: int) -> DataFrame:
    """The value record of one customer; the filter reaches the scan of a stored table."""
    return table.filter(F.col("id") == customer_id)


def record_checks(scores: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Formula checks every value record must pass, counted over the whole table."""
    rows = exposure_rows(scores.select("id", "label", "score", "arpu_8"))
    exposure, eligible = F.col(EXPOSURE), F.col("exposure_eligible_arpu_8")
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.abs(exposure - F.col(P) * eligible) > tolerance).alias("monthly_formula_violations"),
        F.count_if(F.abs(F.col("annualized_scenario_exposure") - exposure * MONTHS) > tolerance).alias(
            "annual_formula_violations"
        ),
        F.count_if(eligible < 0).alias("negative_eligible_values"),
        F.count_if(exposure > eligible).alias("exposure_above_value"),
        F.count_if(F.col("arpu_8").isNull()).alias("records_without_value"),
    )
