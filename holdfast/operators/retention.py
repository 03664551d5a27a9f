"""Targeting cohorts, retention economics and the sensitivity grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.exposure import EXPOSURE, MONEY, P, exposure_rows
from holdfast.operators.gate import check_rows
from holdfast.operators.ranking import global_rank
from holdfast.specs import EXPECTED_ROWS

HORIZON_MONTHS = 12
# Retention scenarios as (id, name, cost per customer, success rate).
SCENARIOS = (
    ("low_touch", "Low-Touch Retention", 100.0, 0.20),
    ("targeted", "Targeted Retention", 250.0, 0.35),
    ("high_touch", "High-Touch Retention", 500.0, 0.50),
)
SUCCESS_RATES = (0.10, 0.20, 0.30, 0.35, 0.40, 0.50, 0.60, 0.70, 0.80)
COSTS = (100.0, 250.0, 500.0)
TOP_PERCENTS = (1, 5, 10, 20)
RISK_COHORT = "High + Very High Risk"
OUTSIDE = "Outside Locked Cohorts"
ROBUSTNESS = ((0.10, "Robustly viable"), (0.50, "Conditionally viable"), (0.80, "Weakly viable"))
NOT_ROBUST = "Not viable within tested range"


def cohort_name(percent: int) -> str:
    return f"Top {percent}% Exposure"


def ranked_customers(scores: DataFrame) -> DataFrame:
    """Customers ranked by exposure, probability and id, with the cohort cut-offs' universe size."""
    rows = exposure_rows(scores.select("id", "label", "score", "arpu_8")).select(
        "id", P, "risk_level", "actual_churn", EXPOSURE
    )
    rows = rows.withColumn(EXPOSURE, F.coalesce(EXPOSURE, F.lit(0.0)))
    order = [F.col(EXPOSURE).desc(), F.col(P).desc(), F.col("id").asc()]
    return global_rank(rows, order, "exposure_rank", "universe")


def inside_top(percent: int) -> Column:
    return F.col("exposure_rank") <= F.greatest(F.ceil(F.col("universe") * percent / 100.0), F.lit(1))


def at_risk() -> Column:
    return F.col("risk_level").isin("High", "Very High")


def cohort_conditions() -> dict[str, Column]:
    return {**{cohort_name(p): inside_top(p) for p in TOP_PERCENTS}, RISK_COHORT: at_risk()}


def cohort_sums(ranked: DataFrame) -> DataFrame:
    """Sums of the five overlapping cohorts and the universe: one pass, five conditional entries."""
    entries = [F.when(cond, F.lit(name)) for name, cond in cohort_conditions().items()]
    tagged = ranked.select(
        P, "actual_churn", EXPOSURE, at_risk().alias("at_risk"),
        F.explode(F.array_compact(F.array(*entries, F.lit("*")))).alias("targeting_cohort"),
    )
    sums = tagged.groupBy("targeting_cohort").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col(EXPOSURE) > 0).alias("positive"),
        F.sum(EXPOSURE).alias("exposure"),
        F.sum("actual_churn").cast("bigint").alias("churned"),
        F.avg(P).alias("p"),
        F.count_if("at_risk").alias("risky"),
    )
    everyone = Window.partitionBy()

    def of_all(c: str) -> Column:
        return F.max(F.when(F.col("targeting_cohort") == "*", F.col(c))).over(everyone)

    return sums.withColumns(
        {"universe": of_all("customers"), "all_exposure": of_all("exposure"), "all_churned": of_all("churned")}
    ).filter(F.col("targeting_cohort") != "*")


def targeting_cohorts(scores: DataFrame) -> DataFrame:
    population = ratio(F.col("customers") * 100.0, "universe")
    capture = ratio(F.col("exposure") * 100.0, "all_exposure")
    return cohort_sums(ranked_customers(scores)).select(
        "targeting_cohort",
        F.col("customers").alias("targeted_customers"),
        rounded(population, 6).alias("targeting_population_pct"),
        F.col("positive").alias("positive_exposure_customers"),
        rounded(ratio(F.col("positive") * 100.0, "customers"), 6).alias("positive_exposure_share_pct"),
        rounded("exposure", MONEY).alias("monthly_revenue_exposure_inr"),
        rounded(capture, 6).alias("monthly_exposure_capture_pct"),
        rounded(F.col("exposure") * HORIZON_MONTHS, MONEY).alias("annualized_revenue_exposure_inr"),
        rounded(ratio("exposure", "customers"), MONEY).alias("average_monthly_exposure_per_customer_inr"),
        rounded(ratio(capture, population), 6).alias("exposure_capture_efficiency"),
        rounded(ratio(capture, population), 6).alias("exposure_captured_per_1pct_population_targeted"),
        F.col("churned").alias("historical_churned_customers"),
        rounded(ratio(F.col("churned") * 100.0, "all_churned"), 6).alias("historical_churn_capture_pct"),
        rounded("p", 6).alias("average_calibrated_churn_probability"),
        F.col("risky").alias("high_very_high_risk_customers"),
        rounded(ratio(F.col("risky") * 100.0, "customers"), 6).alias("high_very_high_risk_share_pct"),
    )


def cohort_overlap(scores: DataFrame) -> DataFrame:
    """Each exposure cohort against the high-risk cohort, by conditional sums in one pass."""
    ranked = ranked_customers(scores)
    aggs = []
    for p in TOP_PERCENTS:
        both = inside_top(p) & at_risk()
        aggs += [
            F.count_if(inside_top(p)).alias(f"n{p}"),
            F.count_if(both).alias(f"b{p}"),
            F.sum(F.when(inside_top(p), F.col(EXPOSURE))).alias(f"e{p}"),
            F.coalesce(F.sum(F.when(both, F.col(EXPOSURE))), F.lit(0.0)).alias(f"be{p}"),
            F.coalesce(F.sum(F.when(both, F.col("actual_churn"))), F.lit(0)).alias(f"bc{p}"),
        ]
    rows = [
        F.struct(
            F.lit(cohort_name(p)).alias("exposure_cohort"),
            F.col(f"n{p}").alias("exposure_cohort_customers"),
            F.col(f"b{p}").alias("high_very_high_overlap_customers"),
            F.col(f"e{p}").alias("e"),
            F.col(f"be{p}").alias("be"),
            F.col(f"bc{p}").cast("bigint").alias("overlap_historical_churned_customers"),
        )
        for p in TOP_PERCENTS
    ]
    share = ratio(F.col("high_very_high_overlap_customers") * 100.0, "exposure_cohort_customers")
    return ranked.agg(*aggs).select(F.inline(F.array(*rows))).select(
        "exposure_cohort",
        "exposure_cohort_customers",
        "high_very_high_overlap_customers",
        rounded(share, 6).alias("high_very_high_overlap_share_of_cohort_pct"),
        rounded("be", MONEY).alias("overlap_monthly_revenue_exposure_inr"),
        rounded(ratio(F.col("be") * 100.0, "e"), 6).alias("overlap_exposure_share_of_cohort_pct"),
        "overlap_historical_churned_customers",
    )


def assigned_cohort() -> Column:
    """Exclusive cohort: the narrowest exposure cohort a customer is in."""
    out = F.when(inside_top(TOP_PERCENTS[0]), cohort_name(TOP_PERCENTS[0]))
    for p in TOP_PERCENTS[1:]:
        out = out.when(inside_top(p), cohort_name(p))
    return out.otherwise(OUTSIDE)


def cohort_assignment(scores: DataFrame) -> DataFrame:
    return ranked_customers(scores).select(
        "id",
        "exposure_rank",
        rounded(ratio("exposure_rank", "universe"), 6).alias("exposure_percentile"),
        assigned_cohort().alias("targeting_cohort"),
        at_risk().alias("high_very_high_risk_flag"),
    )


def cohort_counts(scores: DataFrame) -> DataFrame:
    return (
        ranked_customers(scores)
        .groupBy(assigned_cohort().alias("targeting_cohort"))
        .agg(F.count(F.lit(1)).alias("customer_count"))
    )


def _scenario_array() -> str:
    rows = ", ".join(
        f"struct('{i}' AS scenario_id, '{name}' AS scenario_name, {cost}D AS cost, {rate}D AS success)"
        for i, name, cost, rate in SCENARIOS
    )
    return f"inline(array({rows}))"


def scenario_economics(scores: DataFrame, by_risk: bool = False) -> DataFrame:
    """Base scenarios applied to every customer, summed over all or per risk level.

    Net value, cost and retained revenue are sums of per-customer terms, so customers are summed
    before the scenarios multiply the few result rows; only the break-even count needs a
    per-scenario condition on the customer row.
    """
    rows = exposure_rows(scores.select("id", "label", "score", "arpu_8"))
    exposure = F.coalesce(F.col(EXPOSURE), F.lit(0.0))
    keys = ["risk_level"] if by_risk else []
    even = [
        F.count_if((exposure > 0) & (exposure * HORIZON_MONTHS * rate >= cost)).alias(f"even_{i}")
        for i, _, cost, rate in SCENARIOS
    ]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(exposure > 0).alias("positive_exposure_customers"),
        F.sum(exposure).alias("exposure"),
        *even,
    )
    long = sums.selectExpr("*", _scenario_array())
    reached = F.lit(0)
    for i, *_ in SCENARIOS:
        reached = F.when(F.col("scenario_id") == i, F.col(f"even_{i}")).otherwise(reached)
    retained = F.col("exposure") * F.col("success")
    horizon, spent = retained * HORIZON_MONTHS, F.col("customers") * F.col("cost")
    net = horizon - spent
    shown = [
        "scenario_id",
        "scenario_name",
        *keys,
        "customers",
        rounded("exposure", MONEY).alias("total_monthly_exposure_inr"),
        rounded(horizon, MONEY).alias("expected_retained_revenue_horizon_inr"),
        rounded(spent, MONEY).alias("intervention_cost_inr"),
        rounded(net, MONEY).alias("expected_net_value_inr"),
        rounded(ratio(net, spent), 6).alias("scenario_roi"),
    ]
    if not by_risk:
        shown += [
            F.col("cost").alias("intervention_cost_inr_per_customer"),
            F.col("success").alias("assumed_retention_success_rate"),
            "positive_exposure_customers",
            rounded(retained, MONEY).alias("total_expected_monthly_revenue_retained_inr"),
            reached.cast("bigint").alias("customers_break_even_achieved"),
            rounded(ratio(reached, "customers"), 6).alias("break_even_achievement_share"),
        ]
    return long.select(*shown)


def economics_terms(exposure: Column, customers: Column, cost: Column, success: Column) -> dict[str, Column]:
    """Retained revenue, cost, net value, ROI and break-even of one cohort under one assumption."""
    annual = exposure * HORIZON_MONTHS
    monthly = exposure * success
    horizon = monthly * HORIZON_MONTHS
    spent = customers * cost
    net = horizon - spent
    even = ratio(spent, annual)
    return {
        "annual": annual,
        "monthly": monthly,
        "horizon": horizon,
        "spent": spent,
        "net": net,
        "roi": ratio(net, spent),
        "even": even,
        "feasible": F.coalesce(even <= 1.0, F.lit(False)),
        "above": F.coalesce(success >= even, F.lit(False)),
        "viable": net > 0,
    }


def price_cohorts(sums: DataFrame) -> DataFrame:
    """Cohort sums (one row per cohort) times the base scenarios."""
    long = sums.selectExpr("*", _scenario_array())
    t = economics_terms(F.col("exposure"), F.col("customers"), F.col("cost"), F.col("success"))
    return long.select(
        "targeting_cohort",
        "scenario_id",
        "scenario_name",
        F.col("customers").alias("targeted_customers"),
        rounded(ratio(F.col("customers") * 100.0, "universe"), 6).alias("targeting_population_pct"),
        rounded(ratio(F.col("exposure") * 100.0, "all_exposure"), 6).alias("monthly_exposure_capture_pct"),
        F.col("cost").alias("intervention_cost_per_customer_inr"),
        F.col("success").alias("retention_success_rate"),
        rounded(t["monthly"], MONEY).alias("expected_monthly_revenue_retained_inr"),
        rounded(t["horizon"], MONEY).alias("expected_revenue_retained_over_horizon_inr"),
        rounded(t["spent"], MONEY).alias("total_intervention_cost_inr"),
        rounded(t["net"], MONEY).alias("expected_net_value_inr"),
        rounded(ratio(t["net"], "customers"), MONEY).alias("net_value_per_targeted_customer_inr"),
        rounded(t["roi"], 6).alias("roi"),
        rounded(t["roi"] * 100.0, 6).alias("roi_pct"),
        rounded(t["even"] * 100.0, 6).alias("break_even_retention_success_rate_pct"),
        t["feasible"].alias("break_even_feasible"),
        t["above"].alias("retention_success_above_break_even"),
        rounded(ratio(t["spent"] * 100.0, t["annual"]), 6).alias("intervention_cost_as_pct_of_annualized_exposure"),
        t["viable"].alias("economically_viable"),
    )


def cohort_economics(scores: DataFrame) -> DataFrame:
    return price_cohorts(cohort_sums(ranked_customers(scores)))


def robustness(even: Column) -> Column:
    out = F.when(even <= ROBUSTNESS[0][0], ROBUSTNESS[0][1])
    for edge, name in ROBUSTNESS[1:]:
        out = out.when(even <= edge, name)
    return out.otherwise(NOT_ROBUST)


def grid_rows(sums: DataFrame) -> DataFrame:
    """Cohort sums times every success rate and every cost, unrounded."""
    rates = ", ".join(f"{r}D" for r in SUCCESS_RATES)
    costs = ", ".join(f"{c}D" for c in COSTS)
    long = sums.withColumn("retention_success_rate", F.expr(f"explode(array({rates}))")).withColumn(
        "intervention_cost_per_customer", F.expr(f"explode(array({costs}))")
    )
    t = economics_terms(
        F.col("exposure"), F.col("customers"), F.col("intervention_cost_per_customer"), F.col("retention_success_rate")
    )
    return long.select(
        "targeting_cohort",
        F.col("customers").alias("customer_count"),
        F.col("exposure").alias("monthly_revenue_exposure"),
        t["annual"].alias("annualized_revenue_exposure"),
        F.col("churned").alias("historical_churn_count"),
        ratio("churned", "customers").alias("historical_churn_rate"),
        "retention_success_rate",
        "intervention_cost_per_customer",
        t["horizon"].alias("expected_horizon_retained_value"),
        t["spent"].alias("campaign_cost"),
        t["net"].alias("net_value"),
        t["roi"].alias("roi"),
        t["even"].alias("break_even_success_rate"),
        t["feasible"].alias("break_even_feasible"),
        t["above"].alias("success_above_break_even"),
        t["viable"].alias("economically_viable"),
        robustness(t["even"]).alias("robustness_class"),
    )


def sensitivity_rows(scores: DataFrame) -> DataFrame:
    return grid_rows(cohort_sums(ranked_customers(scores)))


MONEY_COLUMNS = (
    "monthly_revenue_exposure",
    "annualized_revenue_exposure",
    "expected_horizon_retained_value",
    "campaign_cost",
    "net_value",
    "best_net_value",
    "worst_net_value",
)
RATE_COLUMNS = (
    "historical_churn_rate",
    "roi",
    "break_even_success_rate",
    "best_roi",
    "worst_roi",
    "economic_viability_rate",
    "minimum_break_even_success",
    "maximum_break_even_success",
)


def displayed(df: DataFrame) -> DataFrame:
    digits = {**dict.fromkeys(MONEY_COLUMNS, MONEY), **dict.fromkeys(RATE_COLUMNS, 6)}
    return df.select(*[rounded(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def sensitivity_grid(scores: DataFrame) -> DataFrame:
    return displayed(sensitivity_rows(scores))


def monotonicity(grid: DataFrame) -> DataFrame:
    """Net value and ROI must not fall with success; net value must not rise with cost."""
    by_success = Window.partitionBy("targeting_cohort", "intervention_cost_per_customer").orderBy(
        "retention_success_rate"
    )
    by_cost = Window.partitionBy("targeting_cohort", "retention_success_rate").orderBy(
        "intervention_cost_per_customer"
    )

    def holds(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(True))

    steps = grid.select(
        "targeting_cohort",
        holds(F.col("net_value") >= F.lag("net_value").over(by_success)).alias("a"),
        holds(F.col("roi") >= F.lag("roi").over(by_success)).alias("b"),
        holds(F.col("net_value") <= F.lag("net_value").over(by_cost)).alias("c"),
    )
    return steps.groupBy("targeting_cohort").agg(
        F.bool_and("a").alias("net_value_rises_with_success"),
        F.bool_and("b").alias("roi_rises_with_success"),
        F.bool_and("c").alias("net_value_falls_with_cost"),
    )


def _viable() -> Column:
    return F.count_if("economically_viable")


def break_even_summary(grid: DataFrame) -> DataFrame:
    groups = grid.groupBy("targeting_cohort", "intervention_cost_per_customer").agg(
        F.first("customer_count").alias("customer_count"),
        F.first("annualized_revenue_exposure").alias("annualized_revenue_exposure"),
        F.first("break_even_success_rate").alias("break_even_success_rate"),
        F.first("break_even_feasible").alias("break_even_feasible"),
        F.min("retention_success_rate").alias("minimum_tested_success_rate"),
        F.max("retention_success_rate").alias("maximum_tested_success_rate"),
        _viable().alias("economically_viable_scenarios"),
        F.count(F.lit(1)).alias("tested_scenarios"),
        F.max("net_value").alias("best_net_value"),
        F.min("net_value").alias("worst_net_value"),
        F.max("roi").alias("best_roi"),
        F.min("roi").alias("worst_roi"),
    )
    return displayed(
        groups.withColumn("economic_viability_rate", ratio("economically_viable_scenarios", "tested_scenarios"))
    )


def robustness_summary(grid: DataFrame) -> DataFrame:
    groups = grid.groupBy("targeting_cohort", "robustness_class").agg(
        F.count(F.lit(1)).alias("scenario_count"),
        _viable().alias("viable_scenarios"),
        F.max("roi").alias("best_roi"),
        F.min("roi").alias("worst_roi"),
    )
    return displayed(groups)


def sensitivity_summary(grid: DataFrame) -> DataFrame:
    groups = grid.groupBy("targeting_cohort").agg(
        F.first("customer_count").alias("customer_count"),
        F.first("monthly_revenue_exposure").alias("monthly_revenue_exposure"),
        F.first("annualized_revenue_exposure").alias("annualized_revenue_exposure"),
        F.count(F.lit(1)).alias("total_scenarios"),
        _viable().alias("economically_viable_scenarios"),
        F.min("break_even_success_rate").alias("minimum_break_even_success"),
        F.max("break_even_success_rate").alias("maximum_break_even_success"),
        F.max("net_value").alias("best_net_value"),
        F.min("net_value").alias("worst_net_value"),
        F.max("roi").alias("best_roi"),
        F.min("roi").alias("worst_roi"),
    )
    return displayed(
        groups.withColumn("economic_viability_rate", ratio("economically_viable_scenarios", "total_scenarios"))
    )


def cohort_gate(scores: DataFrame, expected_rows: int = EXPECTED_ROWS) -> DataFrame:
    """Checks of the customer ranking the cohorts are cut from."""
    rows = ranked_customers(scores)
    n = F.count(F.lit(1))
    checks = {
        "Customer universe": n == expected_rows,
        "Unique exposure ranking": (F.min("exposure_rank") == 1)
        & (F.max("exposure_rank") == n)
        & (F.count_distinct("exposure_rank") == n),
        "Total monthly exposure": F.sum(EXPOSURE) > 0,
        "Historical churn count": F.sum("actual_churn") > 0,
    }
    for p in TOP_PERCENTS:
        checks[f"Top {p}% cohort"] = F.count_if(inside_top(p)) == F.greatest(F.ceil(n * p / 100.0), F.lit(1))
    checks["High + Very High Risk cohort"] = F.count_if(at_risk()) > 0
    return check_rows(rows, checks)


def economics_gate(economics: DataFrame) -> DataFrame:
    """Checks of the cohort economics: 5 cohorts x 3 scenarios and their formulas."""
    n = F.count(F.lit(1))

    def every(cond: Column) -> Column:
        return F.count_if(~F.coalesce(cond, F.lit(False))) == 0

    net = F.col("expected_revenue_retained_over_horizon_inr") - F.col("total_intervention_cost_inr")
    even = F.col("break_even_retention_success_rate_pct")
    checks = {
        "Targeting cohort count": F.count_distinct("targeting_cohort") == len(TOP_PERCENTS) + 1,
        "Scenario count": F.count_distinct("scenario_id") == len(SCENARIOS),
        "Economic row count": n == (len(TOP_PERCENTS) + 1) * len(SCENARIOS),
        "Non-negative revenue exposure": every(F.col("expected_monthly_revenue_retained_inr") >= 0),
        "ROI calculation": every(
            F.abs(F.col("roi") - ratio("expected_net_value_inr", "total_intervention_cost_inr")) <= 1e-4
        ),
        "Net value calculation": every(F.abs(F.col("expected_net_value_inr") - net) <= 1e-2),
        "Break-even calculation": every(even.isNull() | (even >= 0)),
        "Break-even feasibility": every(F.col("break_even_feasible") == F.coalesce(even <= 100.0, F.lit(False))),
        "Net value per customer": every(
            F.abs(
                F.col("net_value_per_targeted_customer_inr") - ratio("expected_net_value_inr", "targeted_customers")
            )
            <= 1e-3
        ),
        "Cost-to-exposure ratio": every(
            even.isNull() | (F.abs(F.col("intervention_cost_as_pct_of_annualized_exposure") - even) <= 1e-4)
        ),
    }
    return check_rows(economics, checks)


def sensitivity_gate(grid: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    cohorts = len(TOP_PERCENTS) + 1
    checks = {
        "Expected scenario count": n == cohorts * len(SUCCESS_RATES) * len(COSTS),
        "Five targeting cohorts": F.count_distinct("targeting_cohort") == cohorts,
        "Nine success rates": F.count_distinct("retention_success_rate") == len(SUCCESS_RATES),
        "Three intervention costs": F.count_distinct("intervention_cost_per_customer") == len(COSTS),
        "Break-even non-negative": F.count_if(F.col("break_even_success_rate") < 0) == 0,
        "ROI finite": F.count_if(F.col("roi").isNull() | F.isnan("roi")) == 0,
        "Net value finite": F.count_if(F.col("net_value").isNull() | F.isnan("net_value")) == 0,
    }
    return check_rows(grid, checks)
