"""Economics recomputed from published cohort sums, and risk and value invariants on the fixtures."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import exposure, retention, risk, thresholds
from holdfast.operators.scoring import Sigmoid, scored
from holdfast.sources.panel import panel

SF = "/root/testdata/sf0.001"
# Published sums of the five cohorts (customers, monthly exposure) of 69,999 customers.
COHORTS = {
    "Top 1% Exposure": (700, 248554.80980116734),
    "Top 5% Exposure": (3500, 495515.23578830226),
    "Top 10% Exposure": (7000, 602398.1126942876),
    "High + Very High Risk": (12492, 551432.5632143607),
}
# Published net value of the three scenarios for some cohorts.
NET = {
    ("Top 1% Exposure", "low_touch"): 526531.5435228017,
    ("Top 1% Exposure", "targeted"): 868930.2011649028,
    ("Top 1% Exposure", "high_touch"): 1141328.858807004,
}


@pytest.fixture(scope="module")
def sums(spark):
    rows = [(k, n, n, e, 0, 0.5, n, 69999, 776208.2418823112, 7132) for k, (n, e) in COHORTS.items()]
    return spark.createDataFrame(
        rows,
        "targeting_cohort string, customers bigint, positive bigint, exposure double, churned bigint, p double,"
        " risky bigint, universe bigint, all_exposure double, all_churned bigint",
    )


def test_published_economics(sums):
    got = {(r.targeting_cohort, r.scenario_id): r for r in retention.price_cohorts(sums).collect()}
    for key, net in NET.items():
        assert got[key].expected_net_value_inr == pytest.approx(net, abs=1e-3)
    row = got["Top 1% Exposure", "low_touch"]
    assert row.roi_pct == pytest.approx(752.1879193182881, abs=1e-5)
    assert row.break_even_retention_success_rate_pct == pytest.approx(2.3469002020116756, abs=1e-5)
    assert row.monthly_exposure_capture_pct == pytest.approx(32.02166588677543, abs=1e-5)
    assert row.economically_viable


def test_published_sensitivity(sums):
    grid = retention.grid_rows(sums).cache()
    summary = {r.targeting_cohort: r for r in retention.sensitivity_summary(grid).collect()}
    top, risky = summary["Top 1% Exposure"], summary["High + Very High Risk"]
    assert (top.total_scenarios, top.economically_viable_scenarios) == (27, 26)
    assert (risky.total_scenarios, risky.economically_viable_scenarios) == (27, 12)
    assert risky.maximum_break_even_success == pytest.approx(0.9439050841791942, abs=1e-5)
    assert top.best_roi == pytest.approx(33.087516772731526, abs=1e-5)
    even = {
        (r.targeting_cohort, r.intervention_cost_per_customer): r for r in retention.break_even_summary(grid).collect()
    }
    assert even["High + Very High Risk", 250.0].break_even_success_rate == pytest.approx(0.4719525420895971, abs=1e-5)
    assert even["High + Very High Risk", 250.0].economically_viable_scenarios == 4
    robust = {
        (r.targeting_cohort, r.robustness_class): r.scenario_count for r in retention.robustness_summary(grid).collect()
    }
    assert robust["High + Very High Risk", "Conditionally viable"] == 18
    assert robust["High + Very High Risk", "Not viable within tested range"] == 9
    for r in retention.monotonicity(grid).collect():
        assert r.net_value_rises_with_success and r.roi_rises_with_success and r.net_value_falls_with_cost


def test_published_threshold_costs(spark):
    sweep = spark.createDataFrame(
        [(0.05, 8052, 408), (0.06, 7146, 471)], "threshold double, false_positives bigint, false_negatives bigint"
    )
    got = {(r.scenario, r.threshold): r.total_hypothetical_cost for r in thresholds.price(sweep).collect()}
    assert got["Conservative_1_to_1", 0.05] == 8460.0
    assert got["Conservative_1_to_1", 0.06] == 7617.0
    assert got["High_Missed_Churn_Cost_1_to_5", 0.05] == 8052 + 5 * 408


def test_exclusive_cohort_sizes(spark):
    df = spark.range(69_999).select((F.col("id") + 1).alias("exposure_rank"), F.lit(69_999).alias("universe"))
    counts = {
        r.c: r["count"] for r in df.groupBy(retention.assigned_cohort().alias("c")).count().collect()
    }
    assert counts == {
        "Top 1% Exposure": 700,
        "Top 5% Exposure": 2800,
        "Top 10% Exposure": 3500,
        "Top 20% Exposure": 7000,
        "Outside Locked Cohorts": 55999,
    }


def test_risk_and_value_tables_pass_their_gates(spark):
    scores = scored(panel(spark, SF)).cache()
    n = scores.count()
    table = risk.risk_table(scores)
    assert {r.status for r in risk.risk_gate(table, expected_rows=n).collect()} == {"PASS"}
    status = {r.check_name: r.status for r in exposure.value_gate(exposure.value_table(scores), n).collect()}
    failed = {k for k, v in status.items() if v != "PASS"}
    assert failed <= {"August ARPU complete"}
    one = exposure.customer_lookup(table, 3).collect()
    assert len(one) == 1
    checked = exposure.record_checks(scores).first()
    assert checked.records == n
    assert checked.monthly_formula_violations == checked.annual_formula_violations == 0


def test_gate_finds_broken_order(spark):
    scores = scored(panel(spark, SF))
    table = risk.risk_table(scores)
    swapped = table.withColumn(
        "risk_rank",
        F.when(F.col("risk_rank") == 1, 150).when(F.col("risk_rank") == 150, 1).otherwise(F.col("risk_rank")),
    )
    status = {r.check_name: r.status for r in risk.risk_gate(swapped, expected_rows=150).collect()}
    assert status["Risk ranking"] == "REVIEW"
    assert status["Risk rank integrity"] == "PASS"


def test_sigmoid_keeps_order_and_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in (0.0, 1e-9, 0.2, 0.5, 0.9, 1.0)], "p double")
    got = [r[0] for r in df.select(Sigmoid(1.0, 0.0).apply(F.col("p"))).collect()]
    assert got == sorted(got)
    assert got[2:5] == pytest.approx([0.2, 0.5, 0.9])
    assert 0 < got[0] < 1e-6 and 1 - 1e-6 < got[-1] < 1


def test_schema_checks_can_fail(spark):
    scores = scored(panel(spark, SF))
    table = risk.risk_table(scores)
    for other in (table.withColumn("risk_rank", F.col("risk_rank").cast("int")), table.withColumn("more", F.lit(1))):
        status = {r.check_name: r.status for r in risk.risk_gate(other, expected_rows=150).collect()}
        assert status["Output schema"] != "PASS" and status["Risk ranking"] == "PASS"


def test_operating_points_come_from_a_table(spark):
    validation = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.2), (0, 0.1)], "label int, score double")
    points = spark.createDataFrame([("a", 0.5), ("b", 0.15)], "operating_point string, threshold double")
    got = {r.operating_point: r for r in thresholds.confirm_on(validation, points).collect()}
    assert (got["a"].validation_precision, got["a"].validation_recall) == (0.5, 0.5)
    assert (got["b"].validation_recall, got["b"].validation_predicted_churn_count) == (1.0, 3)
