"""Panel, contract and storage."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators.scoring import MissingFeatures, batch_score
from holdfast.plans.registry import run_report
from holdfast.sources import contract
from holdfast.sources.panel import customer_panel, panel, table

SF = "/root/testdata/sf0.001"


def test_panel_keeps_every_customer_once(spark):
    p = panel(spark, SF)
    n = table(spark, SF, "customer").count()
    row = p.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).first()
    assert row.n == row.d == n


def test_customer_without_activity_stays_with_gaps(spark):
    parts = [table(spark, SF, t) for t in ("customer", "orders", "lineitem", "events")]
    lonely = parts[0].limit(1).withColumn("c_custkey", F.lit(10**9).cast("bigint"))
    row = customer_panel(lonely, *parts[1:]).first()
    assert (row.label, row.aon, row.arpu_8, row.total_rech_num_8, row.total_rech_amt_8) == (1, None, None, 0, 0.0)
    assert row.fb_user_8 is None and row.last_date_of_month_8 is None


def test_hot_customer_and_hot_order_add_up(spark):
    """All lines of one order and all orders of one customer: sums are those of a plain aggregate."""
    customer, orders, lineitem, events = (table(spark, SF, t) for t in ("customer", "orders", "lineitem", "events"))
    orders = orders.withColumn("o_custkey", F.lit(5).cast("bigint"))
    inside = F.year("o_orderdate") == 2000
    want = orders.filter(inside).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v")).first()
    row = customer_panel(customer, orders, lineitem, events).filter("id = 5").first()
    assert row.total_rech_num_8 == want.n
    assert row.total_rech_amt_8 == pytest.approx(want.v / 1000)


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {t for t in ("l_orderkey", "o_custkey", "user_id") if t in plan}


def test_reports_scan_only_what_they_use(spark):
    p = panel(spark, SF)
    assert scans(run_report("s02_03_churn_by_tenure", p)) == {"o_custkey"}
    assert scans(run_report("s02_04_churn_by_value", p)) == {"o_custkey", "l_orderkey"}
    assert scans(run_report("s06_02_social_adoption", p)) == {"o_custkey", "user_id"}


def test_signal_reports_read_the_tables_once(spark):
    p = panel(spark, SF)
    plan = run_report("s04_19_engagement_signals", p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 4


def test_csv_round_trip_and_contract(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 0, 5.5, "6/5/2014"), (2, 1, float("nan"), None), (3, 0, None, "x")],
        "id bigint, churn_probability int, arpu_8 double, day string",
    )
    rows.write.option("header", True).csv(str(tmp_path / "raw"))
    df = contract.read_customers(spark, str(tmp_path / "raw"), rows.schema)
    assert df.columns == ["id", "label", "arpu_8", "day"]
    assert df.filter("arpu_8 IS NULL").count() == 2
    assert {r.status for r in contract.contract_checks(df, 3).collect()} == {"PASS"}
    contract.check_columns(df, ["id", "label", "arpu_8", "day"])
    with pytest.raises(contract.ContractViolation):
        contract.check_columns(df, ["id", "label"])
    stored = contract.write_reconciled(df, str(tmp_path / "stored"))
    assert stored.count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        contract.write_reconciled(df, str(tmp_path / "stored"))


def test_contract_finds_duplicates_and_bad_labels(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (None, None)], "id bigint, label int")
    got = {r.check_name: r.status for r in contract.contract_checks(df).collect()}
    assert got["Customer IDs unique"] == got["Label binary"] == got["Customer IDs present"] == "REVIEW"
    assert got["Rows present"] == "PASS"


def test_id_sets(spark):
    a, b = spark.range(5), spark.range(3, 9)
    assert sorted(r.id for r in contract.disjoint_ids(a, b).collect()) == [3, 4]
    assert contract.same_ids(a, spark.range(5).repartition(3))
    assert not contract.same_ids(a, b)


def test_batch_score_checks_columns_and_imputes(spark):
    p = panel(spark, SF)
    with pytest.raises(MissingFeatures):
        batch_score(p.drop("aon"))
    fill = spark.createDataFrame([(1.0, 1.0, 50.0, 10.0, 900.0)], "total_rech_num_8 double, total_rech_num_7 double, arpu_8 double, total_og_mou_8 double, aon double")
    got = batch_score(p, medians=fill)
    assert got.count() == p.count()
    assert got.filter("calibrated_probability < 0 OR calibrated_probability > 1").isEmpty()


def test_days_and_unreadable_dates(spark):
    from datetime import date

    from holdfast.functions.measures import days_before

    df = spark.createDataFrame([("8/31/2014",), ("8/5/2014",), ("13/45/2014",), (None,)], "d string")
    got = [r[0] for r in df.select(days_before("d", date(2014, 8, 31))).collect()]
    assert got == [0, 26, None, None]
