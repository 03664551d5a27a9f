"""Grouped profiles: guards before and after the share, share partitions, stacked cohorts, gates."""

import pytest

from holdfast import specs as S
from holdfast.functions.bands import CONDITIONS, LADDERS
from holdfast.operators.gate import check_rows, check_summary
from holdfast.operators.profile import report, summarise
from pyspark.sql import functions as F

LADDERS["test_size"] = S.Ladder("x", ((10, "low"), (20, "mid")), "high", missing="none")
CONDITIONS["test_small"] = lambda: F.col("x") < 10
CONDITIONS["test_any"] = lambda: F.col("x").isNotNull()


@pytest.fixture(scope="module")
def df(spark):
    xs = [5.0] * 6 + [15.0] * 3 + [25.0] + [None] * 2
    rows = [(i, int(i % 3 == 0), x, float(i)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "id bigint, label int, x double, value double")


SHOW = {"customers": S.Count(), "share": S.Share(), "rate": S.Rate(), "contribution": S.Contribution()}


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_share_counts_only_surviving_groups_when_guarded_before(df):
    got = rows(report(df, S.Profile({"b": "test_size"}, SHOW, min_customers=3)), "b")
    assert set(got) == {("low",), ("mid",)}
    assert got["low",].share == 66.67
    got = rows(report(df, S.Profile({"b": "test_size"}, SHOW, min_customers=3, guard="after_share")), "b")
    assert set(got) == {("low",), ("mid",)}
    assert got["low",].share == 50.0


def test_minimum_share_keeps_full_denominator(df):
    got = rows(report(df, S.Profile({"b": "test_size"}, SHOW, min_share=20.0)), "b")
    assert {k: r.share for k, r in got.items()} == {("low",): 50.0, ("mid",): 25.0}


def test_sums_and_churned_sums(df):
    spec = S.Profile(
        {"b": "test_size"},
        {"v": S.Total("value"), "vs": S.TotalShare("value"), "cv": S.Total("value", churned_only=True)},
    )
    got = rows(report(df, spec), "b")
    assert got["low",].v == 15.0
    assert got["low",].cv == 3.0
    assert round(sum(r.vs for r in got.values())) == 100


def test_stacked_parts_overlap_and_share_per_partition(df):
    spec = S.Stacked(
        ("dim", "grp"),
        (("size", "test_size", None), ("small", "const:x below ten", "test_small")),
        {"customers": S.Count(), "share": S.Share(by=("dim",))},
    )
    got = rows(report(df, spec), "dim", "grp")
    assert got["small", "x below ten"].customers == 6
    assert got["small", "x below ten"].share == 100.0
    assert got["size", "low"].share == 50.0


def test_population_share_uses_all_customers(df):
    spec = S.Stacked(
        ("signal",),
        (("small", None, "test_small"), ("any", None, "test_any")),
        {"customers": S.Count(), "share": S.Share(), "rate": S.Rate(), "place": S.Standing(S.Rate())},
        min_population_share=60.0,
    )
    got = rows(report(df, spec), "signal")
    assert set(got) == {("any",)}
    assert (got["any",].customers, got["any",].share, got["any",].place) == (10, 83.33, 1)


def test_gate_rows_and_summary(df):
    checks = {"rows": F.count(F.lit(1)) == 12, "ids": F.count_distinct("id") == 11}
    got = {r.check_name: r.status for r in check_rows(df, checks).collect()}
    assert got == {"rows": "PASS", "ids": "REVIEW"}
    row = check_summary(df, checks).first()
    assert tuple(row) == (2, 1, 1, "REVIEW")


def test_empty_table_gives_no_groups(df):
    assert summarise(df.filter("id < 0").withColumn("k", F.lit("a")), ["k"], SHOW).isEmpty()
