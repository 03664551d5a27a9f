"""Categories, summaries by period, and files with bad rows, against plain counts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from holdfast.operators import categories, summaries
from holdfast.sources import contract


def test_new_vanished_and_rare_categories(spark):
    rng = np.random.default_rng(1)
    rows = [("old", str(rng.choice(["a", "b", "gone"], p=[0.6, 0.3, 0.1])), int(rng.integers(2)), f"id{i}") for i in range(1000)]
    rows += [("now", str(rng.choice(["a", "b", "fresh"], p=[0.3, 0.6, 0.1])), None, f"id{i + 500}") for i in range(800)]
    rows += [("now", None, 1, "x")] * 3 + [("else", "c", 5, "y")] * 50
    df = spark.createDataFrame(rows, "pop string, word string, flag int, key string")
    counts = categories.category_counts(df, ["word", "flag", "key"], "pop", "old", "now", 5)
    got = {(r.feature, r.category): r for r in categories.category_drift(counts).collect()}
    old, now = (Counter(r[1] for r in rows if r[0] == p) for p in ("old", "now"))
    for c in ("a", "b", "gone", "fresh"):
        r = got["word", c]
        assert (r.reference_count, r.current_count) == (old[c], now[c])
        assert r.share_change == pytest.approx(now[c] * 100 / 803 - old[c] * 100 / 1000, abs=1e-4)
    assert got["word", "gone"].status == "Vanished" and got["word", "fresh"].status == "New" and got["word", "a"].status == "Present"
    assert got["word", categories.OTHER].current_count == 3 and got["flag", categories.MISSING].current_count == 800
    assert {c for f, c in got if f == "key"} == {categories.OTHER} and got["key", categories.OTHER].reference_count == 1000
    one = {r.feature: r for r in categories.category_summary(counts).collect()}["word"]
    assert (one.categories, one.new_categories, one.vanished_categories) == (5, 2, 1)


@pytest.mark.parametrize("slots", [2, 64])
def test_few_slots_lose_no_frequent_value(spark, slots):
    """Values that share slots with others are still told apart and counted exactly."""
    rows = [("p", f"v{i % 40}" if i % 4 else "hot") for i in range(4000)]
    df = spark.createDataFrame(rows, "pop string, x string")
    sizes = df.groupBy("pop").agg(F.count(F.lit(1)).alias("_rows"))
    found = categories.frequent(categories.long_categories(df, ["x"], ["pop"]), "pop", sizes, 2, slots).collect()
    n = Counter(x for _, x in rows)
    assert {r.category for r in found} == {x for x in n if n[x] * 100 >= 4000 * 2}


def values():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.lognormal(3, 2, 4000), -rng.lognormal(1, 1, 1500), np.zeros(700), [1e-9, -1e-9, 1e12, -1e12]])


def test_summaries_add_up_and_keep_ranks(spark):
    """The rank of each estimated quantile is within the rows of one bucket of the exact one; values are within one percent."""
    v = values()
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, x double")
    parts = [summaries.summary(df.filter(f"id % 3 = {k}"), {"x": "x"}, k) for k in range(3)]
    stored = parts[0].union(parts[1]).union(parts[2])
    whole = summaries.summary(df.repartition(5), {"x": "x"}, 0)
    merge = lambda s: {r.bucket: r.n for r in summaries.merged(s, 0, 2).collect()}
    assert merge(stored) == merge(whole)
    errors = []
    for share in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99):
        got = summaries.quantile(summaries.merged(stored, 0, 2), share).first().value
        exact = np.quantile(v, share, method="inverted_cdf")
        assert got == pytest.approx(exact, rel=0.0101, abs=1e-6)
        errors.append(abs((v <= got).mean() - share) if (v == got).mean() < 0.01 else 0)
    assert max(errors) < 0.006


def test_ranges_of_periods_are_compared(spark):
    v = values()
    rows = [(int(i), float(x), float(x) * 1.0 if i % 2 else None, float(x) * 3 + 5) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, x6 double, x7 double, x8 double")
    stored = summaries.summary(df, {"x": "x6"}, 6).union(summaries.summary(df, {"x": "x7"}, 7)).union(summaries.summary(df, {"x": "x8"}, 8))
    same = summaries.compared(stored, (6, 6), (7, 7)).first()
    moved = summaries.compared(stored, (6, 7), (8, 8)).first()
    assert same.psi < 0.01 < 0.5 < moved.psi
    assert same.current_missing_pct == pytest.approx(50, abs=0.1) and same.reference_rows == len(v)
    assert moved.current_median == pytest.approx(np.median(v * 3 + 5), rel=0.02)
    deciles = np.quantile(v, np.arange(1, 10) / 10)
    a, b = (np.histogram(np.searchsorted(deciles, x), np.arange(11))[0] / len(v) for x in (v, v * 3 + 5))
    a, b = np.maximum(a, 1e-6), np.maximum(b, 1e-6)
    exact = ((b - a) * np.log(b / a)).sum()
    assert summaries.compared(stored, (6, 6), (8, 8)).first().psi == pytest.approx(exact, rel=0.15)


def test_buckets_are_in_the_order_of_the_numbers(spark):
    v = np.unique(values())
    got = [r.b for r in spark.createDataFrame([(float(x),) for x in v], "x double").select("x", summaries.bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got) and 0 in got


def test_bad_lines_are_set_aside_and_counted(spark, tmp_path):
    text = """id,churn_probability,aon,arpu_8,day
1,0,10,1.5,6/5/2014
2,1,n/a,2.5,
3,0,30
4,yes,40,4.5,x
5,1,,NaN,"a,b"
,1,7,1.0,z
6,0,6.5,1e3,y,extra
7,1,99999999999,oops,"
"
8,0,8,-3,end
"""
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.csv").write_text(text)
    schema = StructType().add("id", LongType()).add("churn_probability", IntegerType()).add("aon", IntegerType()).add("arpu_8", DoubleType()).add("day", StringType())
    good, aside, lost = contract.scan_customers(spark, str(tmp_path / "raw"), schema)
    rows = {r.id: r for r in good.collect()}
    assert good.columns == ["id", "label", "aon", "arpu_8", "day"]
    assert rows[1] == (1, 0, 10, 1.5, "6/5/2014") and rows[2] == (2, 1, None, 2.5, None)
    assert rows[5] == (5, 1, None, None, "a,b") and rows[8] == (8, 0, 8, -3.0, "end")
    reasons = Counter(r.reason for r in aside.collect())
    assert good.count() + aside.count() == 10 and reasons["number of values"] >= 2 and reasons["key or outcome"] >= 2
    counts = {r.column: r.lost_conversions for r in lost.collect()}
    assert counts["churn_probability"] == 1 and counts["aon"] >= 2
    assert any("30" in r.record for r in aside.collect())


def test_an_empty_file_has_no_customers(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,churn_probability\n")
    schema = StructType().add("id", LongType()).add("churn_probability", IntegerType())
    good, aside, lost = contract.scan_customers(spark, str(tmp_path), schema)
    assert good.count() == aside.count() == 0 and {r.lost_conversions for r in lost.collect()} == {0}
