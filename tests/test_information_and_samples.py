"""Nearest-neighbour information against a quadratic version; exact samples in any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import nearest_information as ni
from holdfast.operators import sampling


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))


def plain(values, labels, k=3):
    v, y = np.array(values, float), np.array(labels)
    keep = np.array([(y == c).sum() > 1 for c in y], bool)
    v, y = v[keep], y[keep]
    total = 0.0
    for i in range(len(v)):
        same = np.abs(np.delete(v, i) - v[i])[np.delete(y, i) == y[i]]
        used = min(k, len(same))
        d = np.sort(same)[used - 1]
        m = ((v > v[i] - d) & (v < v[i] + d)).sum() if d > 0 else (v == v[i]).sum()
        total += psi(used) - psi((y == y[i]).sum()) - psi(m)
    return max(0.0, psi(len(v)) + total / len(v)) if len(v) else 0.0


def test_digamma(spark):
    df = spark.range(1, 400).select("id", ni.digamma(F.col("id").cast("double")).alias("p"))
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-9) for r in df.collect())


def test_information_equals_the_quadratic_version(spark, monkeypatch):
    """2,000 rows with ties, one value of a third of all rows, a class of one row, and a class of three."""
    rng = np.random.default_rng(7)
    n = 2000
    label = rng.integers(0, 2, n)
    label[0], label[1:4] = 7, 5
    signal = np.round(rng.normal((label == 1) * 2.0, 1.0) * 2**24) / 2**24
    ties = rng.integers(0, 6, n).astype(float)
    hot = np.where(np.arange(n) % 3 == 0, 1.5, np.round(rng.normal(0, 4, n) * 16) / 16)
    constant = np.ones(n)
    rows = [(i, int(label[i]), *(float(c[i]) for c in (signal, ties, hot, constant))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label int, signal double, ties double, hot double, constant double")
    monkeypatch.setattr(ni, "_CHUNK", 10)
    names = ["signal", "ties", "hot", "constant"]
    want = {c: plain(v, label) for c, v in zip(names, (signal, ties, hot, constant))}
    for frame in (df, df.repartition(13)):
        got = {r.feature: r.mutual_information for r in ni.nearest_information(frame, names).collect()}
        assert got == pytest.approx(want, abs=2e-6)
    assert got["signal"] > 0.05 and got["constant"] == 0


def test_information_of_tiny_tables(spark):
    schema = "id long, label int, x double"
    assert ni.nearest_information(spark.createDataFrame([], schema), ["x"]).collect() == []
    rows = [(1, 0, 1.0), (2, 0, 2.0), (3, 1, 5.0), (4, 1, None), (5, None, 1.0), (6, 1, float("nan"))]
    got = ni.nearest_information(spark.createDataFrame(rows, schema), ["x"]).collect()
    assert [r.mutual_information for r in got] == [pytest.approx(plain([1.0, 2.0, 5.0], [0, 0, 1]), abs=2e-6)]


def test_ranges_borrow_across_several_small_partitions():
    groups, values = np.array(["a"] * 6 + ["b"] * 2, dtype=object), np.array([0, 1, 3, 3, 7, 20, 1, 4], float)
    assert ni.kth_distance(groups, values, 3, 0, 8).tolist() == [3, 2, 3, 3, 6, 17, 3, 3]


def test_samples_have_exact_size_in_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 50)
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 500 == 1, "few").when(F.col("id") % 7 == 0, None).otherwise("rest").alias("s"))
    sizes = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    one = sampling.exact_sample(df, 120, ["s"]).collect()
    assert {s: sum(r.s == s for r in one) for s in sizes} == {s: min(120, n) for s, n in sizes.items()}
    assert sorted(r.id for r in one) == sorted(r.id for r in sampling.exact_sample(df.repartition(11), 120, ["s"]).collect())
    share = sampling.exact_sample(df, 0.13, ["s"]).collect()
    assert {s: sum(r.s == s for r in share) for s in sizes} == {s: int(np.ceil(n * 0.13 - 1e-9)) for s, n in sizes.items()}
    assert len(sampling.exact_sample(df, 777).collect()) == 777
    assert {r.id for r in sampling.exact_sample(df, 300).collect()} <= {r.id for r in sampling.exact_sample(df, 777).collect()}
    assert {r.id for r in sampling.exact_sample(df, 300, seed=1).collect()} != {r.id for r in sampling.exact_sample(df, 300).collect()}
    assert sampling.exact_sample(df, 9000).count() == 5000
    assert sampling.exact_sample(df.limit(0), 10, ["s"]).collect() == []


def test_samples_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (None,), (2,)], "id long")
    assert [len(sampling.exact_sample(df, k).collect()) for k in (1, 2, 4, 6, 7)] == [1, 2, 4, 6, 6]
