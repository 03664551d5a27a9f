"""Columns counted by value, one task each, against the ways over ranges and long tables, and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import columns as c
from holdfast.operators import modelling, quantiles, selection
from holdfast.operators import nearest_information as ni

NAMES = ["signal", "ties", "hot", "constant", "zeros"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 1500
    label = rng.integers(0, 2, n)
    table = []
    for i in range(n):
        signal = float(np.round(rng.normal(label[i], 1.0) * 256) / 256)
        table.append((i, int(label[i]), 1 + i % 5, signal, float(rng.integers(6)), 1.5 if i % 3 == 0 else float(rng.integers(-90, 90)) / 8, 1.0, -0.0 if i % 2 else 0.0))
    names = ", ".join(f"{name} double" for name in NAMES)
    df = spark.createDataFrame(table, f"id long, label int, fold int, {names}").repartition(7).cache()
    yield df
    df.unpersist()


def shown(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(c, "_CHUNK", 64)
    monkeypatch.setattr(c, "_CELLS", 500)
    monkeypatch.setattr(ni, "_CHUNK", 9)


def both(monkeypatch, one):
    """Rows by whole columns, then by the way for columns that are too long; the first makes no long table."""
    found = []
    with monkeypatch.context() as m:
        for module, name in ((selection, "grouped_prefix_sums"), (quantiles, "grouped_prefix_sums"), (ni, "prefix_sums"), (selection, "_average_ranks")):
            m.setattr(module, name, lambda *a, **k: found.append(1))
        short = shown(one())
    assert not found
    with monkeypatch.context() as m:
        m.setattr(c, "COLUMN_ROWS", 10)
        return short, shown(one())


def test_stability_by_columns_equals_the_long_table(rows, monkeypatch, small_chunks):
    some = rows.withColumn("ties", F.expr("if(id % 7 = 0, NULL, ties)"))
    left, right = both(monkeypatch, lambda: selection.univariate_stability(some, NAMES))
    assert left == right and len(left) == len(NAMES)


def test_information_by_columns_equals_the_ranges(rows, monkeypatch, small_chunks):
    some = rows.withColumn("ties", F.expr("if(id % 7 = 0, NULL, if(id % 11 = 0, double('NaN'), ties))")).withColumn("label", F.expr("if(id = 5, 9, if(id < 3, 4, if(id = 8, NULL, label)))"))
    left, right = both(monkeypatch, lambda: ni.nearest_information(some, NAMES))
    assert left == right and len(left) == len(NAMES)


def test_ranks_by_columns_equal_the_long_table(rows, monkeypatch, small_chunks):
    left, right = both(monkeypatch, lambda: selection.spearman_pairs(rows, NAMES))
    assert [r[:2] for r in left] == [r[:2] for r in right] and len(left) == 3
    assert [r[2] for r in left] == pytest.approx([r[2] for r in right], abs=1.1e-6)


def test_rows_of_one_id_count_once(rows, monkeypatch, small_chunks):
    """Ranks are those among all rows; an id has the highest of its ranks."""
    twice = rows.union(rows.filter("id < 400")).union(rows.filter("id < 30").withColumn("signal", F.col("signal") + 1))
    left, right = both(monkeypatch, lambda: selection.spearman_pairs(twice, NAMES))
    assert [r[:2] for r in left] == [r[:2] for r in right]
    assert [r[2] for r in left] == pytest.approx([r[2] for r in right], abs=1.1e-6)


def test_medians_by_columns(rows, small_chunks):
    some = rows.withColumn("ties", F.expr("if(id % 7 = 0, NULL, ties)")).withColumn("gone", F.lit(None).cast("double"))
    names = [*NAMES, "gone"]
    assert quantiles.medians_wide(some, names, in_tasks=True).first() == quantiles.medians_wide(some, names).first()
    none = some.filter("id < 0")
    assert quantiles.medians_wide(none, names, in_tasks=True).collect() == quantiles.medians_wide(none, names).collect() == []


def test_a_missing_value_has_no_rank(rows, spark):
    with pytest.raises(Exception, match="ties has missing values"):
        selection.spearman_pairs(rows.withColumn("ties", F.expr("if(id = 7, NULL, ties)")), NAMES).collect()


def test_medians_of_the_matrix_make_no_long_table(rows, monkeypatch):
    monkeypatch.setattr(quantiles, "grouped_prefix_sums", None)
    split = rows.withColumn("split", F.expr("if(id < 1000, 'development', 'validation')"))
    assert modelling.development_medians(split, ("signal", "ties")).count() == 1
