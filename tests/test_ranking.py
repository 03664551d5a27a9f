"""Distributed ranks and running sums against brute force, with ties and one hot value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from holdfast.operators.quantiles import exact_quantiles, medians_wide
from holdfast.operators.ranking import (
    average_rank_percent,
    global_rank,
    grouped_prefix_sums,
    grouped_rank,
    percent_rank,
    prefix_sums,
    tile,
)

ROWS = 5000


@pytest.fixture(scope="module", autouse=True)
def several_partitions(spark):
    """Keep small ranges apart, so that every test crosses partition borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranges_span_partitions(table):
    df, _ = table
    from holdfast.operators.ranking import _placed

    assert _placed(df, [F.col("id").asc()]).select("_part").distinct().count() >= 4


@pytest.fixture(scope="module")
def table(spark):
    """A third of all rows share the value 0, some values are missing."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(ROWS), "v": np.round(rng.normal(size=ROWS), 2), "g": rng.integers(0, 3, ROWS)})
    pdf.loc[pdf.id % 3 == 0, "v"] = 0.0
    pdf.loc[pdf.id % 50 == 1, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return df.repartition(7, "id").cache(), pdf


def test_global_rank_equals_window(table):
    df, _ = table
    order = [F.col("v").desc(), F.col("id").asc()]
    got = global_rank(df, order)
    w = Window.orderBy(*order)
    want = df.select("id", F.row_number().over(w).alias("r"), F.percent_rank().over(w).alias("p"), F.ntile(7).over(w).alias("t"))
    both = got.withColumns({"pr": percent_rank(), "ti": tile(7)}).join(want, "id")
    assert both.count() == ROWS
    assert both.filter("rank <> r OR rows_total <> 5000 OR abs(pr - p) > 1e-12 OR ti <> t").isEmpty()


@pytest.mark.parametrize("n", [1, 3, 10, 11])
def test_tile_on_small_tables(spark, n):
    df = spark.range(n).select("id")
    got = global_rank(df, [F.col("id").asc()]).select("id", tile(4).alias("t"), percent_rank().alias("p"))
    w = Window.orderBy("id")
    want = df.select("id", F.ntile(4).over(w).alias("t"), F.percent_rank().over(w).alias("p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_prefix_sums(table):
    df, pdf = table
    rows = df.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: (r.upto, r.whole) for r in prefix_sums(rows, [F.col("v").asc()], {"upto": "n"}, {"whole": "n"}).collect()}
    counts = pdf.v.dropna().value_counts().sort_index()
    want = counts.cumsum()
    assert got == {k: (int(want[k]), int(counts.sum())) for k in counts.index}


def test_grouped_prefix_sums_and_rank(table):
    df, pdf = table
    clean = pdf.dropna()
    rows = df.filter("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r.g, r.v): (r.cum_n, r.all_n) for r in grouped_prefix_sums(rows, ["g"], [F.col("v").desc()], ["n"]).collect()}
    counts = clean.groupby(["g", "v"]).size().reset_index(name="n").sort_values(["g", "v"], ascending=[True, False])
    counts["cum"] = counts.groupby("g").n.cumsum()
    counts["all"] = counts.groupby("g").n.transform("sum")
    assert got == {(r.g, r.v): (r.cum, r.all) for r in counts.itertuples()}

    ranked = grouped_rank(df.select("g", "id"), ["g"], [F.col("id").asc()], "r", "size")
    w = Window.partitionBy("g").orderBy("id")
    want = df.select("id", F.row_number().over(w).alias("want"))
    assert ranked.join(want, "id").filter("r <> want").isEmpty()


def test_average_rank_matches_pandas(table):
    df, pdf = table
    got = average_rank_percent(df, "v", "p").select("id", "p").toPandas().set_index("id").p.sort_index()
    want = pdf.set_index("id").v.rank(method="average", pct=True) * 100
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)


def test_exact_quantiles_match_numpy(table):
    df, pdf = table
    got = {r.g: r for r in exact_quantiles(df, ["v"], {"a": 0.1, "m": 0.5, "z": 0.93}, ["g"]).collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert np.allclose([got[g].a, got[g].m, got[g].z], np.quantile(part.v, [0.1, 0.5, 0.93]))
    wide = medians_wide(df, ["v", "id"]).first()
    assert wide.v == pytest.approx(pdf.v.median())
    assert wide.id == pytest.approx(pdf.id.median())
