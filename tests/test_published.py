"""Staged publication and stages that are computed once."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from holdfast.sources import contract, published


def test_nothing_is_seen_of_a_write_that_fails_midway(spark, tmp_path, monkeypatch):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("label"))
    path = str(tmp_path / "table")
    real = DataFrameWriter.save

    def half(self, where, *args, **kwargs):
        real(df.limit(40).write, where)
        raise OSError("disk full")

    monkeypatch.setattr(DataFrameWriter, "save", half)
    with pytest.raises(OSError, match="disk full"):
        published.publish(df, path)
    monkeypatch.setattr(DataFrameWriter, "save", real)
    assert published.published_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path)
    assert published.publish(df, path).count() == 100
    assert published.read_published(spark, path).count() == 100


def test_what_does_not_reconcile_is_not_published(spark, tmp_path, monkeypatch):
    df = spark.range(10).select("id", F.lit(1).alias("label"), F.lit("x").alias("note"))
    path = str(tmp_path / "table")
    real = published._load
    monkeypatch.setattr(published, "_load", lambda *a: real(*a).withColumn("note", F.when(F.col("id") == 3, "y").otherwise(F.col("note"))))
    with pytest.raises(published.NotReconciled):
        published.publish(df, path)
    monkeypatch.setattr(published, "_load", lambda *a: real(*a).filter("id > 0"))
    with pytest.raises(contract.ContractViolation):
        contract.write_reconciled(df, path)
    monkeypatch.setattr(published, "_load", real)
    assert published.published_version(spark, path) is None
    contract.write_reconciled(df, path)


def test_readers_follow_the_marker(spark, tmp_path):
    path = str(tmp_path / "table")
    published.publish(spark.range(3).withColumn("part", F.lit("a")), path, partition_by=["part"])
    with pytest.raises(FileExistsError):
        published.publish(spark.range(5), path)
    first = published.published_version(spark, path)
    published.publish(spark.range(5).withColumn("part", F.lit("b")), path, partition_by=["part"], replace=True)
    assert published.published_version(spark, path) != first
    assert published.read_published(spark, path).count() == 5


def test_csv_is_published_too(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "id long, label int, c string")
    back = contract.write_reconciled(df, str(tmp_path / "t"), fmt="csv")
    assert sorted(tuple(r) for r in back.collect()) == [(1, 0, "a"), (2, 1, "b")]


def test_a_stage_runs_once_for_a_content_and_settings(spark):
    df = spark.range(20).withColumn("v", F.col("id") * 3)
    runs = []

    def build(rows):
        runs.append(1)
        return rows.agg(F.sum("v").alias("s"))

    first = published.stored_stage(df, "sums", {"a": 1}, build)
    again = published.stored_stage(df.repartition(3), "sums", {"a": 1}, build)
    assert len(runs) == 1 and first.collect() == again.collect()
    published.stored_stage(df, "sums", {"a": 2}, build)
    published.stored_stage(df, "other", {"a": 1}, build)
    published.stored_stage(df.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))), "sums", {"a": 1}, build)
    published.stored_stage(df.withColumn("v", F.col("v").cast("int")), "sums", {"a": 1}, build)
    assert len(runs) == 5


def test_a_query_reads_its_table_once_for_all_stages(spark, tmp_path, monkeypatch):
    seen, real = [], published.fingerprint
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    monkeypatch.setattr(published, "fingerprint", lambda one: seen.append(one) or real(one))
    keys = {published.content_key(df, name, settings) for name in ("a", "b") for settings in (1, 2)}
    assert len(keys) == 4 and len(seen) == 1
    assert published.content_key(df.repartition(2), "a", 1) in keys
    assert published.content_key(df.filter("id > 0"), "a", 1) not in keys


def test_a_table_is_worked_out_once_for_all_stages(spark, tmp_path, monkeypatch):
    """Two stages of one DataFrame, and the publication of a stored one, store its rows one time."""
    made, real = [], published.materialise
    monkeypatch.setattr(published, "materialise", lambda df: made.append(df) or real(df))
    spark.conf.set("spark.holdfast.stages.dir", str(tmp_path))
    try:
        df = spark.range(50).withColumn("v", F.col("id") % 7)
        seen = []
        for name in ("a", "b"):
            out = published.stored_stage(df, name, (), lambda p: seen.append(p) or real(p.groupBy("v").count()))
            assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in df.groupBy("v").count().collect())
        assert len(made) == 1 and seen[0] is seen[1]
    finally:
        spark.conf.unset("spark.holdfast.stages.dir")
