"""Tables that appear whole or not at all, and stages that are computed once for a content.

A table is written into a folder of its own version, read back and compared, and only then named by a small marker file that
readers follow. A write that fails or does not reconcile leaves no marker: readers see nothing (or the earlier version) and a
retry starts a new version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from holdfast.operators.modelling import fingerprint
from holdfast.session import ensure_checkpoint_dir, free_shuffles, is_stored, materialise

MARKER = "_current"


class NotReconciled(ValueError):
    """The stored table is not what was to be written."""


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def published_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version that readers of ``path`` follow; null before the first one is complete."""
    files, marker = _file(spark, f"{path}/{MARKER}")
    if not files.exists(marker):
        return None
    stream = files.open(marker)
    try:
        return bytes(stream.readAllBytes()).decode() or None
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str, replace: bool) -> None:
    files, marker = _file(spark, f"{path}/{MARKER}")
    stream = files.create(marker, replace)
    stream.write(bytearray(version.encode()))
    stream.close()


def _load(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def read_published(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """The version that the marker names."""
    version = published_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return _load(spark, f"{path}/{version}", fmt, schema)


def publish(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
    replace: bool = False,
    measure: Callable[[DataFrame], DataFrame] = fingerprint,
) -> DataFrame:
    """Write, read back, compare ``measure`` of both, then publish; returns the published table.

    Without ``replace`` a path that has a published version is refused. ``measure`` gives one row; by default the number of rows
    and an order-free hash of the content of all columns.
    """
    spark = df.sparkSession
    if not replace and published_version(spark, path) is not None:
        raise FileExistsError(f"{path} exists: a version is published there")
    stored = df if is_stored(df) else materialise(df)
    version = f"v-{uuid4().hex}"
    writer = stored.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{path}/{version}")
    back = _load(spark, f"{path}/{version}", fmt, stored.schema)
    if measure(stored).first() != measure(back.select(*stored.columns)).first():
        raise NotReconciled(f"{path}/{version} does not hold what was written")
    _point(spark, path, version, replace)
    return back


def stored_copy(df: DataFrame) -> DataFrame:
    """The rows of a DataFrame, worked out and stored once: all stages of a query read and speak of the same content."""
    if is_stored(df):
        return df
    if not hasattr(df, "_holdfast_copy"):
        # the plan of df itself would hold its shuffle files for as long as df is known
        df._holdfast_copy = materialise(df.select("*"))
        free_shuffles(df.sparkSession)
    return df._holdfast_copy


def _content(df: DataFrame) -> tuple:
    """The fingerprint of a table, read once for each DataFrame."""
    copy = stored_copy(df)
    if not hasattr(copy, "_holdfast_content"):
        copy._holdfast_content = tuple(fingerprint(copy).first())
    return copy._holdfast_content


def content_key(df: DataFrame, name: str, settings: object) -> str:
    """Changes with any value of the table, its schema, the name of the stage or its settings."""
    return hashlib.sha256(repr((name, settings, _content(df))).encode()).hexdigest()[:32]


def stages_folder(spark: SparkSession) -> str:
    """``spark.holdfast.stages.dir``, to share stages between applications; else a folder of this one's checkpoints."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.holdfast.stages.dir", "") or f"{spark.sparkContext.getCheckpointDir()}/stages"


def stored_stage(df: DataFrame, name: str, settings: object, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(df)``, computed once for a content and settings and read from then on.

    Of two applications that build the same stage at once, the first to publish wins; both return its table.
    """
    spark = df.sparkSession
    path = f"{stages_folder(spark)}/{name}-{content_key(df, name, settings)}"
    if published_version(spark, path) is None:
        made = build(stored_copy(df))
        try:
            publish(made, path)
        except Exception:
            if published_version(spark, path) is None:
                raise
        del made
        free_shuffles(spark)
    return read_published(spark, path)
