"""Loading and storing customer tables: declared schema, contract checks, reconciled writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from holdfast.operators.gate import check_rows, unknown_label
from holdfast.session import materialise
from holdfast.sources.published import NotReconciled, publish

SOURCE_LABEL = "churn_probability"
"""Name of the 0/1 outcome in raw files; called ``label`` from here on."""


class ContractViolation(ValueError):
    pass


def read_customers(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """Read a customer table with a declared schema. NaN becomes NULL, the outcome becomes ``label``."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.format(fmt).load(path)
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    df = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
    return df.withColumnRenamed(SOURCE_LABEL, "label")


RAW = "_record"


def scan_customers(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read a CSV table that may hold bad rows: (customers, set-aside rows, lost conversions by column).

    Every line is read once as text and stored. A line with too few or too many values is set aside with its text; so is one whose key or
    outcome cannot be read. Another value that is no number of its column's type becomes NULL and is counted; an empty
    value and NaN are missing, not lost. No line is dropped: customers and set-aside rows add up to the lines.
    """
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields] + [StructField(RAW, StringType())])
    reader = spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    lines = materialise(reader.csv(path))
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields if f.dataType != StringType()}
    missing = lambda c: F.col(c).isNull() | (F.lower(F.trim(F.col(c))) == "nan")
    cast = {c: F.when(~missing(c), F.col(c).try_cast(t)) for c, t in kinds.items()}
    lost = {c: ~missing(c) & cast[c].isNull() for c in kinds}
    whole = F.col(RAW).isNull()
    vital = [c for c in ("id", SOURCE_LABEL) if c in kinds]
    unread = F.lit(False)
    for c in vital:
        unread = unread | cast[c].isNull()
    reason = F.when(~whole, "number of values").when(unread, "key or outcome")
    named = lines.withColumn("_reason", reason)
    good = named.filter("_reason IS NULL").select(*[cast[c].alias(c) if c in cast else F.col(c) for c in schema.names]).withColumnRenamed(SOURCE_LABEL, "label")
    text = F.coalesce(F.col(RAW), F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in schema.names]))
    aside = named.filter("_reason IS NOT NULL").select(F.col("_reason").alias("reason"), text.alias("record"))
    entries = [F.struct(F.lit(c).alias("column"), F.count_if(whole & lost[c]).alias("lost_conversions"), F.count_if(whole & ~missing(c)).alias("values")) for c in kinds]
    counts = lines.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))
    return good, aside, counts


def check_columns(df: DataFrame, expected: list[str]) -> None:
    """Names must be unique and exactly the expected ones."""
    repeated = {c for c in df.columns if df.columns.count(c) > 1}
    if repeated or set(df.columns) != set(expected):
        raise ContractViolation(
            f"repeated {sorted(repeated)}, missing {sorted(set(expected) - set(df.columns))},"
            f" unexpected {sorted(set(df.columns) - set(expected))}"
        )


def contract_checks(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Integrity checks of a customer table as (check_name, check_pass, status)."""
    n = F.count(F.lit(1))
    checks = {
        "Rows present": n > 0,
        "Customer IDs present": F.count("id") == n,
        "Customer IDs unique": F.count_distinct("id") == n,
        "Label present": F.count("label") == n,
        "Label binary": F.count_if(unknown_label()) == 0,
        "Both classes present": (F.min("label") == 0) & (F.max("label") == 1),
    }
    if expected_rows is not None:
        checks["Expected row count"] = n == expected_rows
    return check_rows(df, checks)


def disjoint_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids that occur in both tables; empty for a labelled table and its scoring table."""
    return left.select("id").join(right.select("id"), "id", "left_semi").distinct()


def same_ids(left: DataFrame, right: DataFrame) -> bool:
    """Both tables hold the same set of ids."""
    a, b = left.select("id"), right.select("id")
    return a.join(b, "id", "left_anti").isEmpty() and b.join(a, "id", "left_anti").isEmpty()


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").alias("churners"),
        F.sum(F.pmod(F.xxhash64("id"), F.lit(1_000_003))).alias("id_hash"),
    )


def write_reconciled(
    df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Publish a new table (never over an old one) once rows, churners and ids read back as written."""
    try:
        return publish(df, path, partition_by, fmt, measure=totals)
    except NotReconciled as e:
        raise ContractViolation(str(e)) from e
