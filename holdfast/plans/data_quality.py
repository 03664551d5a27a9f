"""Data validation of the customer table: integrity, label, validity and date checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import PERIODS
from holdfast import specs as S
from holdfast.functions.periods import some
from holdfast.operators.gate import check_rows, check_summary, status, unknown_label
from holdfast.plans.common import churn_rate, churners, customers, mean
from holdfast.sources.panel import FIXTURE_CALENDAR

# Treatment notes.
NEGATIVE_NOTE = "INVESTIGATE — source values retained; no automatic deletion"
CONFLICT_NOTE = "INVESTIGATE — semantic/source behavior; not treated as automatic failure"


def _cols(*measures: str) -> list[Column]:
    return [F.col(f"{m}_{p}") for m in measures for p in PERIODS]


def _negative(*measures: str) -> Column:
    return some(_cols(*measures), lambda c: c < 0)


def _missing(*names: str) -> list[Column]:
    return [F.count_if(F.col(n).isNull()) for n in names]


def _none(*counts: Column) -> Column:
    out = counts[0] == 0
    for c in counts[1:]:
        out = out & (c == 0)
    return out


RECHARGE = ("total_rech_amt", "total_rech_num", "max_rech_amt")
VOICE = ("total_og_mou", "total_ic_mou")
DATA = ("vol_2g_mb", "vol_3g_mb")


def context_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        customers().alias("row_count"),
        F.count("id").alias("non_null_customer_ids"),
        F.count("label").alias("non_null_targets"),
    )


def id_integrity(df: DataFrame) -> DataFrame:
    n, present, distinct = customers(), F.count("id"), F.count_distinct("id")
    return df.agg(
        n.alias("row_count"),
        present.alias("non_null_id_count"),
        distinct.alias("distinct_id_count"),
        (n - present).alias("null_id_count"),
        (n - distinct).alias("duplicate_id_rows"),
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("id")
        .agg(customers().alias("occurrence_count"))
        .filter("occurrence_count > 1")
        .orderBy(F.desc("occurrence_count"), "id")
    )


def label_validation(df: DataFrame) -> DataFrame:
    absent, invalid = F.count_if(F.col("label").isNull()), F.count_if(~F.col("label").isin(0, 1))
    return df.agg(
        customers().alias("total_rows"),
        absent.alias("null_target_count"),
        invalid.alias("invalid_target_count"),
        F.count_if(F.col("label") == 0).alias("retained_count"),
        churners().alias("churned_count"),
        churn_rate().alias("churn_rate_percent"),
        status(_none(absent, invalid)).alias("validation_status"),
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Distinct values per checked column: both columns go through one long (name, value) pass."""
    names = ("circle_id", "last_date_of_month_6")
    entries = [F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in names]
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("column_name")
        .agg(customers().alias("row_count"), F.count_distinct("value").alias("distinct_value_count"))
    )


def critical_nulls(df: DataFrame) -> DataFrame:
    names = {
        "missing_customer_id": "id",
        "missing_target": "label",
        "missing_arpu_8": "arpu_8",
        "missing_recharge_amount_8": "total_rech_amt_8",
        "missing_outgoing_usage_8": "total_og_mou_8",
        "missing_incoming_usage_8": "total_ic_mou_8",
    }
    counts = _missing(*names.values())
    return df.agg(
        *[c.alias(k) for k, c in zip(names, counts)], status(_none(*counts)).alias("validation_status")
    )


def missingness_profile(df: DataFrame) -> DataFrame:
    names = {
        "arpu_8_missing": "arpu_8",
        "recharge_amt_8_missing": "total_rech_amt_8",
        "outgoing_mou_8_missing": "total_og_mou_8",
        "incoming_mou_8_missing": "total_ic_mou_8",
        "last_rech_8_missing": "date_of_last_rech_8",
        "last_data_rech_8_missing": "date_of_last_rech_data_8",
        "total_data_rech_8_missing": "total_rech_data_8",
    }
    return df.agg(*[c.alias(k) for k, c in zip(names, _missing(*names.values()))])


def tenure_validity(df: DataFrame) -> DataFrame:
    absent, invalid = F.count_if(F.col("aon").isNull()), F.count_if(F.col("aon") <= 0)
    return df.agg(
        F.min("aon").cast("bigint").alias("minimum_aon"),
        F.max("aon").cast("bigint").alias("maximum_aon"),
        mean("aon").alias("average_aon"),
        absent.alias("null_aon_count"),
        invalid.alias("invalid_aon_count"),
        status(_none(absent, invalid)).alias("validation_status"),
    )


def recharge_validity(df: DataFrame) -> DataFrame:
    names = ("negative_recharge_amount_rows", "negative_recharge_count_rows", "negative_max_recharge_rows")
    counts = [F.count_if(_negative(m)) for m in RECHARGE]
    return df.agg(
        *[c.alias(k) for k, c in zip(names, counts)], status(_none(*counts)).alias("validation_status")
    )


def usage_validity(df: DataFrame) -> DataFrame:
    voice, data = F.count_if(_negative(*VOICE)), F.count_if(_negative(*DATA))
    return df.agg(
        voice.alias("negative_voice_usage_rows"),
        data.alias("negative_data_usage_rows"),
        status(_none(voice, data)).alias("validation_status"),
    )


def negative_value_profile(df: DataFrame) -> DataFrame:
    out = [F.count_if(F.col(f"arpu_{p}") < 0).alias(f"negative_arpu_{p}_count") for p in PERIODS]
    out += [F.min(f"arpu_{p}").alias(f"minimum_arpu_{p}") for p in PERIODS]
    out += [F.max(f"arpu_{p}").alias(f"maximum_arpu_{p}") for p in PERIODS]
    return df.agg(*out, F.first(F.lit(NEGATIVE_NOTE)).alias("treatment_status"))


def count_amount_conflict(df: DataFrame) -> DataFrame:
    out = [
        F.count_if((F.col(f"total_rech_num_{p}") > 0) & (F.col(f"total_rech_amt_{p}") == 0)).alias(f"month_{p}_count")
        for p in PERIODS
    ]
    return df.agg(*out, F.first(F.lit(CONFLICT_NOTE)).alias("treatment_status"))


def _wrong_month_end(p: int) -> Column:
    return F.col(f"last_date_of_month_{p}") != f"{FIXTURE_CALENDAR.orders[p][1]:%-m/%-d/%Y}"


def month_end_dates(df: DataFrame) -> DataFrame:
    wrong = [F.count_if(_wrong_month_end(p)) for p in PERIODS]
    absent = _missing(*[f"last_date_of_month_{p}" for p in PERIODS])
    return df.agg(
        *[c.alias(f"invalid_month_{p}_dates") for p, c in zip(PERIODS, wrong)],
        *[c.alias(f"missing_month_{p}_dates") for p, c in zip(PERIODS, absent)],
        status(_none(*wrong)).alias("validation_status"),
    )


def _availability(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(
        *[F.count(f"{column}_{p}").alias(f"available_{name}_{p}") for p in PERIODS],
        *[F.count_if(F.col(f"{column}_{p}").isNull()).alias(f"missing_{name}_{p}") for p in PERIODS],
    )


def recharge_date_availability(df: DataFrame) -> DataFrame:
    return _availability(df, "date_of_last_rech", "recharge_date")


def data_recharge_date_availability(df: DataFrame) -> DataFrame:
    return _availability(df, "date_of_last_rech_data", "data_recharge_date")


def date_month_consistency(df: DataFrame) -> DataFrame:
    counts = []
    for p in PERIODS:
        first, last = FIXTURE_CALENDAR.orders[p]
        day = F.try_to_date(F.col(f"date_of_last_rech_{p}"), "M/d/yyyy")
        counts.append(F.count_if(~day.between(F.lit(first), F.lit(last))))
    return df.agg(
        *[c.alias(f"invalid_recharge_month_{p}") for p, c in zip(PERIODS, counts)],
        status(_none(*counts)).alias("validation_status"),
    )


def gate_checks(expected_rows: int = S.EXPECTED_ROWS) -> dict[str, Column]:
    n = customers()
    return {
        "Row count": n == expected_rows,
        "Customer ID integrity": (n == F.count("id")) & (n == F.count_distinct("id")),
        "Target integrity": F.count_if(unknown_label()) == 0,
        "AON validity": F.count_if(F.col("aon").isNull() | (F.col("aon") <= 0)) == 0,
        "Recharge validity": F.count_if(_negative(*RECHARGE)) == 0,
        "Usage validity": F.count_if(_negative(*VOICE, *DATA)) == 0,
        "Month-end dates": F.count_if(
            _wrong_month_end(6) | _wrong_month_end(7) | _wrong_month_end(8)
        )
        == 0,
    }


REPORTS = {
    "s01_0_context_counts": context_counts,
    "s01_1_id_integrity": id_integrity,
    "s01_2_duplicate_ids": duplicate_ids,
    "s01_3_label_validation": label_validation,
    "s01_4_label_distribution": S.Profile(
        {"target": "label_text"}, {"customer_count": S.Count(), "percentage_of_dataset": S.Share()}
    ),
    "s01_5_constant_columns": constant_columns,
    "s01_6_critical_nulls": critical_nulls,
    "s01_7_missingness_profile": missingness_profile,
    "s01_8_tenure_validity": tenure_validity,
    "s01_9_recharge_validity": recharge_validity,
    "s01_10_usage_validity": usage_validity,
    "s01_11_negative_value_profile": negative_value_profile,
    "s01_12_count_amount_conflict": count_amount_conflict,
    "s01_13_month_end_dates": month_end_dates,
    "s01_14_recharge_date_availability": recharge_date_availability,
    "s01_15_data_recharge_date_availability": data_recharge_date_availability,
    "s01_16_date_month_consistency": date_month_consistency,
    "s01_18a_quality_gate_checks": lambda df: check_rows(df, gate_checks()),
    "s01_18b_quality_gate_summary": lambda df: check_summary(df, gate_checks()),
}
