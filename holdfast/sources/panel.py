"""Customer panel: one row per customer with three period snapshots.

Orders and their lines stand for recharges and voice minutes, events for data service. Every part
is aggregated to one row per key before it is joined, so one order or one customer that owns a
large part of the data costs a partial aggregate and not a hot join key.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdfast import PERIODS


@dataclass(frozen=True)
class Calendar:
    """First and last day of each period in orders and in events, and the outcome window."""

    orders: dict[int, tuple[date, date]]
    events: dict[int, tuple[date, date]]
    outcome: tuple[date, date]

    @property
    def prediction_point(self) -> date:
        return self.orders[PERIODS[-1]][1]


FIXTURE_CALENDAR = Calendar(
    orders={
        6: (date(1998, 1, 1), date(1998, 12, 31)),
        7: (date(1999, 1, 1), date(1999, 12, 31)),
        8: (date(2000, 1, 1), date(2000, 12, 31)),
    },
    events={
        6: (date(2024, 1, 1), date(2024, 1, 10)),
        7: (date(2024, 1, 11), date(2024, 1, 20)),
        8: (date(2024, 1, 21), date(2024, 1, 30)),
    },
    outcome=(date(2001, 1, 1), date(2001, 12, 31)),
)

LINE_SHARES: dict[str, tuple[str, tuple[int, ...]]] = {
    "loc_og_t2t_mou": ("O", (1,)),
    "loc_og_t2m_mou": ("O", (2,)),
    "std_og_t2t_mou": ("O", (3,)),
    "std_og_t2m_mou": ("O", (4,)),
    "loc_og_mou": ("O", (1, 2)),
    "std_og_mou": ("O", (3, 4)),
    "isd_og_mou": ("O", (5,)),
    "roam_og_mou": ("O", (6, 7)),
    "loc_ic_mou": ("F", (1, 2)),
    "std_ic_mou": ("F", (3, 4)),
    "isd_ic_mou": ("F", (5,)),
    "roam_ic_mou": ("F", (6, 7)),
}
"""Voice sub-family -> line status and line numbers it adds up."""


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; its footers are read for the schema once per process, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _within(day: str, span: tuple[date, date]) -> str:
    return f"{day} BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'"


def _cents(column: str) -> str:
    """Exact integer cents: long sums are exact, fast and independent of partial-sum order."""
    return f"cast(round({column} * 100) AS bigint)"


def _aggregate(df: DataFrame, key: str, aggs: dict[str, str]) -> DataFrame:
    """Group by a key with aggregates given as SQL text; one parse per column keeps plan building quick."""
    return df.groupBy(key).agg(*[F.expr(sql).alias(name) for name, sql in aggs.items()])


def _order_lines(lineitem: DataFrame) -> DataFrame:
    """One row per order: signed revenue and quantities by line class."""
    cents = _cents("l_extendedprice")
    classes = {
        "total_og_mou": "l_linestatus = 'O'",
        "total_ic_mou": "l_linestatus = 'F'",
        "onnet_mou": "l_returnflag = 'A'",
        "offnet_mou": "l_returnflag = 'N'",
    }
    for name, (line_status, numbers) in LINE_SHARES.items():
        classes[name] = f"l_linestatus = '{line_status}' AND l_linenumber IN ({', '.join(map(str, numbers))})"
    aggs = {"arpu": f"sum(if(l_returnflag = 'R', -{cents}, {cents}))"}
    aggs |= {name: f"sum(if({hit}, l_quantity, 0D))" for name, hit in classes.items()}
    return _aggregate(lineitem, "l_orderkey", aggs)


LINE_MEASURES = ("arpu", "total_og_mou", "total_ic_mou", "onnet_mou", "offnet_mou", *LINE_SHARES)


def _order_part(orders: DataFrame, lineitem: DataFrame, cal: Calendar) -> DataFrame:
    # orders after the outcome window say nothing about any column
    known = orders.filter(f"o_orderdate < date_add(DATE '{cal.outcome[1]}', 1)")
    joined = known.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "to_date(o_orderdate) AS day").join(
        _order_lines(lineitem), F.expr("o_orderkey = l_orderkey"), "left"
    )
    aggs = {
        "in_outcome": f"max(if({_within('day', cal.outcome)}, 1, 0))",
        "first_day": f"min(if(day <= DATE '{cal.prediction_point}', day, NULL))",
    }
    for p in PERIODS:
        hit = _within("day", cal.orders[p])
        aggs |= {
            f"num_{p}": f"count_if({hit})",
            f"amt_{p}": f"sum(if({hit}, {_cents('o_totalprice')}, NULL))",
            f"max_{p}": f"max(if({hit}, o_totalprice, NULL))",
            f"last_{p}": f"max(if({hit}, day, NULL))",
        }
        aggs |= {f"{m}_{p}": f"sum(if({hit}, {m}, NULL))" for m in LINE_MEASURES}
    return _aggregate(joined, "o_custkey", aggs)


def _event_part(events: DataFrame, cal: Calendar) -> DataFrame:
    # compared as timestamps, so that the bounds reach the parquet reader
    first, last = cal.events[PERIODS[0]][0], cal.events[PERIODS[-1]][1]
    inside = events.filter(f"ts >= DATE '{first}' AND ts < date_add(DATE '{last}', 1)")
    typed = inside.selectExpr(
        "user_id", "event_type", "to_date(ts) AS day", "hour(ts) AS hour", "value", f"{_cents('value')} AS cents"
    )
    bought = "event_type = 'purchase' AND value >= 100"
    aggs = {"has_events": "max(1)"}
    for p in PERIODS:
        hit = _within("day", cal.events[p])
        shift = (cal.orders[p][1] - cal.events[p][1]).days
        aggs |= {
            f"total_rech_data_{p}": f"count_if({hit} AND {bought})",
            f"monthly_2g_{p}": f"count_if({hit} AND event_type = 'click' AND value >= 150)",
            f"sachet_2g_{p}": f"count_if({hit} AND event_type = 'click' AND value >= 100 AND value < 150)",
            f"monthly_3g_{p}": f"count_if({hit} AND event_type = 'view' AND value >= 150)",
            f"sachet_3g_{p}": f"count_if({hit} AND event_type = 'view' AND value >= 100 AND value < 150)",
            f"signups_{p}": f"count_if({hit} AND event_type = 'signup')",
            f"nights_{p}": f"count_if({hit} AND hour < 6)",
            f"vol_2g_{p}": f"sum(if({hit} AND event_type = 'click', cents, 0))",
            f"vol_3g_{p}": f"sum(if({hit} AND event_type = 'view', cents, 0))",
            f"bought_{p}": f"sum(if({hit} AND {bought}, cents, NULL))",
            f"max_rech_data_{p}": f"max(if({hit} AND {bought}, value, NULL))",
            f"data_day_{p}": f"date_add(max(if({hit} AND {bought}, day, NULL)), {shift})",
        }
    return _aggregate(typed, "user_id", aggs)


def customer_panel(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    events: DataFrame,
    cal: Calendar = FIXTURE_CALENDAR,
) -> DataFrame:
    """Left-join the aggregated parts to the customers; absence stays NULL, counts become 0."""
    wide = (
        customer.selectExpr("c_custkey AS id")
        .join(_order_part(orders, lineitem, cal), F.expr("id = o_custkey"), "left")
        .join(_event_part(events, cal), F.expr("id = user_id"), "left")
    )
    out = [
        "id",
        "if(coalesce(in_outcome, 0) = 1, 0, 1) AS label",
        f"datediff(DATE '{cal.prediction_point}', first_day) AS aon",
        "109 AS circle_id",
    ]
    for p in PERIODS:
        out += [
            f"if(num_{p} > 0, '{cal.orders[p][1]:%-m/%-d/%Y}', NULL) AS last_date_of_month_{p}",
            f"date_format(last_{p}, 'M/d/yyyy') AS date_of_last_rech_{p}",
            f"coalesce(num_{p}, 0) AS total_rech_num_{p}",
            f"coalesce(amt_{p}, 0) / 100000D AS total_rech_amt_{p}",
            f"coalesce(max_{p}, 0D) / 1000D AS max_rech_amt_{p}",
            f"arpu_{p} / 100000D AS arpu_{p}",
            *[f"{m}_{p}" for m in LINE_MEASURES if m != "arpu"],
            f"vol_2g_{p} / 100D AS vol_2g_mb_{p}",
            f"vol_3g_{p} / 100D AS vol_3g_mb_{p}",
            f"date_format(data_day_{p}, 'M/d/yyyy') AS date_of_last_rech_data_{p}",
            f"max_rech_data_{p}",
            f"try_divide(bought_{p} / 100D, total_rech_data_{p}) AS av_rech_amt_data_{p}",
            f"if(has_events IS NOT NULL, cast(signups_{p} >= 5 AS int), NULL) AS fb_user_{p}",
            f"if(has_events IS NOT NULL, cast(nights_{p} >= 6 AS int), NULL) AS night_pck_user_{p}",
            *[f"{m}_{p}" for m in ("total_rech_data", "monthly_2g", "sachet_2g", "monthly_3g", "sachet_3g")],
        ]
    return wide.selectExpr(*out)


def panel(spark: SparkSession, sf_dir: str, cal: Calendar = FIXTURE_CALENDAR) -> DataFrame:
    """The panel over the fixture tables. Catalyst drops the columns and the joins a query does not use."""
    return customer_panel(*(table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "events")), cal)
