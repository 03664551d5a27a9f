"""Grouped customer profiles: one partial aggregate over the panel, then windows over its few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import specs as S
from holdfast.functions.bands import band, condition
from holdfast.functions.numeric import percent, ratio, rounded
from holdfast.operators.ranking import with_value_rank


def _total_name(m: S.Total | S.TotalShare) -> str:
    return f"sum_{m.measure}_{'churned' if m.churned_only else 'all'}"


def _measures(metric: object) -> list[Column]:
    """Partial aggregates a metric needs, beside the two counts every profile has."""
    if isinstance(metric, S.Mean):
        return [F.avg(metric.measure).alias(f"mean_{metric.measure}")]
    if isinstance(metric, (S.Total, S.TotalShare)):
        value = F.col(metric.measure)
        if metric.churned_only:
            value = F.when(F.col("label") == 1, value)
        return [F.coalesce(F.sum(value), F.lit(0.0)).alias(_total_name(metric))]
    if isinstance(metric, S.Lowest):
        return [F.min(metric.measure).alias(f"min_{metric.measure}")]
    if isinstance(metric, S.Highest):
        return [F.max(metric.measure).alias(f"max_{metric.measure}")]
    if isinstance(metric, S.Standing):
        return _measures(metric.of)
    return []


def _order_value(metric: object) -> Column:
    if isinstance(metric, S.Rate):
        return ratio("churned", "n")
    if isinstance(metric, S.Total):
        return F.col(_total_name(metric))
    raise TypeError(metric)


def _shown(metric: object) -> Column:
    match metric:
        case S.Count():
            return F.col("n")
        case S.Churners():
            return F.col("churned")
        case S.Retained():
            return F.col("n") - F.col("churned")
        case S.Rate():
            return percent("churned", "n")
        case S.Share(by=by):
            return percent("n", F.sum("n").over(Window.partitionBy(*by)))
        case S.Contribution(by=by):
            return percent("churned", F.sum("churned").over(Window.partitionBy(*by)))
        case S.Mean(measure=m, digits=d):
            return rounded(f"mean_{m}", d)
        case S.Total():
            return rounded(_total_name(metric))
        case S.TotalShare():
            return percent(_total_name(metric), F.sum(_total_name(metric)).over(Window.partitionBy()))
        case S.Lowest(measure=m):
            return rounded(f"min_{m}")
        case S.Highest(measure=m):
            return rounded(f"max_{m}")
        case S.SizeFlag(small=small, standard=standard, below=below):
            return F.when(F.col("n") < below, small).otherwise(standard)
        case S.Standing(of=of, unique=unique, tie=tie):
            order = [_order_value(of).desc()] + ([F.col(tie).asc()] if tie else [])
            return (F.row_number() if unique else F.rank()).over(Window.orderBy(*order)).cast("bigint")
    raise TypeError(metric)


def summarise(
    rows: DataFrame,
    keys: list[str],
    show: dict[str, object],
    min_customers: int = 0,
    guard: str = "before_share",
    min_share: float | None = None,
) -> DataFrame:
    """Aggregate ``rows`` by ``keys`` and lay out the metrics.

    Windows below run on the grouped rows, which number as many as there are labels.
    """
    needed: dict[str, Column] = {}
    for metric in show.values():
        for agg in _measures(metric):
            needed.setdefault(str(agg._jc.toString()), agg)
    churned = F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0)).cast("bigint")
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), churned.alias("churned"), *needed.values())
    if min_customers and guard == "before_share":
        grouped = grouped.filter(F.col("n") >= min_customers)
    out = grouped.select(*keys, "n", *[_shown(m).alias(name) for name, m in show.items()])
    if min_customers and guard == "after_share":
        out = out.filter(F.col("n") >= min_customers)
    if min_share is not None:
        share = next(name for name, m in show.items() if isinstance(m, S.Share))
        out = out.filter(F.col(share) >= min_share)
    return out.select(*keys, *show)


def _ranked_rows(df: DataFrame, spec: S.Profile) -> DataFrame:
    measures = {m.measure for m in spec.show.values() if hasattr(m, "measure")} - {"value", "label"}
    kept = df.select(
        "id", "label", "value", *sorted(measures), *[band(b).alias(name) for name, b in spec.before_rank.items()]
    )
    return with_value_rank(kept)


def profile(df: DataFrame, spec: S.Profile) -> DataFrame:
    rows = _ranked_rows(df, spec) if spec.ranked else df
    if spec.where is not None:
        rows = rows.filter(condition(spec.where))
    rows = rows.withColumns({name: band(b) for name, b in spec.keys.items()})
    return summarise(rows, list(spec.keys), spec.show, spec.min_customers, spec.guard, spec.min_share)


EVERY = "*"
"""Key of the cohort that holds all customers."""


def stack(df: DataFrame, spec: S.Stacked, population: bool = False) -> DataFrame:
    """One row per customer and part, from one pass over the customers; ``population`` adds all customers as a part."""
    entries = [F.struct(*[F.lit(EVERY).alias(k) for k in spec.keys])] if population else []
    for first, band_name, cond in spec.parts:
        fields = [F.lit(first).alias(spec.keys[0])]
        if len(spec.keys) > 1:
            fields.append((band(band_name) if band_name else F.lit(None).cast("string")).alias(spec.keys[1]))
        entry = F.struct(*fields)
        entries.append(entry if cond is None else F.when(condition(cond), entry))
    tagged = df.withColumn("_entry", F.explode(F.array_compact(F.array(*entries))))
    return tagged.withColumns({k: F.col(f"_entry.{k}") for k in spec.keys})


def stacked(df: DataFrame, spec: S.Stacked) -> DataFrame:
    if spec.min_population_share is not None:
        return _against_population(df, spec)
    return summarise(stack(df, spec), list(spec.keys), spec.show, spec.min_customers, spec.guard, spec.min_share)


def _against_population(df: DataFrame, spec: S.Stacked) -> DataFrame:
    """Shares of all customers instead of the shown groups: the population is one more stacked cohort."""
    both = stack(df, spec, population=True)
    churned = F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0)).cast("bigint")
    grouped = both.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"), churned.alias("churned"))
    total = F.max(F.when(F.col(spec.keys[0]) == EVERY, F.col("n"))).over(Window.partitionBy())
    kept = grouped.withColumn("population", total).filter(
        (F.col(spec.keys[0]) != EVERY) & (F.col("n") >= F.col("population") * (spec.min_population_share / 100.0))
    )
    shown = [
        (percent("n", "population") if isinstance(m, S.Share) else _shown(m)).alias(name)
        for name, m in spec.show.items()
    ]
    return kept.select(*spec.keys, *shown)


def report(df: DataFrame, spec: S.Profile | S.Stacked) -> DataFrame:
    return profile(df, spec) if isinstance(spec, S.Profile) else stacked(df, spec)
