"""Operating points: threshold sweep, costs, capacity and risk bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import ratio, rounded
from holdfast.operators.metrics import from_counts, ranked_by_score

FIRST, LAST = 5, 85
"""The sweep runs from 0.05 to 0.85 in steps of 0.01."""
# Cost scenario -> (false positive, false negative) cost.
COST_SCENARIOS = {
    "Conservative_1_to_1": (1.0, 1.0),
    "Retention_Focused_1_to_3": (1.0, 3.0),
    "High_Missed_Churn_Cost_1_to_5": (1.0, 5.0),
}
CAPACITIES = (0.05, 0.10, 0.15, 0.20)
RISK_BANDS = ((0.2, "Very Low"), (0.4, "Low"), (0.6, "Medium"), (0.8, "High"))
TOP_BAND = "Very High"


def highest_met(first: int = FIRST, last: int = LAST) -> Column:
    """The highest sweep step k with score >= k / 100, or first - 1; exact at the edges."""
    s = F.col("score")
    k = F.floor(s * 100)
    k = k + F.when(s >= (k + 1) / 100.0, 1).otherwise(0) - F.when(s < k / 100.0, 1).otherwise(0)
    return F.greatest(F.least(k, F.lit(last)), F.lit(first - 1)).cast("int")


def threshold_sweep(df: DataFrame, first: int = FIRST, last: int = LAST) -> DataFrame:
    """Metrics at every threshold from one aggregation of the customers.

    Customers are counted by the highest threshold they meet (at most 82 rows); a running sum over
    those rows gives the confusion counts of every threshold.
    """
    counts = df.groupBy(highest_met(first, last).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("pos")
    )
    steps = df.sparkSession.range(first - 1, last + 1).select(F.col("id").cast("int").alias("step"))
    filled = steps.join(F.broadcast(counts), "step", "left").fillna(0, ["n", "pos"])
    met = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    swept = filled.select(
        "step",
        F.sum("n").over(met).alias("predicted"),
        F.sum("pos").over(met).alias("tp"),
        F.sum("n").over(whole).alias("rows"),
        F.sum("pos").over(whole).alias("churners"),
    ).filter(F.col("step") >= first)
    tp, fp = F.col("tp"), F.col("predicted") - F.col("tp")
    fn = F.col("churners") - tp
    shown = from_counts(tp, F.col("rows") - F.col("churners") - fp, fp, fn)
    return swept.select((F.col("step") / 100.0).alias("threshold"), *[c.alias(k) for k, c in shown.items()])


def cost_scenarios(df: DataFrame, scenarios: dict[str, tuple[float, float]] = COST_SCENARIOS) -> DataFrame:
    """Hypothetical misclassification cost of every threshold under every cost pair."""
    return price(threshold_sweep(df), scenarios)


def price(sweep: DataFrame, scenarios: dict[str, tuple[float, float]] = COST_SCENARIOS) -> DataFrame:
    entries = ", ".join(
        f"struct('{name}' AS scenario, {fp}D AS false_positive_cost, {fn}D AS false_negative_cost)"
        for name, (fp, fn) in scenarios.items()
    )
    return sweep.selectExpr(
        "threshold", "false_positives", "false_negatives", f"inline(array({entries}))"
    ).withColumn(
        "total_hypothetical_cost",
        F.col("false_positives") * F.col("false_positive_cost")
        + F.col("false_negatives") * F.col("false_negative_cost"),
    )


def primary_threshold(
    sweep: DataFrame, least: float = 0.05, most: float = 0.20, precision: float = 0.50
) -> DataFrame:
    """Best eligible threshold: by default 5-20 % targeted with a precision of at least one half."""
    eligible = sweep.filter(
        F.col("targeting_rate").between(least, most) & (F.col("precision") >= precision)
    )
    order = [F.desc("churn_capture"), F.desc("precision"), F.asc("targeting_rate"), F.asc("threshold")]
    return eligible.orderBy(*order).limit(1).select(
        "threshold", "targeting_rate", "precision", "churn_capture", "lift"
    )


def _selected(capacity: float) -> Column:
    return F.greatest(F.floor(F.col("rows_total") * F.lit(capacity)), F.lit(1))


def capacity_table(df: DataFrame, capacities: tuple[float, ...] = CAPACITIES) -> DataFrame:
    """What contacting the highest-scored floor(n * capacity) customers would capture."""
    churn = F.col("label") == 1
    sums = ranked_by_score(df).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(churn).alias("churners"),
        *[F.max(_selected(c)).alias(f"k{i}") for i, c in enumerate(capacities)],
        *[F.count_if(churn & (F.col("rank") <= _selected(c))).alias(f"hit{i}") for i, c in enumerate(capacities)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("capacity_rate"),
            F.col(f"k{i}").alias("targeted_customers"),
            F.col(f"hit{i}").alias("churners_captured"),
        )
        for i, c in enumerate(capacities)
    ]
    capture = F.coalesce(ratio("churners_captured", "churners"), F.lit(0.0))
    return sums.select("n", "churners", F.inline(F.array(*rows))).select(
        "capacity_rate",
        "targeted_customers",
        rounded(ratio("targeted_customers", "n"), 6).alias("targeted_rate_actual"),
        "churners_captured",
        rounded(capture, 6).alias("churn_capture"),
        rounded(ratio("churners_captured", "targeted_customers"), 6).alias("precision"),
        rounded(capture / F.col("capacity_rate"), 6).alias("lift"),
    )


def capacity_threshold(df: DataFrame, capacity: float = 0.10) -> DataFrame:
    """The lowest score among the customers a capacity covers, and what they capture."""
    inside = F.col("rank") <= _selected(capacity)
    churn = F.col("label") == 1
    sums = ranked_by_score(df).agg(
        F.max(_selected(capacity)).alias("targeted_customers"),
        F.min(F.when(inside, F.col("score"))).alias("threshold"),
        F.count_if(inside & churn).alias("hit"),
        F.count_if(churn).alias("churners"),
    )
    return sums.select(
        F.lit(capacity).alias("capacity_rate"),
        "threshold",
        "targeted_customers",
        rounded(ratio("hit", "churners"), 6).alias("churn_capture"),
        rounded(ratio("hit", "targeted_customers"), 6).alias("precision"),
    )


def confirm_on(validation: DataFrame, points: DataFrame) -> DataFrame:
    """Metrics of operating points on held-out customers; one pass over them.

    ``points`` is a small table (operating_point, threshold), usually chosen on development customers.
    """
    long = validation.select("label", "score").crossJoin(F.broadcast(points.select("operating_point", "threshold")))
    hit, churn = F.col("score") >= F.col("threshold"), F.col("label") == 1
    counts = long.groupBy("operating_point", "threshold").agg(
        F.count_if(hit & churn).alias("tp"),
        F.count_if(~hit & ~churn).alias("tn"),
        F.count_if(hit & ~churn).alias("fp"),
        F.count_if(~hit & churn).alias("fn"),
    )
    shown = from_counts(*(F.col(c) for c in ("tp", "tn", "fp", "fn")))
    kept = ("targeting_rate", "precision", "recall", "f1", "churn_capture", "lift", "predicted_churn_count")
    return counts.select("operating_point", "threshold", *[shown[k].alias(f"validation_{k}") for k in kept])


def risk_band(p: Column) -> Column:
    out = F.when(p < RISK_BANDS[0][0], RISK_BANDS[0][1])
    for edge, name in RISK_BANDS[1:]:
        out = out.when(p < edge, name)
    return out.otherwise(TOP_BAND)


def band_summary(df: DataFrame) -> DataFrame:
    """Customers, churners and mean score of the five equal-width risk bands."""
    whole = Window.partitionBy()
    bands = df.groupBy(risk_band(F.col("score")).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("label") == 1).alias("actual_churners"),
        F.avg("score").alias("p"),
    )
    return bands.select(
        "risk_band",
        "customers",
        rounded(ratio("customers", F.sum("customers").over(whole)), 6).alias("customer_share"),
        "actual_churners",
        rounded(ratio("actual_churners", "customers"), 6).alias("actual_churn_rate"),
        rounded("p", 6).alias("mean_calibrated_probability"),
        rounded(ratio("actual_churners", F.sum("actual_churners").over(whole)), 6).alias(
            "actual_churn_capture_share"
        ),
    )

