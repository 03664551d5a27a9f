"""DuckDB text of the customer panel, written apart from the Spark code."""

from __future__ import annotations

LINE_CLASSES = {
    "loc_og_t2t_mou": "l_linestatus = 'O' AND l_linenumber = 1",
    "loc_og_t2m_mou": "l_linestatus = 'O' AND l_linenumber = 2",
    "std_og_t2t_mou": "l_linestatus = 'O' AND l_linenumber = 3",
    "std_og_t2m_mou": "l_linestatus = 'O' AND l_linenumber = 4",
    "loc_og_mou": "l_linestatus = 'O' AND l_linenumber <= 2",
    "std_og_mou": "l_linestatus = 'O' AND l_linenumber BETWEEN 3 AND 4",
    "isd_og_mou": "l_linestatus = 'O' AND l_linenumber = 5",
    "roam_og_mou": "l_linestatus = 'O' AND l_linenumber >= 6",
    "loc_ic_mou": "l_linestatus = 'F' AND l_linenumber <= 2",
    "std_ic_mou": "l_linestatus = 'F' AND l_linenumber BETWEEN 3 AND 4",
    "isd_ic_mou": "l_linestatus = 'F' AND l_linenumber = 5",
    "roam_ic_mou": "l_linestatus = 'F' AND l_linenumber >= 6",
    "total_og_mou": "l_linestatus = 'O'",
    "total_ic_mou": "l_linestatus = 'F'",
    "onnet_mou": "l_returnflag = 'A'",
    "offnet_mou": "l_returnflag = 'N'",
}
YEARS = {6: 1998, 7: 1999, 8: 2000}
DAYS = {6: (1, 10), 7: (11, 20), 8: (21, 30)}


def panel_ctes() -> str:
    """CTEs ``p_lines``, ``p_orders``, ``p_events`` and ``p``, without the leading WITH."""
    orders, events, out = [], [], []
    for s, year in YEARS.items():
        inside = f"year(o_orderdate) = {year}"
        orders += [
            f"count(*) FILTER ({inside}) AS num_{s}",
            f"sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER ({inside}) AS amt_{s}",
            f"max(o_totalprice) FILTER ({inside}) AS max_{s}",
            f"max(CAST(o_orderdate AS DATE)) FILTER ({inside}) AS last_{s}",
            f"sum(sum_arpu) FILTER ({inside}) AS cents_{s}",
        ]
        orders += [f"sum(sum_{m}) FILTER ({inside}) AS {m}_{s}" for m in LINE_CLASSES]
        lo, hi = DAYS[s]
        inside = f"year(ts) = 2024 AND month(ts) = 1 AND day(ts) BETWEEN {lo} AND {hi}"
        bought = f"{inside} AND event_type = 'purchase' AND value >= 100"
        events += [
            f"count(*) FILTER ({bought}) AS total_rech_data_{s}",
            f"sum(CAST(round(value * 100) AS BIGINT)) FILTER ({bought}) AS bought_{s}",
            f"max(value) FILTER ({bought}) AS max_rech_data_{s}",
            f"max(CAST(ts AS DATE)) FILTER ({bought}) AS data_day_{s}",
            f"coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER ({inside} AND event_type = 'click'), 0) AS v2_{s}",
            f"coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER ({inside} AND event_type = 'view'), 0) AS v3_{s}",
            f"count(*) FILTER ({inside} AND event_type = 'click' AND value >= 150) AS monthly_2g_{s}",
            f"count(*) FILTER ({inside} AND event_type = 'click' AND value >= 100 AND value < 150) AS sachet_2g_{s}",
            f"count(*) FILTER ({inside} AND event_type = 'view' AND value >= 150) AS monthly_3g_{s}",
            f"count(*) FILTER ({inside} AND event_type = 'view' AND value >= 100 AND value < 150) AS sachet_3g_{s}",
            f"CAST(count(*) FILTER ({inside} AND event_type = 'signup') >= 5 AS INTEGER) AS fb_user_{s}",
            f"CAST(count(*) FILTER ({inside} AND hour(ts) < 6) >= 6 AS INTEGER) AS night_pck_user_{s}",
        ]
        out += [
            f"CASE WHEN num_{s} > 0 THEN '12/31/{year}' END AS last_date_of_month_{s}",
            f"strftime(last_{s}, '%-m/%-d/%Y') AS date_of_last_rech_{s}",
            f"coalesce(num_{s}, 0) AS total_rech_num_{s}",
            f"CAST(coalesce(amt_{s}, 0) AS DOUBLE) / 100000 AS total_rech_amt_{s}",
            f"coalesce(max_{s}, 0) / 1000 AS max_rech_amt_{s}",
            f"CAST(cents_{s} AS DOUBLE) / 100000 AS arpu_{s}",
            *[f"{m}_{s}" for m in LINE_CLASSES],
            f"CAST(v2_{s} AS DOUBLE) / 100 AS vol_2g_mb_{s}",
            f"CAST(v3_{s} AS DOUBLE) / 100 AS vol_3g_mb_{s}",
            f"strftime(data_day_{s} + CAST(DATE '{year}-12-31' - DATE '2024-01-{hi}' AS INTEGER), '%-m/%-d/%Y') AS date_of_last_rech_data_{s}",
            f"max_rech_data_{s}",
            f"CAST(bought_{s} AS DOUBLE) / 100 / nullif(total_rech_data_{s}, 0) AS av_rech_amt_data_{s}",
            *[
                f"{m}_{s}"
                for m in (
                    "fb_user", "night_pck_user", "total_rech_data", "monthly_2g", "sachet_2g", "monthly_3g", "sachet_3g"
                )
            ],
        ]
    lines = [f"coalesce(sum(l_quantity) FILTER ({c}), 0) AS sum_{m}" for m, c in LINE_CLASSES.items()]
    glue = ",\n    "
    return f"""p_lines AS (
  SELECT l_orderkey,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)) AS sum_arpu,
    {glue.join(lines)}
  FROM lineitem GROUP BY l_orderkey),
p_orders AS (
  SELECT o_custkey,
    max(CASE WHEN year(o_orderdate) = 2001 THEN 1 ELSE 0 END) AS in_outcome,
    min(CAST(o_orderdate AS DATE)) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS first_day,
    {glue.join(orders)}
  FROM orders LEFT JOIN p_lines ON l_orderkey = o_orderkey GROUP BY o_custkey),
p_events AS (
  SELECT user_id,
    {glue.join(events)}
  FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY user_id),
p AS (
  SELECT c_custkey AS id,
    CASE WHEN coalesce(in_outcome, 0) = 1 THEN 0 ELSE 1 END AS label,
    DATE '2000-12-31' - first_day AS aon,
    109 AS circle_id,
    {glue.join(out)}
  FROM customer LEFT JOIN p_orders ON o_custkey = c_custkey LEFT JOIN p_events ON user_id = c_custkey)"""
