"""DuckDB text for the declarative report specs."""

from __future__ import annotations

from holdfast import specs as S
from oracle.bands_sql import CONDITIONS, band_sql, text
from oracle.panel_sql import panel_ctes


def r(x: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"floor(CAST({x} AS DOUBLE) * {scale} + 0.500001e0) / {scale}e0"


def pct(a: str, b: str, digits: int = 2) -> str:
    return r(f"(CAST({a} AS DOUBLE) * 100e0 / nullif(CAST({b} AS DOUBLE), 0))", digits)


def measures_cte() -> str:
    cols = []
    for p in (6, 7, 8):
        cols.append(
            f"CASE WHEN coalesce(total_og_mou_{p}, total_ic_mou_{p}) IS NOT NULL"
            f" THEN coalesce(total_og_mou_{p}, 0) + coalesce(total_ic_mou_{p}, 0) END AS voice_{p}"
        )
        cols.append(
            f"CASE WHEN coalesce(vol_2g_mb_{p}, vol_3g_mb_{p}) IS NOT NULL"
            f" THEN coalesce(vol_2g_mb_{p}, 0) + coalesce(vol_3g_mb_{p}, 0) END AS data_{p}"
        )
    cols += [
        "coalesce(vol_2g_mb_8, 0) + coalesce(vol_3g_mb_8, 0) AS data_or_zero_8",
        "coalesce(total_og_mou_8, 0) + coalesce(total_ic_mou_8, 0) + coalesce(total_rech_amt_8, 0) AS activity_8",
        "greatest(arpu_8, 0) AS value",
        "arpu_8 - arpu_7 AS arpu_change",
        "total_rech_amt_8 - total_rech_amt_7 AS recharge_change",
        "arpu_8 - arpu_6 AS arpu_change_6_8",
        "total_rech_amt_8 - total_rech_amt_6 AS recharge_change_6_8",
        "(arpu_8 - arpu_6) * 100e0 / nullif(arpu_6, 0) AS arpu_change_6_8_pct",
        "(total_rech_amt_8 - total_rech_amt_6) * 100e0 / nullif(total_rech_amt_6, 0) AS recharge_change_6_8_pct",
        "(arpu_8 - arpu_7) * 100e0 / nullif(abs(arpu_7), 0) AS arpu_change_pct",
        "(total_rech_amt_8 - total_rech_amt_7) * 100e0 / nullif(abs(total_rech_amt_7), 0) AS recharge_change_pct",
        "DATE '2000-12-31' - CAST(strptime(date_of_last_rech_8, '%m/%d/%Y') AS DATE) AS days_since_recharge_8",
    ]
    changes = [
        f"CASE WHEN {m}_7 > 0 THEN ({m}_8 - {m}_7) * 100e0 / {m}_7 END AS {m}_change_pct" for m in ("voice", "data")
    ]
    glue = ",\n    "
    return f"""q AS (SELECT *,
    {glue.join(cols)}
  FROM p),
m AS (SELECT *,
    {glue.join(changes)}
  FROM q)"""


RANKED_CTE = """k AS (SELECT *, percent_rank() OVER (ORDER BY value, id) AS value_percentile,
    ntile(4) OVER (ORDER BY value, id) AS value_quarter FROM m)"""


def with_panel(body: str, *ctes: str) -> str:
    """A full statement: panel and measure CTEs, more CTEs, then the body."""
    return "WITH " + ",\n".join([panel_ctes(), measures_cte(), *ctes]) + "\n" + body


def _agg(metric: object) -> dict[str, str]:
    if isinstance(metric, S.Mean):
        return {f"mean_{metric.measure}": f"avg({metric.measure})"}
    if isinstance(metric, S.Total | S.TotalShare):
        if metric.churned_only:
            return {f"churned_{metric.measure}": f"coalesce(sum({metric.measure}) FILTER (label = 1), 0)"}
        return {f"total_{metric.measure}": f"coalesce(sum({metric.measure}), 0)"}
    if isinstance(metric, S.Standing):
        return _agg(metric.of)
    return {}


def _over(by: tuple[str, ...]) -> str:
    return f"OVER (PARTITION BY {', '.join(by)})" if by else "OVER ()"


def _shown(metric: object) -> str:
    match metric:
        case S.Count():
            return "n"
        case S.Churners():
            return "churned"
        case S.Rate():
            return pct("churned", "n")
        case S.Share(by=by):
            return pct("n", f"sum(n) {_over(by)}")
        case S.Contribution(by=by):
            return pct("churned", f"sum(churned) {_over(by)}")
        case S.Mean(digits=d):
            return r(next(iter(_agg(metric))), d)
        case S.Total():
            return r(next(iter(_agg(metric))))
        case S.TotalShare():
            name = next(iter(_agg(metric)))
            return pct(name, f"sum({name}) OVER ()")
        case S.SizeFlag(small=small, standard=standard, below=below):
            return f"CASE WHEN n < {below} THEN {text(small)} ELSE {text(standard)} END"
        case S.Standing(of=S.Rate()):
            return "CAST(rank() OVER (ORDER BY CAST(churned AS DOUBLE) / n DESC) AS BIGINT)"
        case S.Standing(of=of, tie=tie):
            name = next(iter(_agg(of)))
            return f"CAST(row_number() OVER (ORDER BY {name} DESC, {tie}) AS BIGINT)"
    raise TypeError(metric)


def _grouped(source: str, keys: list[str], spec: S.Profile | S.Stacked) -> list[str]:
    aggs: dict[str, str] = {}
    for metric in spec.show.values():
        aggs |= _agg(metric)
    extra = "".join(f", {sql} AS {name}" for name, sql in aggs.items())
    names = ", ".join(keys)
    having = f" HAVING count(*) >= {spec.min_customers}" if spec.min_customers and spec.guard == "before_share" else ""
    ctes = [
        f"g AS (SELECT {names}, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (label = 1) AS BIGINT) AS churned"
        f"{extra} FROM {source} GROUP BY {names}{having})"
    ]
    shown = ", ".join(f"{_shown(metric)} AS {name}" for name, metric in spec.show.items())
    ctes.append(f"s AS (SELECT {names}, n, {shown} FROM g)")
    return ctes


def _final(keys: list[str], spec: S.Profile | S.Stacked) -> str:
    tests = []
    if spec.min_customers and spec.guard == "after_share":
        tests.append(f"n >= {spec.min_customers}")
    if spec.min_share is not None:
        share = next(name for name, metric in spec.show.items() if isinstance(metric, S.Share))
        tests.append(f"{share} >= {spec.min_share}")
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return f"SELECT {', '.join([*keys, *spec.show])} FROM s{where}"


def profile_sql(spec: S.Profile) -> str:
    ctes, source = [], "m"
    if spec.ranked:
        pre = "".join(f", {band_sql(b)} AS {name}" for name, b in spec.before_rank.items())
        ctes += [RANKED_CTE, f"kk AS (SELECT *{pre} FROM k)"]
        source = "kk"
    where = f" WHERE {CONDITIONS[spec.where]}" if spec.where else ""
    fresh = {name: b for name, b in spec.keys.items() if b != f"col:{name}"}
    bands = "".join(f", {band_sql(b)} AS {name}_" for name, b in fresh.items())
    kept = [f"{name}_ AS {name}" if name in fresh else name for name in spec.keys]
    aggs: dict[str, str] = {}
    needed = {metric.measure for metric in spec.show.values() if hasattr(metric, "measure")}
    needed |= {m.of.measure for m in spec.show.values() if isinstance(m, S.Standing) and hasattr(m.of, "measure")}
    columns = ", ".join([*kept, "label", *sorted(needed)])
    ctes += [f"b AS (SELECT *{bands} FROM {source}{where})", f"bb AS (SELECT {columns} FROM b)"]
    ctes += _grouped("bb", list(spec.keys), spec)
    return with_panel(_final(list(spec.keys), spec), *ctes)


def stacked_sql(spec: S.Stacked) -> str:
    parts = []
    for first, band_name, cond in spec.parts:
        cols = [f"{text(first)} AS {spec.keys[0]}"]
        if len(spec.keys) > 1:
            cols.append(f"{band_sql(band_name)} AS {spec.keys[1]}")
        where = f" WHERE {CONDITIONS[cond]}" if cond else ""
        parts.append(f"SELECT {', '.join(cols)}, label FROM m{where}")
    union = "\n  UNION ALL ".join(parts)
    keys = list(spec.keys)
    if spec.min_population_share is None:
        return with_panel(_final(keys, spec), f"u AS ({union})", *_grouped("u", keys, spec))
    shown = ", ".join(
        f"{pct('n', '(SELECT count(*) FROM m)') if isinstance(metric, S.Share) else _shown(metric)} AS {name}"
        for name, metric in spec.show.items()
    )
    names = ", ".join(keys)
    return with_panel(
        f"SELECT {names}, {shown} FROM g"
        f" WHERE n >= (SELECT count(*) FROM m) * {spec.min_population_share}e0 / 100",
        f"u AS ({union})",
        f"g AS (SELECT {names}, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (label = 1) AS BIGINT) AS churned"
        f" FROM u GROUP BY {names})",
    )


def report_sql(spec: S.Profile | S.Stacked) -> str:
    return profile_sql(spec) if isinstance(spec, S.Profile) else stacked_sql(spec)
