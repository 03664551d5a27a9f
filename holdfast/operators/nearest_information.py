"""Mutual information of a class label and a number, by nearest neighbours, over all rows.

For each row: the distance d to its k-th nearest row of the same class, and the number m of rows of any class nearer than d. The
estimate is psi(N) + mean(psi(k) - psi(rows of the class) - psi(m)). A column that fits a task is counted by value and class there; of a
longer one, neighbours come from ranges of (feature, class, value), each with k rows borrowed from either side, and m is a difference of
two running counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numeric import rounded
from holdfast.operators import columns as whole_columns
from holdfast.operators.ranking import prefix_sums
from holdfast.session import materialise, ship_package, shuffle_width

NEIGHBOURS = 3
_CHUNK = 50_000


def digamma(x: Column) -> Column:
    """psi of a number of at least 1, to about ten digits: six steps of the recurrence, then the asymptotic series."""
    y = x + 6.0
    steps = sum((F.lit(1.0) / (x + float(i)) for i in range(1, 6)), F.lit(1.0) / x)
    square = y * y
    series = 1.0 / (12.0 * square) - 1.0 / (120.0 * square * square) + 1.0 / (252.0 * square * square * square)
    return F.ln(y) - 1.0 / (2.0 * y) - series - steps


def kth_distance(groups: np.ndarray, values: np.ndarray, k: int, first: int, last: int) -> np.ndarray:
    """Distance of rows ``first`` to ``last`` to their k-th nearest neighbour in their group (the farthest, if there are fewer).

    Rows are sorted by group and value; those outside are context.
    """
    n = len(values)
    at = np.arange(first, last)
    found = np.full((2 * k, len(at)), np.inf)
    for j in range(1, k + 1):
        for row, other in ((2 * j - 2, at - j), (2 * j - 1, at + j)):
            ok = (other >= 0) & (other < n)
            ok[ok] = groups[other[ok]] == groups[at[ok]]
            found[row, ok] = np.abs(values[other[ok]] - values[at[ok]])
    found.sort(axis=0)
    near = found[k - 1]
    fewer = np.isinf(near)
    known = np.where(np.isinf(found), -np.inf, found)
    near[fewer] = known[:, fewer].max(axis=0) if fewer.any() else 0
    return near


def _pack(feature: list[str], label: np.ndarray) -> np.ndarray:
    return np.array([f"{y}|{f}" for f, y in zip(feature, label)], dtype=object)


def neighbour_distances(long: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, label, value, d) of every row (id, feature, label, value) with another row of its feature and class."""
    ship_package(long.sparkSession)
    order = [F.col(c).asc() for c in ("feature", "label", "value", "id")]
    spread = long.repartitionByRange(shuffle_width(long.sparkSession), *order).sortWithinPartitions(*order)
    stored = materialise(spread.select("feature", "label", "value", F.spark_partition_id().cast("long").alias("part")))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, heads, tails = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(3)[0].as_py()
            rows = batch.select(["feature", "label", "value"])
            if len(heads) < k:
                heads += rows.slice(0, k - len(heads)).to_pylist()
            tails = (tails + rows.slice(max(0, rows.num_rows - k)).to_pylist())[-k:]
        if part is not None:
            for side, held in ((0, heads), (1, tails)):
                n = len(held)
                columns = [pa.array([part] * n), pa.array([side] * n), pa.array(range(n)), *[pa.array([r[c] for r in held], t) for c, t in (("feature", pa.string()), ("label", pa.int32()), ("value", pa.float64()))]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "side", "place", "feature", "label", "value"])

    # 2 k rows of each partition
    got = stored.mapInArrow(edges, "part long, side long, place long, feature string, label int, value double").collect()
    held: dict[tuple[int, int], list[tuple]] = {}
    for r in sorted(got, key=lambda r: (r["part"], r["side"], r["place"])):
        held.setdefault((r["part"], r["side"]), []).append((f"{r['label']}|{r['feature']}", r["value"]))
    parts = sorted({p for p, _ in held})
    before, after = {}, {}
    for i, p in enumerate(parts):
        rows: list[tuple] = []
        for q in reversed(parts[:i]):
            rows = held[q, 1] + rows
            if len(rows) >= k:
                break
        before[p] = rows[-k:]
        rows = []
        for q in parts[i + 1 :]:
            rows = rows + held[q, 0]
            if len(rows) >= k:
                break
        after[p] = rows[:k]
    shared = long.sparkSession.sparkContext.broadcast((before, after))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, dtype=object), np.zeros(0))
        behind, now, last = None, [], []

        def context(rows: list[tuple]):
            return (np.array([g for g, _ in rows], dtype=object), np.array([v for _, v in rows], np.float64)) if rows else empty

        def emit(behind, batch, ahead):
            g, v = _pack(batch.column(0).to_pylist(), batch.column(1).to_numpy()), batch.column(2).to_numpy()
            groups, values = (np.concatenate([a, b, c]) for a, b, c in zip(behind, (g, v), ahead))
            d = kth_distance(groups, values, k, len(behind[0]), len(behind[0]) + len(v))
            keep = np.isfinite(d)
            out = pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(d)], ["feature", "label", "value", "d"])
            return out.filter(pa.array(keep)), (groups[: len(behind[0]) + len(v)][-k:], values[: len(behind[0]) + len(v)][-k:])

        def joined(batches):
            return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            if behind is None:
                behind = context(shared.value[0][batch.column(3)[0].as_py()])
            last.append(batch)
            if sum(b.num_rows for b in last) < max(_CHUNK, k):
                continue
            if now:
                ready, following = joined(now), joined(last)
                ahead = (_pack(following.column(0).to_pylist()[:k], following.column(1).to_numpy()[:k]), following.column(2).to_numpy()[:k])
                out, behind = emit(behind, ready, ahead)
                yield out
            now, last = last, []
        if now or last:
            ready = joined(now + last)
            yield emit(behind, ready, context(shared.value[1][ready.column(3)[0].as_py()]))[0]

    return stored.mapInArrow(measure, "feature string, label int, value double, d double")


def _psi(x: np.ndarray) -> np.ndarray:
    """The same series as ``digamma``."""
    y = x + 6.0
    series = 1 / (12 * y**2) - 1 / (120 * y**4) + 1 / (252 * y**6)
    return np.log(y) - 1 / (2 * y) - series - sum(1 / (x + i) for i in range(6))


def class_distances(value: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Distance of a row of each of some distinct values in order, of one class, to its k-th nearest; k + 1 copies stand for more."""
    copies = np.minimum(n, k + 1)
    first = np.cumsum(copies) - copies
    out = np.empty(len(value))
    for a in range(0, len(value), _CHUNK):
        z = min(a + _CHUNK, len(value))
        low, high = max(0, a - k), min(len(value), z + k)
        near = np.repeat(value[low:high], copies[low:high])
        begin, end = int(first[a] - first[low]), int(first[z - 1] - first[low]) + 1
        out[a:z] = kth_distance(np.zeros(len(near), np.int8), near, k, begin, end)[first[a:z] - first[a]]
    return out


def _in_tasks(df: DataFrame, columns: list[str], rows: int, k: int) -> DataFrame:
    """(feature, s, of_all): sum of the terms of all rows of a column, and their number."""
    schema = "feature string, s double, of_all double"

    def work(j: int, parts: whole_columns.Parts) -> Iterator[pa.RecordBatch]:
        value, label, n = whole_columns.counted_values(parts)
        found = []
        for one in np.unique(label):
            own = label == one
            v, starts = value[own], whole_columns.starts_of(value[own])
            v, w = v[starts], np.add.reduceat(n[own], starts)
            d = class_distances(v, w, k)
            there = np.isfinite(d)
            if there.any():
                found.append((v[there], w[there], d[there]))
        if not found:
            return
        points, weights = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(points, kind="stable")
        points, upto = points[order], np.concatenate([[0], weights[order].cumsum()])
        total = 0.0
        for v, w, d in found:
            of_class = w.sum()
            for a in range(0, len(v), _CHUNK):
                x, r = v[a : a + _CHUNK], d[a : a + _CHUNK]
                ahead = np.where(r > 0, np.searchsorted(points, x + r, "left"), np.searchsorted(points, x, "right"))
                behind = np.where(r > 0, np.searchsorted(points, x - r, "right"), np.searchsorted(points, x, "left"))
                m = (upto[ahead] - upto[behind]).astype(np.float64)
                term = _psi(np.float64(min(k, of_class - 1))) - _psi(np.float64(of_class)) - _psi(m)
                total += float((term * w[a : a + _CHUNK]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([columns[j]]), pa.array([total]), pa.array([float(upto[-1])])], ["feature", "s", "of_all"])

    there = df.filter("label IS NOT NULL").select(F.col("label").cast("int").alias("label"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    return whole_columns.each_column(whole_columns.runs(there, columns, F.col("label")), columns, rows, work, schema)


def nearest_information(df: DataFrame, columns: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """(feature, mutual_information, mi_rank) of complete columns of (id, label, ...), in nats, never below 0.

    A class of a single row is left out, a class of fewer than k + 1 rows uses all its others. Where the k-th neighbour has
    the same value, m counts the rows of that value. A missing value leaves its row out of that column.
    """
    size = df.count()
    sums = _in_tasks(df, columns, size, k) if size <= whole_columns.COLUMN_ROWS else _in_ranges(df, columns, k)
    scores = sums.select("feature", rounded(F.greatest(F.lit(0.0), digamma(F.col("of_all")) + F.col("s") / F.col("of_all")), 6).alias("mutual_information"))
    place = Window.orderBy(F.desc("mutual_information"), F.asc("feature"))
    return scores.withColumn("mi_rank", F.row_number().over(place).cast("bigint"))


def _in_ranges(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The same sums where a column is too long for a task."""
    entries = ", ".join(f"struct('{c}' AS feature, cast({c} AS double) AS value)" for c in columns)
    long = df.selectExpr("id", "cast(label AS int) AS label", f"inline(array({entries}))").filter("value IS NOT NULL AND NOT isnan(value) AND label IS NOT NULL")
    near = materialise(neighbour_distances(long, k).groupBy("feature", "label", "value", "d").agg(F.count(F.lit(1)).alias("n")))
    # classes x columns rows
    classes = near.groupBy("feature", "label").agg(F.sum("n").alias("of_class"))
    whole = Window.partitionBy("feature")
    classes = classes.withColumn("of_all", F.sum("of_class").over(whole))
    points = near.groupBy("feature", F.col("value").alias("x")).agg(F.sum("n").alias("n"))
    asked = near.select("feature", "value", "d").distinct()
    value, d = F.col("value"), F.col("d")
    # kind 0 comes before the points of the same number, kind 2 after them
    ends = F.array(
        F.struct(F.lit(0).alias("end"), (value - d).alias("x"), F.when(d > 0, 2).otherwise(0).alias("kind")),
        F.struct(F.lit(1).alias("end"), (value + d).alias("x"), F.when(d > 0, 0).otherwise(2).alias("kind")),
    )
    lookups = asked.select("feature", "value", "d", F.inline(ends)).withColumn("n", F.lit(0).cast("long"))
    known = points.select("feature", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("d"), F.lit(-1).alias("end"), "x", F.lit(1).alias("kind"), "n")
    run = prefix_sums(known.unionByName(lookups), [F.col("feature").asc(), F.col("x").asc(), F.col("kind").asc(), F.col("value").asc(), F.col("d").asc()], {"upto": "n"})
    side = lambda end: F.max(F.when(F.col("end") == end, F.col("upto")))
    inside = run.filter("end >= 0").groupBy("feature", "value", "d").agg((side(1) - side(0)).alias("m"))
    rows = near.join(inside, ["feature", "value", "d"]).join(F.broadcast(classes), ["feature", "label"])
    used = F.least(F.lit(k), F.col("of_class") - 1).cast("double")
    term = digamma(used) - digamma(F.col("of_class").cast("double")) - digamma(F.col("m").cast("double"))
    return rows.groupBy("feature").agg(F.sum(term * F.col("n")).alias("s"), F.max("of_all").cast("double").alias("of_all"))
