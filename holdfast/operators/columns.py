"""Whole columns of a wide table: a column is counted by value in its chunks of rows, and one task puts the counts together.

A long (feature, value) table costs a row of the engine for each cell. Here a chunk of rows gives, for each column, its distinct values in
order with their counts as plain arrays, which travel to the column's task. Columns of more than ``COLUMN_ROWS`` rows are too much for a
task; callers keep a way over ranges for those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.session import ship_package, shuffle_width

COLUMN_ROWS = 5_000_000
"""Rows up to which one task holds a column: about 60 bytes a row."""
_CHUNK = 16_384
_CELLS = 1_000_000
"""Cells that a task is worth, where columns are short."""
_RUNS = "j int, chunk long, value binary, kind binary, n binary, place binary"


def _arrow(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in schema.split(", ")])


def runs(df: DataFrame, columns: list[str], kind: Column | None = None, places: bool = False, counted: bool = True) -> DataFrame:
    """(column number, chunk, distinct (value, kind) in order, their counts, and the place of each row among them if ``places``).

    Missing values are left out. Values that are not ``counted`` are only looked up: their counts are 0.
    """
    ship_package(df.sparkSession)
    rows = df.select((F.lit(0) if kind is None else kind).cast("int").alias("_kind"), *[F.col(c).cast("double").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(at, _CHUNK)
                kinds = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
                # rows in order of their kinds: a stable sort by value then leaves equal values in that order
                first = np.argsort(kinds, kind="stable")
                kinds = kinds[first]
                out: list[list[bytes]] = [[], [], [], []]
                for j in range(len(columns)):
                    column = batch.column(1 + j)
                    value, own, rest = column.to_numpy(zero_copy_only=False)[first] + 0.0, kinds, first
                    if column.null_count:
                        if places:
                            raise ValueError(f"{columns[j]} has missing values")
                        there = column.is_valid().to_numpy(zero_copy_only=False)[first]
                        value, own, rest = value[there], own[there], rest[there]
                    order = np.argsort(value, kind="stable")
                    value, own = value[order], own[order]
                    new = np.ones(len(value), bool)
                    new[1:] = ((value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))) | (own[1:] != own[:-1])
                    starts = np.flatnonzero(new)
                    n = np.diff(starts, append=len(value)).astype(np.int32)
                    place = np.empty(len(value) if places else 0, np.uint16)
                    if places:
                        place[rest[order]] = np.cumsum(new) - 1
                    for held, part in zip(out, (value[starts], own[starts], n if counted else n * 0, place)):
                        held.append(part.tobytes())
                yield _arrow([pa.array(range(len(columns)), pa.int32()), pa.array([chunk] * len(columns), pa.int64()), *[pa.array(held, pa.binary()) for held in out]], _RUNS)
                chunk += 1

    return rows.mapInArrow(run, _RUNS)


Parts = list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
"""(chunk, values, kinds, counts, places) of the chunks of a column."""


def each_column(found: DataFrame, columns: list[str], rows: int, work: Callable[[int, Parts], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on every column with all of its chunks; a task holds one column, or several that are short."""
    tasks = min(len(columns), max(shuffle_width(found.sparkSession), rows * len(columns) // _CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Parts] = {}
        for batch in batches:
            for j, chunk, value, kind, n, place in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                held.setdefault(j, []).append((chunk, np.frombuffer(value), np.frombuffer(kind, np.int32), np.frombuffer(n, np.int32), np.frombuffer(place, np.uint16)))
        for j in sorted(held):
            yield from work(j, held.pop(j))

    return found.repartitionById(tasks, F.col("j")).mapInArrow(run, schema)


def counted_values(parts: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in order, with kinds and counts; a value of several kinds or chunks comes several times."""
    value, kind, n = (np.concatenate([part[k] for part in parts]) for k in (1, 2, 3))
    order = np.argsort(value, kind="stable")
    return value[order], kind[order], n[order].astype(np.int64)


def starts_of(value: np.ndarray) -> np.ndarray:
    """Where a new value begins; all that are not a number are one value."""
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))
    return np.flatnonzero(new)


def quantiles(df: DataFrame, columns: list[str], rows: int, shares: dict[str, float]) -> DataFrame:
    """(feature, one column for every share): exact, interpolated; a column without values has no row."""
    names = list(shares)
    schema = ", ".join(["feature string", *[f"{name} double" for name in names]])

    def work(j: int, parts: Parts) -> Iterator[pa.RecordBatch]:
        value, _, n = counted_values(parts)
        upto = n.cumsum()
        if not len(upto):
            return
        out = []
        for name in names:
            at = (int(upto[-1]) - 1) * float(shares[name])
            low, high = (value[np.searchsorted(upto, place, "right")] for place in (np.floor(at), np.ceil(at)))
            out.append(float(low + (high - low) * (at - np.floor(at))))
        yield _arrow([pa.array([columns[j]]), *[pa.array([v]) for v in out]], schema)

    return each_column(runs(df, columns), columns, rows, work, schema)


def group_pairs(df: DataFrame, columns: list[str], rows: int, by: str) -> DataFrame:
    """(feature, group, n, pos, pairs): rows, positive ones, and pairs of a positive above a negative (ties half), of a 0/1 label."""
    schema = f"feature string, {by} int, n long, pos long, pairs double"
    # an even and an odd number for each group; a missing group has one of its own
    kind = F.coalesce(F.col(by).cast("int"), F.lit(-(2**30))) * 2 + F.coalesce(F.col("label").cast("int"), F.lit(0))

    def work(j: int, parts: Parts) -> Iterator[pa.RecordBatch]:
        value, kinds, n = counted_values(parts)
        groups, out = np.unique(kinds >> 1), []
        for group in groups:
            mine = kinds >> 1 == group
            own, positive = n[mine], n[mine] * (kinds[mine] & 1)
            starts = starts_of(value[mine])
            both, pos = np.add.reduceat(own, starts), np.add.reduceat(positive, starts)
            above = pos.sum() - pos.cumsum()
            out.append((int(both.sum()), int(pos.sum()), float(((both - pos) * (above + pos / 2.0)).sum())))
        if out:
            shown = [None if group == -(2**30) else int(group) for group in groups]
            yield _arrow([pa.array([columns[j]] * len(out)), pa.array(shown, pa.int32()), *[pa.array([row[k] for row in out]) for k in range(3)]], schema)

    return each_column(runs(df, columns, kind), columns, rows, work, schema)


def rank_products(df: DataFrame, columns: list[str], rows: int, looked_up: DataFrame | None = None) -> np.ndarray:
    """Products of the centred tie-averaged ranks (times 2) of complete columns and a last column of ones, summed over rows.

    (columns + 1) x (columns + 1) numbers reach the driver. ``looked_up``: rows to sum over, if those are not the ranked ones. Chunks must be the same whenever a task is run again, so rows come
    from storage.
    """
    spark, width = df.sparkSession, len(columns)
    found = runs(df, columns, places=looked_up is None)
    if looked_up is not None:
        found = found.union(runs(looked_up, columns, places=True, counted=False))
    ranked = "j int, chunk long, rank binary, place binary"

    def rank(j: int, parts: Parts) -> Iterator[pa.RecordBatch]:
        of, n = np.unique(np.concatenate([part[1] for part in parts]), return_inverse=True)[1], np.concatenate([part[3] for part in parts])
        n = np.bincount(of, n).astype(np.int64)
        # twice the mean rank less rows + 1
        doubled = (2 * n.cumsum() - n - n.sum()).astype(np.int32)
        at = 0
        for chunk, value, _, _, place in parts:
            if len(place):
                own = doubled[of[at : at + len(value)]]
                yield _arrow([pa.array([j], pa.int32()), pa.array([chunk]), pa.array([own.tobytes()], pa.binary()), pa.array([place.tobytes()], pa.binary())], ranked)
            at += len(value)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, chunk, own, place in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                place = np.frombuffer(place, np.uint16)
                if chunk not in held:
                    held[chunk] = np.ones((width + 1, len(place)), np.int32)
                held[chunk][j] = np.frombuffer(own, np.int32)[place]
        sums = np.zeros((width + 1, width + 1))
        for chunk in sorted(held):
            x = held.pop(chunk).astype(np.float64)
            sums += x @ x.T
        if sums.any():
            yield _arrow([pa.array(range(width + 1), pa.int32()), pa.array([row.tobytes() for row in sums], pa.binary())], "i int, sums binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[i] = total.get(i, 0.0) + np.frombuffer(sums)
        if total:
            yield _arrow([pa.array(list(total), pa.int32()), pa.array([row.tobytes() for row in total.values()], pa.binary())], "i int, sums binary")

    tasks = max(shuffle_width(spark), rows * width // (8 * _CELLS))
    each = each_column(found, columns, rows, rank, ranked).repartition(tasks, "chunk").mapInArrow(products, "i int, sums binary")
    out = np.zeros((width + 1, width + 1))
    for r in each.repartitionById(min(width + 1, shuffle_width(spark)), F.col("i")).mapInArrow(add, "i int, sums binary").collect():
        out[r["i"]] = np.frombuffer(r["sums"])
    return out
