"""Positions and running digests along an order inside each key, when one key may hold a large part of all rows.

Rows are range-partitioned by (key, order), so that a long key spreads over several partitions. What a partition has to
add for the key it starts with is one row of totals for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from holdfast.session import materialise, shuffle_width


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def running(df: DataFrame, key: str, order: list[Column], lanes: tuple[str, ...], keep: list[Column]) -> DataFrame:
    """``key``, ``keep``, ``_n`` (1-based position in the key) and the running exclusive-or of the long columns ``lanes``.

    The running values replace their columns. ``key`` is a long without nulls. Rows that are equal in ``order``
    get consecutive positions in no particular order. An empty table stays empty.
    """
    names = [df.select(c).columns[0] for c in keep]
    spread = df.repartitionByRange(shuffle_width(df.sparkSession), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    stored = materialise(spread.select(key, *lanes, *keep, F.spark_partition_id().alias("_part")))
    width = 1 + len(lanes)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        sums = np.zeros(width, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _long(batch.column(0))
            if part is None:
                part, first = batch.column(batch.num_columns - 1)[0].as_py(), int(keys[0])
            if keys[-1] != last:
                last, sums = int(keys[-1]), np.zeros(width, np.int64)
            mine = np.flatnonzero(keys == last)
            sums[0] += len(mine)
            for i in range(len(lanes)):
                sums[1 + i] ^= np.bitwise_xor.reduce(_long(batch.column(1 + i))[mine])
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last], "sums": [sums.tolist()]})

    found = stored.mapInArrow(totals, "part long, first long, last long, sums array<long>").collect()  # one row a partition
    before: dict[int, tuple[int, np.ndarray]] = {}
    at, sums = None, np.zeros(width, np.int64)
    for row in sorted(found, key=lambda r: r["part"]):
        if row["first"] == at:
            before[row["part"]] = (at, sums)
        own = np.array(row["sums"], np.int64)
        sums = np.append(sums[0] + own[0], sums[1:] ^ own[1:]) if row["last"] == at else own
        at = row["last"]
    shared = df.sparkSession.sparkContext.broadcast(before)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, started = None, np.zeros(width, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not started:
                started = True
                at, held = shared.value.get(batch.column(batch.num_columns - 1)[0].as_py(), (None, held))
            keys = _long(batch.column(0))
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            seen = np.arange(1, len(keys) + 1) - starts[group]
            out = [np.where(group == 0, seen + held[0], seen) if keys[0] == at else seen]
            for i in range(len(lanes)):
                values = _long(batch.column(1 + i))
                run = np.bitwise_xor.accumulate(values)
                run ^= (run[starts] ^ values[starts])[group]
                if keys[0] == at:
                    run[group == 0] ^= held[1 + i]
                out.append(run)
            at, held = int(keys[-1]), np.array([s[-1] for s in out], np.int64)
            rest = [batch.column(j) for j in range(width, batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s) for s in out], *rest], [key, "_n", *lanes, *names])

    schema = StructType([stored.schema[key]]).add("_n", LongType())
    for lane in lanes:
        schema = schema.add(lane, LongType())
    for name in names:
        schema = schema.add(stored.schema[name])
    return stored.mapInArrow(place, schema)
