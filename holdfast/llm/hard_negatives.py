"""Hard negatives by a vertical scan with branch and bound (BOND).

Rows are dealt into blocks of columns, anchors into blocks of their own, and each pair of blocks is one cell of work. For
an anchor a cell reads the dimensions in the order of the anchor's descending magnitude. What the unread ones can still
add lies between sums of their smallest and largest products in the block; candidates whose range cannot reach the result any more
leave the bitmap of candidates, until the scores of the rest are exact. A first round finds each anchor's positives, a second one the
best rows inside the score window of each positive. A cell returns at most a few rows for each anchor (and positive), from which the
best of all cells are taken.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import materialise


class Params(NamedTuple):
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    """A negative scores from ``low`` to ``high`` percent of its positive."""
    anchor_block: int = 1024
    row_block: int = 8192
    """Rows of a block, on average."""
    read_at_once: int = 16
    """Dimensions between two looks at the bounds."""


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def quantised(vector: str, scale: float = 256.0) -> Column:
    """Components as whole numbers: floor(scale * x) in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


class _Scan:
    """Block of vectors by dimension, and the bounds of what unread dimensions add to a product with an anchor."""

    def __init__(self, columns: np.ndarray):
        exact = np.abs(columns).max(initial=0) < 2**53
        self.columns = columns.astype(np.float64) if exact else columns
        self.low = columns.min(axis=1, initial=2**62) if columns.shape[1] else np.zeros(len(columns), np.int64)
        self.high = columns.max(axis=1, initial=-(2**62)) if columns.shape[1] else np.zeros(len(columns), np.int64)

    def read(self, anchor: np.ndarray, at_once: int):
        """(dimensions, least and most of what is then unread) for each step; products are exact whole numbers."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])
        least, most = ends.min(axis=0)[order], ends.max(axis=0)[order]
        least, most = (np.append(x[::-1].cumsum()[::-1], 0) for x in (least, most))
        for start in range(0, len(order), at_once):
            stop = min(start + at_once, len(order))
            yield order[start:stop], least[stop], most[stop]

    def add(self, partial: np.ndarray, anchor: np.ndarray, dims: np.ndarray, alive: np.ndarray | None) -> np.ndarray:
        part = self.columns[dims] if alive is None else self.columns[np.ix_(dims, alive)]
        values = anchor[dims]
        if part.dtype == np.float64 and (np.abs(values).astype(np.float64) * np.maximum(np.abs(self.low[dims]), np.abs(self.high[dims]))).sum() < 2**53:
            return partial + (values.astype(np.float64) @ part).astype(np.int64)
        return partial + values @ part.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` highest scores, ties by smaller id."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:most]


def top(scan: _Scan, ids: np.ndarray, anchor: np.ndarray, own: int, most: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``most`` best rows of a block, other than those of the id ``own``."""
    alive = np.flatnonzero(ids != own)
    partial = np.zeros(len(alive), np.int64)
    for dims, least, more in scan.read(anchor, at_once):
        partial = scan.add(partial, anchor, dims, alive if len(alive) < len(ids) else None)
        if len(alive) > most:
            floor = np.partition(partial, len(partial) - most)[len(partial) - most]
            stay = partial + more >= floor + least
            alive, partial = alive[stay], partial[stay]
    best = _best(partial, ids[alive], most)
    return alive[best], partial[best]


def inside(scan: _Scan, ids: np.ndarray, keep: np.ndarray, anchor: np.ndarray, windows: np.ndarray, most: int, at_once: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest and highest score) the positions and scores of its ``most`` best rows among ``keep``."""
    alive = np.flatnonzero(keep)
    partial = np.zeros(len(alive), np.int64)
    for dims, least, more in scan.read(anchor, at_once):
        partial = scan.add(partial, anchor, dims, alive if len(alive) < len(ids) else None)
        stay = np.zeros(len(alive), bool)
        for low, high in windows:
            sure = partial[(partial + least >= low) & (partial + more <= high)]
            if len(sure) >= most:  # rows that are certainly inside push the lowest useful score up
                low = max(low, np.partition(sure, len(sure) - most)[len(sure) - most] + least)
            stay |= (partial + more >= low) & (partial + least <= high)
        alive, partial = alive[stay], partial[stay]
    out = []
    for low, high in windows:
        fits = np.flatnonzero((partial >= low) & (partial <= high))
        best = fits[_best(partial[fits], ids[alive[fits]], most)]
        out.append((alive[best], partial[best]))
    return out


def _matrix(column: pa.ChunkedArray, dims: int, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(rows, dims)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _cells(anchors: DataFrame, rows: DataFrame, p: Params):
    """Both sides laid out over the cells of the grid."""
    blocks = {"a": anchors.count() // p.anchor_block + 1, "r": rows.count() // p.row_block + 1}
    every = {k: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for k, n in blocks.items()}
    dealt = {k: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int") for k, n in blocks.items()}
    left = anchors.withColumn("a", dealt["a"]).withColumn("r", every["r"])
    right = rows.withColumn("r", dealt["r"]).withColumn("a", every["a"])
    key = ("dims", "a", "r")
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def mine(rows: DataFrame, anchors: DataFrame, p: Params = Params()) -> DataFrame:
    """Hard negatives of each anchor and positive; both tables have vec_id (long), label and vector (whole numbers).

    An anchor's positives are the ``p.positives`` rows of its label, of another vec_id, with the highest inner products, ties by
    smaller vec_id. A positive's negatives are the ``p.negatives`` best rows of other labels whose product is ``p.low`` to ``p.high``
    percent of the positive's. Rows with a null vec_id, label or vector take no part; vectors of another length than the
    anchor's are not compared with it; an anchor that occurs several times is mined once; other repeated rows count as
    often as they occur. Products must stay below 2 to the 62.
    """
    columns = ("vec_id", "label", "vector")
    there = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    dims = F.size("vector").alias("dims")
    numbered = F.monotonically_increasing_id().alias("row")
    code = F.xxhash64("label").alias("class")
    table = materialise(rows.filter(there).select("vec_id", code, "vector", dims, numbered))
    asked = materialise(anchors.filter(there).select(*columns).dropDuplicates().select("vec_id", code, "vector", dims, numbered))
    named = asked.select(F.col("vec_id").alias("anchor_id"), F.col("class").alias("anchor_class"), F.col("vector").alias("anchor"), "dims", "row")

    def positives(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"row": [], "positive_id": [], "positive_score": []}
        d = key[0].as_py()
        if left.num_rows and right.num_rows:
            ids, classes = _ints(right, "vec_id"), _ints(right, "class")
            vectors = _matrix(right.column("vector"), d, right.num_rows)
            wanted, asking = _matrix(left.column("anchor"), d, left.num_rows), _ints(left, "anchor_class")
            own, numbers = _ints(left, "anchor_id"), _ints(left, "row")
            for one in np.unique(asking):
                mine_ = np.flatnonzero(classes == one)
                scan = _Scan(np.ascontiguousarray(vectors[mine_].T))
                for i in np.flatnonzero(asking == one):
                    at, scores = top(scan, ids[mine_], wanted[i], own[i], p.positives, p.read_at_once)
                    out["row"] += [numbers[i]] * len(at)
                    out["positive_id"] += ids[mine_][at].tolist()
                    out["positive_score"] += scores.tolist()
        return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))

    found = _cells(named, table, p).applyInArrow(positives, "row long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("place", place).filter(F.col("place") <= p.positives)
    listed = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))
    asked_too = materialise(
        named.join(listed, "row").select("*", F.col("found.positive_id").alias("positive_ids"), F.col("found.positive_score").alias("positive_scores")).drop("found")
    )

    def negatives(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("row", "place", "negative_id", "negative_score")
        out: dict[str, list] = {c: [] for c in names}
        d = key[0].as_py()
        if left.num_rows and right.num_rows:
            ids, classes = _ints(right, "vec_id"), _ints(right, "class")
            scan = _Scan(np.ascontiguousarray(_matrix(right.column("vector"), d, right.num_rows).T))
            wanted, asking, numbers = _matrix(left.column("anchor"), d, left.num_rows), _ints(left, "anchor_class"), _ints(left, "row")
            scores = left.column("positive_scores").to_pylist()
            for i in range(left.num_rows):
                s = np.array(scores[i], np.int64)
                windows = np.stack([-((-p.low * s) // 100), p.high * s // 100], axis=1)
                open_ = np.flatnonzero(windows[:, 0] <= windows[:, 1])
                if not len(open_):
                    continue
                for j, (at, values) in zip(open_, inside(scan, ids, classes != asking[i], wanted[i], windows[open_], p.negatives, p.read_at_once)):
                    out["row"] += [numbers[i]] * len(at)
                    out["place"] += [int(j) + 1] * len(at)
                    out["negative_id"] += ids[at].tolist()
                    out["negative_score"] += values.tolist()
        return pa.table(out, pa.schema([(c, pa.int64()) for c in names]))

    hard = _cells(asked_too, table, p).applyInArrow(negatives, "row long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    hard = hard.withColumn("rank", rank).filter(F.col("rank") <= p.negatives)
    at = F.col("place").cast("int") - 1
    return hard.join(asked_too.select("row", "anchor_id", "positive_ids", "positive_scores"), "row").select(
        "anchor_id",
        F.get("positive_ids", at).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        F.get("positive_scores", at).alias("positive_score"),
        "negative_score",
    )
