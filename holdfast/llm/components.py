"""Connected components: forests of bounded parts of the edges, then alternating star operations; counts alone reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import materialise

FILE_ROWS = 250_000
"""Edges that one task joins by itself; more are dealt to several tasks."""


def _minimum(pairs: DataFrame) -> DataFrame:
    """Smallest ``v`` of each ``u``; partial sums make a hub cost one row for each task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_minimum(both), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these; edges run from larger to smaller."""
    joined = edges.join(_minimum(edges), "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.filter("v = m").select("u", F.col("m").alias("v")))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a list of edges that are not the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        np.minimum.at(root, high, low)
        while not np.array_equal(further := root[root], root):
            root = further
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the smallest nodes, joined whenever FILE_ROWS edges are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars():
        one = forest(*(np.concatenate([h[i] for h in held]) for i in range(2)))
        held[:] = [one]
        return one

    kind = None
    for batch in batches:
        kind = batch.schema
        if batch.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(h[0]) for h in held) > FILE_ROWS:
            stars()
    if held:
        u, v = stars()
        yield pa.RecordBatch.from_arrays([pa.array(u, kind.field(0).type), pa.array(v, kind.field(1).type)], ["u", "v"])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that an edge touches.

    Self-loops, repeated edges and either direction are fine; nulls link nothing; no edges give an empty table.
    Edges are dealt to parts of about FILE_ROWS, each becomes a forest of stars. Where there is one part, that is the answer;
    otherwise star rounds join the forests until a round leaves the edges as they were. Rounds grow with the logarithm
    of the longest path.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") > F.col("v")))
    kind = pairs.schema["u"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    # each partition hands on a forest: never more edges than it was given, and one for each node
    now = materialise(pairs.mapInArrow(_joined, schema))
    files = now.count() // FILE_ROWS + 1
    now = materialise(now.coalesce(files).mapInArrow(_joined, schema))
    state = None
    while files > 1:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        files_now = seen[0] // FILE_ROWS + 1
        moved = _large_star(now.coalesce(files_now)).distinct()
        now = materialise(_small_star(moved).distinct().coalesce(files_now))
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select("v", "v").distinct().toDF("node", "component"))
