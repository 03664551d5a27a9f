"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label become one class. A bounded sample of the classes serves as pivots; each class
belongs to its nearest pivot and visits every other cell that a vector within the threshold could
belong to (its distance from the bisector is at most the threshold). A cell whose members or
visitors are many is dealt to a grid of blocks, so a task holds a bounded number of vectors.

In a block, members and candidates each get a tree: levels of nested balls with halving radii, each with
its true covering radius. A pair of balls is dropped if it is too far apart to hold a link, counted whole if all
of its pairs are links, and split otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.session import materialise

CELL = 2_000
"""Classes of a label for each pivot, about."""

PIVOTS = 1_024
"""Pivots of all labels together, about; their broadcast is bounded by this and the dimensions."""

BLOCK = 2_048
"""Members, and candidates, of a block, about."""

VISITORS = 1_024
"""Classes whose visits are worked out at once."""

LEAF = 24
"""A ball of at most so many vectors is not split."""

SLACK = 1e-9
"""Bounds are loosened by this much, far above rounding; the decision itself is on the cosine."""


class Ball(NamedTuple):
    """A node: its centre's position, the positions it holds, its covering radius, its children."""

    centre: int
    held: np.ndarray
    radius: float
    children: tuple[Ball, ...]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, from their cosines."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def cover_tree(x: np.ndarray) -> Ball:
    """Nested balls over unit vectors; a child's centre is one of its parent's points, the first is the parent's centre."""

    def grow(centre: int, held: np.ndarray, far: np.ndarray, radius: float) -> Ball:
        covering = float(far.max())
        if len(held) <= LEAF or covering == 0.0:
            return Ball(centre, held, covering, ())
        while radius >= covering:
            radius /= 2
        children, left = [], held
        here, near = centre, far
        while True:
            inside = near <= radius
            if here == centre or inside.any():
                children.append(grow(here, left[inside], near[inside], radius))
            left = left[~inside]
            if not len(left):
                return Ball(centre, held, covering, tuple(children))
            here = int(left[0])
            near = _distances(x[left], x[here : here + 1])[:, 0]
            near[0] = 0.0

    all_ = np.arange(len(x))
    first = _distances(x, x[:1])[:, 0]
    first[0] = 0.0
    return grow(0, all_, first, 2.0)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of all links the same, smallest, mark."""
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != (up := root[root])).any():
            root[:] = up


def dual_traversal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each x the summed weights of the y within the threshold; marks of x and y joined by links."""
    most = float(np.sqrt(2.0 - 2.0 * cosine))
    counts = np.zeros(len(x), dtype=np.int64)
    root = np.arange(len(x) + len(y))
    stack = [(cover_tree(x), cover_tree(y))]
    while stack:
        p, q = stack.pop()
        d = float(_distances(x[p.centre : p.centre + 1], y[q.centre : q.centre + 1])[0, 0])
        if d > p.radius + q.radius + most + SLACK:
            continue
        if d + p.radius + q.radius < most - SLACK:
            counts[p.held] += weight[q.held].sum()
            both = np.concatenate([p.held, q.held + len(x)])
            _merge(root, both[1:], np.full(len(both) - 1, both[0]))
        elif not p.children and not q.children:
            i, j = np.nonzero(x[p.held] @ y[q.held].T >= cosine)
            if len(i):
                np.add.at(counts, p.held[i], weight[q.held[j]])
                _merge(root, p.held[i], q.held[j] + len(x))
        else:
            ps, qs = p.children or (p,), q.children or (q,)
            gap = _distances(x[[c.centre for c in ps]], y[[c.centre for c in qs]])
            reach = np.array([c.radius for c in ps])[:, None] + np.array([c.radius for c in qs])[None, :]
            for i, j in np.argwhere(gap <= reach + most + SLACK).tolist():
                stack.append((ps[i], qs[j]))
    return counts, root


def near_duplicates(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept`` of every row.

    Vectors are compared by cosine in double precision if their labels are equal and not null and their
    dimensions agree. A null, empty or zero vector, or one with null or non-finite components, and a row with a null
    key or label are linked with nothing and keep themselves. Rows with equal keys are separate vectors that link
    like any others and share their component. Equal vectors are linked whatever their number. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(f"`{key}`").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    finite = "forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))"
    sound = F.expr(f"label IS NOT NULL AND vec_id IS NOT NULL AND {finite} AND exists(v, e -> e <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # Scaling by the largest component first keeps the norm of huge and tiny vectors finite and above zero.
    unit = (
        rows.filter("sound")
        .withColumn("_top", F.expr("array_max(transform(v, e -> abs(e)))"))
        .withColumn("v", F.expr("transform(v, e -> e / _top)"))
        .withColumn("_norm", F.expr("sqrt(aggregate(v, 0D, (s, e) -> s + e * e))"))
        .select("vec_id", "label", F.expr("transform(v, e -> e / _norm + 0D)").alias("v"))
        .select("vec_id", "label", F.size("v").alias("dim"), F.xxhash64("v").alias("h"), "v")
    )
    kept = materialise(unit)
    classes = materialise(
        kept.groupBy("label", "dim", "h", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )
    found = materialise(_block_links(_blocks(classes, cosine), cosine))
    totals = found.groupBy("label", "dim", "h").agg(F.sum("links").alias("_links"))
    groups = components(found.filter("rep <> other"), "rep", "other")
    own = classes.select("label", "dim", "h", "rep").join(groups, F.col("rep") == F.col("node"), "left")
    own = own.join(totals, ["label", "dim", "h"]).select(
        "label", "dim", "h", (F.col("_links") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = kept.select("vec_id", "label", "dim", "h").join(own, ["label", "dim", "h"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _blocks(classes: DataFrame, cosine: float) -> DataFrame:
    """Classes as members and candidates of blocks: every pair within the threshold meets once, at its member's home."""
    spark = classes.sparkSession
    every = max(CELL, -(-classes.count() // PIVOTS))
    sample = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(every)) == 0
    pivots: dict[tuple, list] = {}
    for r in classes.filter(sample).select("label", "dim", "v").collect():
        pivots.setdefault((r["label"], r["dim"]), []).append(r["v"])
    shared = spark.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})
    most = float(np.sqrt(2.0 - 2.0 * cosine))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), VISITORS):
                yield from visit(whole.slice(at, VISITORS))

    def visit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
            groups.setdefault(k, []).append(i)
        for k, members in groups.items():
            part, pivot = batch.take(pa.array(members)), shared.value.get(k)
            if pivot is None:
                row = np.arange(len(part))
                cell, home = np.zeros(len(part), dtype=np.int64), np.ones(len(part), dtype=bool)
            else:
                dots = _matrix(part.column("v"), k[1]) @ pivot.T
                each, own = np.arange(len(dots)), dots.argmax(axis=1)
                apart = _distances(pivot, pivot)[own]
                here = dots[each, own][:, None] - dots <= most * apart + SLACK
                here[each, own] = True
                row, cell = np.nonzero(here)
                home = own[row] == cell
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int64()), pa.array(home)], names)

    names = [*classes.columns, "cell", "home"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", cell long, home boolean"
    placed = classes.mapInArrow(visits, schema)
    cells = placed.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("_s"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_t"),
    )
    dealt = placed.join(cells.filter("_s > 0"), ["label", "dim", "cell"])
    dealt = dealt.withColumns({"_i": F.expr("cast(pmod(h, _s) AS int)"), "_j": F.expr("cast(pmod(shiftright(h, 20), _t) AS int)")})
    places = """concat(
        transform(if(home, sequence(0, _t - 1), cast(array() AS array<int>)), x -> struct(_i AS i, x AS j, true AS member)),
        transform(sequence(0, _s - 1), x -> struct(x AS i, _j AS j, false AS member)))"""
    return dealt.select(*classes.columns, "cell", F.expr(f"inline({places})"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _block_links(blocks: DataFrame, cosine: float) -> DataFrame:
    """Of each block: summed links of its members, and links that join what it holds (a star for each local group)."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def links(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy().astype(bool)
        v = _matrix(table.column("v").combine_chunks(), table.column("dim")[0].as_py())
        n = table.column("n").to_numpy()
        mine, theirs = np.flatnonzero(member), np.flatnonzero(~member)
        ids, counts, root = np.concatenate([mine, theirs]), np.zeros(len(v), dtype=np.int64), np.arange(len(v))
        if len(mine) and len(theirs):
            counts[: len(mine)], root = dual_traversal(v[mine], v[theirs], n[theirs], cosine)
        told = np.flatnonzero((root != np.arange(len(v))) | (counts > 0))
        rows = table.take(pa.array(ids[told]))
        other = table.column("rep").take(pa.array(ids[root[told]]))
        columns = [*(rows.column(c) for c in ("label", "dim", "h", "rep")), other, pa.array(counts[told])]
        return pa.table(columns, names=["label", "dim", "h", "rep", "other", "links"])

    schema = f"label {kinds['label']}, dim int, h long, rep {kinds['rep']}, other {kinds['rep']}, links long"
    return blocks.groupBy("label", "dim", "cell", "i", "j").applyInArrow(links, schema)
