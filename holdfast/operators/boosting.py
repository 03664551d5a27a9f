"""Gradient-boosted trees on binned features, with second-order gains; many fits over one matrix at the same time.

The matrix is binned once into blocks of bytes. A tree grows in rounds: gradient and Hessian sums by (node, feature, bin)
of all nodes that wait for a split, then the best split of each. Growth is level by level up to a depth, or best-first up to a number
of leaves; best-first also works in rounds, because a node that is not among the best with all nodes known so far cannot
become one of them later.

Gradients are whole multiples of 2**-24, so that sums do not depend on the order or partitioning of rows, and a node's sums less
those of one child are exactly those of the other. A matrix of at most ``TASK_CELLS`` bytes is given to one task for each fit; of a larger
one, each round is one job over all fits of a chunk: blocks add up their histograms, which are summed and searched on the executors,
and one row for each waiting node reaches the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import materialise, ship_package, shuffle_width

TASK_CELLS = 160_000_000
"""Rows x (features + ``ROW_STATE``) up to which one task fits a model on its own: a byte each in memory."""
ROW_STATE = 64
"""Bytes that a fit in a task holds for a row besides its bins: id, label, fold, margin, gradients and places."""
FITS_AT_ONCE = 20
"""Fits that share the jobs of a distributed round."""
TREES_REPLAYED = 8
"""Trees after which a distributed fit stores its margins."""
_UNIT = 2.0**24
_SMALL = 1e-6
"""Gains up to this are no gain."""
_PART = 2**14
"""Rows added up at a time: a Hessian sum of so many rows and their number fit into one float without loss."""
_FEW = 1024
"""Rows up to which all columns are added up in one call."""
_SEARCHED = 500_000
"""Cells of histograms that are searched for splits at a time."""


@dataclass(frozen=True)
class BoostParams:
    trees: int = 100
    rate: float = 0.1
    depth: int = 0
    """Levels of splits; 0: as many as the leaves allow."""
    leaves: int = 0
    """Best-first growth up to so many leaves; 0: level by level."""
    min_rows: int = 1
    min_hessian: float = 1.0
    l2: float = 1.0
    l1: float = 0.0
    min_gain: float = 0.0
    rows: float = 1.0
    """Share of the rows of each tree."""
    columns: float = 1.0
    """Share of the features of each tree."""
    seed: int = 42


@dataclass(frozen=True)
class Fit:
    """One model: its name, settings, and the fold that it does not see (0: it sees all development rows)."""

    name: str
    params: BoostParams
    without: int = 0


@dataclass
class Tree:
    """Nodes as parallel lists; children of a split are later than their parent."""

    params: BoostParams
    columns: np.ndarray
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    level: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple[float, float, int]] = field(default_factory=lambda: [(0.0, 0.0, 0)])
    found: dict[int, tuple[float, int, int]] = field(default_factory=dict)
    waiting: list[int] = field(default_factory=lambda: [0])

    def splits(self) -> list[int]:
        """Nodes to be split, as far as the nodes' gains are known."""
        p = self.params
        able = {i for i, (gain, _, _) in self.found.items() if gain > max(_SMALL, p.min_gain) and not (p.depth and self.level[i] >= p.depth)}
        if not p.leaves:
            return sorted(able)
        heap, out = [(-self.found[0][0], 0)] if 0 in able else [], []
        while heap and len(out) < p.leaves - 1:
            _, i = heapq.heappop(heap)
            out.append(i)
            for child in (self.left[i], self.left[i] + 1) if self.left[i] >= 0 else ():
                if child in able:
                    heapq.heappush(heap, (-self.found[child][0], child))
        return sorted(out)

    def take(self, best: dict[int, tuple]) -> list[int]:
        """Enter the best split of each waiting node: (gain, feature, cut, left sums, own sums); returns the nodes split now."""
        for i, (gain, feature, cut, left, own) in best.items():
            self.sums[i] = own
            if feature >= 0:
                self.found[i] = (gain, feature, cut)
                self._left_sums[i] = left
        self.waiting = []
        new = [i for i in self.splits() if self.left[i] < 0]
        for i in new:
            _, self.feature[i], self.cut[i] = self.found[i]
            self.left[i] = len(self.feature)
            a, own = self._left_sums[i], self.sums[i]
            for sums in (a, tuple(x - y for x, y in zip(own, a))):
                self.feature.append(-1)
                self.cut.append(0)
                self.left.append(-1)
                self.level.append(self.level[i] + 1)
                self.sums.append(sums)
                if not (self.params.depth and self.level[-1] >= self.params.depth):
                    self.waiting.append(len(self.feature) - 1)
        return new

    def __post_init__(self) -> None:
        self._left_sums: dict[int, tuple[float, float, int]] = {}

    def order(self) -> list[int]:
        """Nodes without the splits that better ones pushed out, children after their parent."""
        kept, out = set(self.splits()), [0]
        for i in out:
            if i in kept:
                out += (self.left[i], self.left[i] + 1)
        return out

    def finished(self) -> dict[str, np.ndarray]:
        """The tree without the splits that better ones pushed out: feature, cut, left, value, cover of every node left."""
        kept, order = set(self.splits()), self.order()
        place = {i: k for k, i in enumerate(order)}
        p = self.params
        g, h, n = (np.array([self.sums[i][k] for i in order]) for k in range(3))
        value = -p.rate * soft(g, p.l1) / np.maximum(h + p.l2, 1e-15)
        return {
            "feature": np.array([self.feature[i] if i in kept else -1 for i in order], np.int64),
            "cut": np.array([self.cut[i] for i in order], np.int64),
            "left": np.array([place[self.left[i]] if i in kept else -1 for i in order], np.int64),
            "value": value,
            "cover": n.astype(np.float64),
        }


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sampled_rows(ids: np.ndarray, p: BoostParams, tree: int) -> np.ndarray:
    """Which rows a tree sees: a hash of the id, so every partitioning agrees."""
    if p.rows >= 1:
        return np.ones(len(ids), bool)
    salt = _mixed(np.array([p.seed * 1_000_003 + tree]))[0]
    return (_mixed(ids.astype(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < p.rows


def sampled_columns(width: int, p: BoostParams, tree: int) -> np.ndarray:
    out = np.ones(width, bool)
    if p.columns < 1:
        order = np.argsort(_mixed(np.arange(width) + (p.seed * 7_919 + tree) * 65_537), kind="stable")
        out[order[max(1, int(p.columns * width)) :]] = False
    return out


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss in whole units."""
    chance = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((chance - label) * _UNIT), np.rint(np.maximum(chance * (1 - chance), 1e-16) * _UNIT)


def histogram(offsets: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, width: int, bins: int) -> np.ndarray:
    """(3, slots, width, bins) sums of g, h and 1; rows with slot -1 are left out. ``offsets`` is bin + feature x bins."""
    out = np.zeros((3, slots * width * bins))
    rows = np.flatnonzero(slot >= 0)
    for part in np.array_split(rows, len(rows) * width // 2_000_000 + 1):
        at = (offsets[part] + (slot[part] * (width * bins))[:, None]).ravel()
        for k, weights in enumerate((g, h, None)):
            out[k] += np.bincount(at, None if weights is None else np.repeat(weights[part], width), out.shape[1])
    return out.reshape(3, slots, width, bins)


def best_splits(sums: np.ndarray, columns: np.ndarray, p: BoostParams) -> list[tuple]:
    """Best split of each slot, ties by smaller feature and bin; feature -1 where none is allowed."""
    g, h = sums[0] / _UNIT, sums[1] / _UNIT
    n = sums[2]
    gl, hl, nl = g.cumsum(axis=2), h.cumsum(axis=2), n.cumsum(axis=2)
    all_g, all_h, all_n = gl[:, :1, -1:], hl[:, :1, -1:], nl[:, :1, -1:]
    gr, hr, nr = all_g - gl, all_h - hl, all_n - nl
    worth = lambda a, b: soft(a, p.l1) ** 2 / np.maximum(b + p.l2, 1e-15)
    gain = worth(gl, hl) + worth(gr, hr) - worth(all_g, all_h)
    allowed = (nl >= p.min_rows) & (nr >= p.min_rows) & (hl >= p.min_hessian) & (hr >= p.min_hessian) & (nl > 0) & (nr > 0)
    gain = np.where(allowed & columns[None, :, None], gain, -np.inf).reshape(len(g), -1)
    # equal gains differ in the last digits by the order of float operations alone
    best = (gain >= gain.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
    out = []
    for i, at in enumerate(best):
        own = (float(all_g[i, 0, 0]), float(all_h[i, 0, 0]), int(all_n[i, 0, 0]))
        if not np.isfinite(gain[i, at]):
            out.append((0.0, -1, 0, own, own))
            continue
        f, b = divmod(int(at), g.shape[2])
        out.append((float(gain[i, at]), f, b, (float(gl[i, f, b]), float(hl[i, f, b]), int(nl[i, f, b])), own))
    return out


def move(node: np.ndarray, binned: np.ndarray, tree: Tree, new: list[int]) -> None:
    """Send rows of the nodes split now to their children."""
    if not new:
        return
    feature, cut, left = (np.array(x) for x in (tree.feature, tree.cut, tree.left))
    is_new = np.zeros(len(feature), bool)
    is_new[new] = True
    rows = np.flatnonzero(is_new[node])
    at = node[rows]
    node[rows] = left[at] + (binned[rows, feature[at]] > cut[at])


def leaf_values(binned: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Value of the leaf that each row ends in."""
    at = np.zeros(len(binned), np.int64)
    rows = np.arange(len(binned))
    while len(rows := rows[tree["feature"][at[rows]] >= 0]):
        now = at[rows]
        at[rows] = tree["left"][now] + (binned[rows, tree["feature"][now]] > tree["cut"][now])
    return tree["value"][at]


def start_margin(label: np.ndarray, seen: np.ndarray) -> float:
    share = min(max(label[seen].mean() if seen.any() else 0.5, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def node_sums(x: np.ndarray, columns: np.ndarray, rows: np.ndarray, g: np.ndarray, packed: np.ndarray, bins: int) -> np.ndarray:
    """(3, columns, bins) sums of g, h and 1 over some rows of a matrix stored by columns; ``packed`` is h x 2 x _PART + 1."""
    out = np.zeros((3, len(columns), bins))
    few = len(rows) <= _FEW
    for start in range(0, len(rows), _PART):
        part = rows[start : start + _PART]
        own_g, own_packed = g[part], packed[part]
        both = np.empty((len(columns), bins))
        if few:
            at = (x[columns[:, None], part[None, :]] + np.arange(0, len(columns) * bins, bins)[:, None]).ravel()
            out[0] += np.bincount(at, np.tile(own_g, len(columns)), both.size).reshape(both.shape)
            both[:] = np.bincount(at, np.tile(own_packed, len(columns)), both.size).reshape(both.shape)
        else:
            for j, column in enumerate(columns):
                at = x[column].take(part).astype(np.intp)
                out[0, j] += np.bincount(at, own_g, bins)
                both[j] = np.bincount(at, own_packed, bins)
        whole = np.floor(both / (2 * _PART))
        out[1] += whole
        out[2] += both - whole * (2 * _PART)
    return out


class _Rows:
    """Row numbers in an order in which the rows of a node are neighbours."""

    def __init__(self, rows: np.ndarray) -> None:
        self.order = rows
        self.span = {0: (0, len(rows))}

    def of(self, node: int) -> np.ndarray:
        a, z = self.span[node]
        return self.order[a:z]

    def split(self, node: int, column: np.ndarray, cut: int, left: int) -> None:
        rows = self.of(node)
        above = column.take(rows) > cut
        low, high = rows[~above], rows[above]
        a, z = self.span[node]
        self.order[a : a + len(low)], self.order[a + len(low) : z] = low, high
        self.span[left], self.span[left + 1] = (a, a + len(low)), (a + len(low), z)


def boost(binned: np.ndarray, label: np.ndarray, ids: np.ndarray, seen: np.ndarray, p: BoostParams, bins: int) -> tuple[float, list[dict], np.ndarray]:
    """Start, trees and the margin of every row, of a model of the rows that are ``seen``.

    Of the two children of a split only the smaller one is added up; nodes too small for any split are not.
    """
    x = np.ascontiguousarray(binned.T)
    width = len(x)
    start = start_margin(label, seen)
    margin, trees = np.full(len(label), start), []
    for t in range(p.trees):
        g, packed = gradients(margin, label)
        packed *= 2 * _PART
        packed += 1
        used = seen & sampled_rows(ids, p, t)
        tree = Tree(p, sampled_columns(width, p, t))
        columns = np.flatnonzero(tree.columns)
        every = np.ones(len(columns), bool)
        inside, others = _Rows(np.flatnonzero(used)), _Rows(np.flatnonzero(~used))
        held: dict[int, np.ndarray] = {}
        families: list[tuple[int | None, tuple[int, ...]]] = [(None, (0,))]
        while tree.waiting:
            best: dict[int, tuple] = {}
            asked: dict[int, np.ndarray] = {}
            for parent, nodes in families:
                able = [i for i in nodes if parent is None or _can_split(tree.sums[i], p)]
                best |= {i: (0.0, -1, 0, tree.sums[i], tree.sums[i]) for i in nodes if i not in able}
                whole = held.pop(parent, None)
                if able:
                    small = min(nodes, key=lambda i: len(inside.of(i)))
                    sums = {small: node_sums(x, columns, inside.of(small), g, packed, bins)}
                    sums |= {i: whole - sums[small] for i in nodes if i != small}
                    asked |= {i: sums[i] for i in able}
            step = max(1, _SEARCHED // (len(columns) * bins))
            for some in (list(asked)[k : k + step] for k in range(0, len(asked), step)):
                found = best_splits(np.stack([asked[i] for i in some], axis=1), every, p)
                best |= {i: (gain, int(columns[f]) if f >= 0 else -1, cut, left, own) for i, (gain, f, cut, left, own) in zip(some, found)}
            held |= {i: sums for i, sums in asked.items() if best[i][1] >= 0}
            new = tree.take(best)
            for i in new:
                for rows in (inside, others):
                    rows.split(i, x[tree.feature[i]], tree.cut[i], tree.left[i])
            families = [(i, (tree.left[i], tree.left[i] + 1)) for i in new if tree.left[i] in tree.waiting]
        done, order = tree.finished(), tree.order()
        trees.append(done)
        for i, feature, value in zip(order, done["feature"], done["value"]):
            if feature < 0:
                for rows in (inside, others):
                    margin[rows.of(i)] += value
    return start, trees, margin


def _can_split(sums: tuple[float, float, int], p: BoostParams) -> bool:
    """Whether both sides of some cut could hold enough rows and Hessian."""
    return sums[2] >= 2 * max(p.min_rows, 1) and sums[1] >= 2 * p.min_hessian


# ---------------------------------------------------------------- on Spark


def bin_edges(rows: DataFrame, columns: list[str], bins: int = 256) -> list[np.ndarray]:
    """Cut points of each column between neighbouring quantiles; bins x columns numbers reach the driver.

    Quantiles come from a mergeable summary of bounded size, exact up to 10,000 rows.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    got = rows.agg(*[F.percentile_approx(number(c), shares, 10_000).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        values = np.unique(np.array(got[c] or [], np.float64))
        out.append((values[1:] + values[:-1]) / 2)
    return out


_BLOCK = "n int, ids binary, label binary, fold binary, x binary"


def blocks(matrix: DataFrame, columns: list[str], edges: list[np.ndarray]) -> DataFrame:
    """The matrix as stored blocks of rows: ids, labels, folds (0 outside development) and one byte for each bin.

    A missing value falls into the lowest bin.
    """
    ship_package(matrix.sparkSession)
    shared = matrix.sparkSession.sparkContext.broadcast(edges)
    rows = matrix.select("id", "label", F.coalesce("fold", F.lit(0)).alias("fold"), *[F.col(c).cast("double") for c in columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, label, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = np.empty((batch.num_rows, len(shared.value)), np.uint8)
            for j, cuts in enumerate(shared.value):
                values = batch.column(3 + j).to_numpy(zero_copy_only=False).astype(np.float64)
                x[:, j] = np.searchsorted(cuts, np.where(np.isnan(values), -np.inf, values))
            packed = [ids.astype(np.int64).tobytes(), label.astype(np.int8).tobytes(), fold.astype(np.int8).tobytes(), x.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *[pa.array([b], pa.binary()) for b in packed]], ["n", "ids", "label", "fold", "x"])

    return materialise(rows.mapInArrow(pack, _BLOCK))


def _opened(batch: pa.RecordBatch | pa.Table, width: int) -> list[tuple[np.ndarray, ...]]:
    names = ("ids", "label", "fold", "x")
    held = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
    out = []
    for ids, label, fold, x in zip(*held):
        out.append((np.frombuffer(ids, np.int64), np.frombuffer(label, np.int8), np.frombuffer(fold, np.int8), np.frombuffer(x, np.uint8).reshape(-1, width)))
    return out


RESULT = "fit int, tree int, node int, feature int, cut int, left int, value double, cover double, threshold double, id long, label int, fold int, margin double"
"""Nodes (tree 0 is the start value) and, with a null tree, the margin of every row."""


def _thresholds(tree: dict[str, np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """The number that each split compares with; not a number in a leaf."""
    return np.array([edges[f][c] if f >= 0 else np.nan for f, c in zip(tree["feature"], tree["cut"])])


def _result(fit: int, start: float, trees: list[dict], parts: list[tuple], edges: list[np.ndarray]) -> pa.Table:
    ints, doubles = pa.int32(), pa.float64()
    nodes = [{"feature": np.array([-1]), "cut": np.array([0]), "left": np.array([-1]), "value": np.array([start]), "cover": np.array([0.0])}, *trees]
    nodes = [t | {"threshold": _thresholds(t, edges)} for t in nodes]
    sizes = [len(t["value"]) for t in nodes]
    ids, label, fold, margin = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4))
    n, m = sum(sizes), len(ids)
    one = lambda k, kind: pa.concat_arrays([pa.array(np.concatenate([t[k] for t in nodes]), kind, safe=False), pa.nulls(m, kind)])
    two = lambda v, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array(v, kind, safe=False)])
    return pa.table(
        {
            "fit": pa.array(np.full(n + m, fit), ints),
            "tree": pa.concat_arrays([pa.array(np.repeat(np.arange(len(nodes)), sizes), ints, safe=False), pa.nulls(m, ints)]),
            "node": pa.concat_arrays([pa.array(np.concatenate([np.arange(s) for s in sizes]), ints, safe=False), pa.nulls(m, ints)]),
            **{k: one(k, ints) for k in ("feature", "cut", "left")},
            **{k: one(k, doubles) for k in ("value", "cover", "threshold")},
            "id": two(ids, pa.int64()),
            "label": two(label, ints),
            "fold": two(fold, ints),
            "margin": two(margin, doubles),
        }
    )


def _seen(fold: np.ndarray, fit: Fit) -> np.ndarray:
    return (fold > 0) & (fold != fit.without)


_ROWS_OUT = 100_000


def _fit_in_tasks(stored: DataFrame, fits: list[Fit], edges: list[np.ndarray], bins: int, rows: int) -> DataFrame:
    """One task for each fit; the matrix is small enough for one, which the caller has checked."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                number, part = batch.column(5)[k].as_py(), _opened(batch.slice(k, 1), width)[0]
                if number not in held:
                    held[number] = [0, np.empty(rows, np.int64), np.empty(rows, np.int8), np.empty(rows, np.int8), np.empty((width, rows), np.uint8)]
                at, ids, label, fold, x = held[number]
                held[number][0] = end = at + len(part[0])
                ids[at:end], label[at:end], fold[at:end], x[:, at:end] = *part[:3], part[3].T
        for number in sorted(held):
            _, ids, label, fold, x = held.pop(number)
            start, trees, margin = boost(x.T, label, ids, _seen(fold, fits[number]), fits[number].params, bins)
            yield from _result(number, start, trees, [], edges).to_batches()
            for a in range(0, rows, _ROWS_OUT):
                part = slice(a, a + _ROWS_OUT)
                yield from _result(number, 0.0, [], [(ids[part], label[part], fold[part], margin[part])], edges).slice(1).to_batches()

    each = stored.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1))))
    return each.repartitionById(len(fits), F.col("fit")).mapInArrow(run, RESULT)


def _fit_in_rounds(stored: DataFrame, fits: list[Fit], first: int, edges: list[np.ndarray], bins: int) -> DataFrame:
    """All fits of a chunk together, one job for each round of growth."""
    spark, width = stored.sparkSession, len(edges)
    counts = stored.sparkSession.sparkContext.broadcast(fits)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(counts.value), 2), np.int64)
        for batch in batches:
            for _, label, fold, _ in _opened(batch, width):
                for k, fit in enumerate(counts.value):
                    seen = _seen(fold, fit)
                    sums[k] += seen.sum(), label[seen].sum(dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"fit": np.arange(len(sums)), "n": sums[:, 0], "y": sums[:, 1]})

    got = stored.mapInArrow(tally, "fit long, n long, y long").groupBy("fit").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    starts = [0.0] * len(fits)
    for r in got:
        share = min(max(r["y"] / r["n"] if r["n"] else 0.5, 1e-6), 1 - 1e-6)
        starts[r["fit"]] = float(np.log(share / (1 - share)))

    def with_margins(state: DataFrame, trees: list[list[dict]], begin: list[float] | None) -> DataFrame:
        """State whose margins include the trees."""
        given = spark.sparkContext.broadcast((trees, begin))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            more, begin_ = given.value
            for batch in batches:
                old = [None] * batch.num_rows if begin_ else batch.column(5).to_pylist()
                new = []
                for (ids, _, _, x), held in zip(_opened(batch, width), old):
                    margin = np.repeat(np.array(begin_)[:, None], len(ids), axis=1) if begin_ else np.frombuffer(held, np.float64).reshape(-1, len(ids)).copy()
                    for k, own in enumerate(more):
                        for tree in own:
                            margin[k] += leaf_values(x, tree)
                    new.append(margin.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary())], ["n", "ids", "label", "fold", "x", "margins"])

        return materialise(state.mapInArrow(add, _BLOCK + ", margins binary"))

    state = with_margins(stored, [[] for _ in fits], starts)
    trees: list[list[dict]] = [[] for _ in fits]
    kept = 0
    for t in range(max(f.params.trees for f in fits)):
        live = [k for k, f in enumerate(fits) if t < f.params.trees]
        grown = {k: Tree(fits[k].params, sampled_columns(width, fits[k].params, t)) for k in live}
        while any(tree.waiting for tree in grown.values()):
            work = {k: (tree, trees[k][kept:]) for k, tree in grown.items() if tree.waiting}
            for k, best in _round(state, fits, work, t, width, bins).items():
                grown[k].take(best)
        for k, tree in grown.items():
            trees[k].append(tree.finished())
        if t + 1 - kept == TREES_REPLAYED:
            state, kept = with_margins(state, [own[kept:] for own in trees], None), t + 1
    state = with_margins(state, [own[kept:] for own in trees], None)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids, label, fold, _), held in zip(_opened(batch, width), batch.column(5).to_pylist()):
                margin = np.frombuffer(held, np.float64).reshape(-1, len(ids))
                for k in range(len(margin)):
                    table = _result(first + k, 0.0, [], [(ids, label, fold, margin[k])], edges)
                    yield from table.slice(1).to_batches()

    nodes = pa.concat_tables([_result(first + k, starts[k], trees[k], [], edges) for k in range(len(fits))])
    # trees x leaves rows of a model, which its settings bound
    return spark.createDataFrame(nodes, RESULT).union(state.mapInArrow(scores, RESULT))


def _partial(tree: Tree) -> dict[str, np.ndarray]:
    """A tree that still grows, for moving rows to the nodes it has so far."""
    return {"feature": np.array([f if a >= 0 else -1 for f, a in zip(tree.feature, tree.left)]), "cut": np.array(tree.cut), "left": np.array(tree.left), "value": np.arange(len(tree.feature), dtype=np.float64)}


def _round(state: DataFrame, fits: list[Fit], work: dict[int, tuple[Tree, list[dict]]], t: int, width: int, bins: int) -> dict[int, dict[int, tuple]]:
    """Best split of every waiting node of every fit: one job."""
    sent = {k: (fits[k], _partial(tree), tree.waiting, done, tree.columns) for k, (tree, done) in work.items()}
    shared = state.sparkSession.sparkContext.broadcast(sent)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for (ids, label, fold, x), margins in zip(_opened(batch, width), batch.column(5).to_pylist()):
                offsets = x.astype(np.int32) + np.arange(width, dtype=np.int32) * bins
                margins = np.frombuffer(margins, np.float64).reshape(-1, len(ids))
                for k, (fit, partial, waiting, done, _) in shared.value.items():
                    margin = margins[k].copy()
                    for tree in done:
                        margin += leaf_values(x, tree)
                    g, h = gradients(margin, label)
                    slot_of = np.full(len(partial["feature"]), -1)
                    slot_of[waiting] = np.arange(len(waiting))
                    node = leaf_values(x, partial).astype(np.int64)
                    used = _seen(fold, fit) & sampled_rows(ids, fit.params, t)
                    one = histogram(offsets, np.where(used, slot_of[node], -1), g, h, len(waiting), width, bins)
                    held[k] = held[k] + one if k in held else one
        for k, one in held.items():
            slot, feature, b = np.nonzero(one[2])
            waiting = np.array(shared.value[k][2])
            columns = [np.full(len(slot), k), waiting[slot], feature, b, *[one[j][slot, feature, b].astype(np.int64) for j in range(3)]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["fit", "node", "feature", "bin", "g", "h", "n"])

    def search(group: pa.Table) -> pa.Table:
        k, node = group.column("fit")[0].as_py(), group.column("node")[0].as_py()
        one = np.zeros((3, 1, width, bins))
        f, b = (group.column(c).to_numpy() for c in ("feature", "bin"))
        for j, name in enumerate(("g", "h", "n")):
            one[j, 0, f, b] = group.column(name).to_numpy()
        fit, _, _, _, columns = shared.value[k]
        gain, feature, cut, left, own = best_splits(one, columns, fit.params)[0]
        values = {"fit": k, "node": node, "gain": gain, "feature": feature, "cut": cut, "left": [float(v) for v in left], "own": [float(v) for v in own]}
        return pa.table({name: [v] for name, v in values.items()})

    cells = state.mapInArrow(sums, "fit long, node long, feature long, bin long, g long, h long, n long")
    total = cells.groupBy("fit", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    found = total.groupBy("fit", "node").applyInArrow(search, "fit long, node long, gain double, feature long, cut long, left array<double>, own array<double>")
    out: dict[int, dict[int, tuple]] = {k: {i: (0.0, -1, 0, (0.0, 0.0, 0), (0.0, 0.0, 0)) for i in tree.waiting} for k, (tree, _) in work.items()}
    for r in found.collect():  # one row for each waiting node
        out[r["fit"]][r["node"]] = (r["gain"], r["feature"], r["cut"], tuple(r["left"]), tuple(r["own"]))
    return out


@dataclass(frozen=True)
class Boosted:
    """Fitted models: names by number, feature columns, cut points, and the stored table of nodes and margins."""

    fits: list[Fit]
    columns: list[str]
    edges: list[np.ndarray]
    table: DataFrame

    def nodes(self) -> DataFrame:
        return self.table.filter("tree IS NOT NULL").drop("id", "label", "fold", "margin").withColumn("threshold", F.nanvl("threshold", F.lit(None).cast("double")))

    def scores(self) -> DataFrame:
        """(model, without, id, label, fold, score) of every row under every fit."""
        names = F.array(*[F.lit(f.name) for f in self.fits])
        without = F.array(*[F.lit(f.without) for f in self.fits])
        return self.table.filter("tree IS NULL").select(
            F.get(names, F.col("fit")).alias("model"),
            F.get(without, F.col("fit")).alias("without"),
            "id",
            "label",
            "fold",
            (1.0 / (1.0 + F.exp(-F.col("margin")))).alias("score"),
        )


def fit_models(matrix: DataFrame, columns: list[str], fits: list[Fit], bins: int = 256, task_cells: int = TASK_CELLS) -> Boosted:
    """Fit every model on the development rows (those with a fold) of a complete matrix; all rows get margins."""
    edges = bin_edges(matrix.filter("fold IS NOT NULL"), columns, bins)
    stored = blocks(matrix, columns, edges)
    used = max((len(e) + 1 for e in edges), default=1)
    rows = stored.agg(F.sum("n")).first()[0] or 0
    if rows * (len(columns) + ROW_STATE) <= task_cells:
        table = _fit_in_tasks(stored, fits, edges, used, rows)
    else:
        wide = stored.repartition(shuffle_width(stored.sparkSession))
        parts = [_fit_in_rounds(wide, fits[i : i + FITS_AT_ONCE], i, edges, used) for i in range(0, len(fits), FITS_AT_ONCE)]
        table = parts[0]
        for part in parts[1:]:
            table = table.union(part)
    return Boosted(fits, columns, edges, materialise(table))
