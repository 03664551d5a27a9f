"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document is its set of word shingles. Equal sets become one class. A class has a signature of
``positions`` MinHash values of 16 bits. The signature is cut into chunks; by the pigeonhole
principle, two signatures that differ in at most ``guaranteed`` positions differ in at most ``errors``
positions of some chunk. Every choice of that many positions of a chunk is left out once, and what
remains is a key: two classes that share a key are candidates, and no pair within the distance is
missed. Most pairs beyond it are found as well, since a pair fails only if every chunk has more errors.

Candidates are compared in stars first: a class meets the most central of those it shares a key with, and a random
one. Components that still share a key are then compared as wholes: the classes of the larger one and all that
is left over around it are dealt to a grid of blocks, in which every class meets every other and one link for each is kept. So
a group of many near copies never becomes all its pairs. Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.frames import slices, texts
from holdfast.session import materialise

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


SHINGLE_BYTES = 1_000_000
"""Text whose shingles are worked out at once: each byte costs about 60."""


class Params(NamedTuple):
    """Shingle words, similarity in percent, and the shape of the signature."""

    words: int = 5
    percent: int = 80
    chunks: int = 10
    width: int = 6
    errors: int = 1
    far: int = 30
    """Candidates that differ in more positions are dropped: at the similarity the mean is 12 and 30 is 6 deviations off."""

    @property
    def positions(self) -> int:
        return self.chunks * self.width

    @property
    def guaranteed(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=_U)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Shingler:
    """64-bit hashes of the word shingles of many texts at once.

    A word's hash is a polynomial in a fixed odd base over random values of its bytes, taken from one
    running sum over all bytes; A-Z count as a-z.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: int):
        self.words = words
        self.value = _random(256, 7)
        self.value[65:91] = self.value[97:123]
        self.weight = _random(words, 11) | _U(1)
        self.up = self.down = np.ones(1, dtype=_U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, self.BASE, dtype=_U)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = pow(self.BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down

    def sets(self, texts_: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        raw = [t.encode() for t in texts_]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        up, down = self._powers(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(self.value[data] * down[: len(data)], out=sums[1:])
        word = _mixed((sums[last] - sums[first]) * up[first] + (last - first).astype(_U))
        ends = np.searchsorted(first, np.cumsum([len(x) + 1 for x in raw]) + 1)
        out, start = [], 0
        for end in ends.tolist():
            w = word[start:end]
            n = min(self.words, len(w))
            if n:
                shingle = np.zeros(len(w) - n + 1, dtype=_U)
                for k in range(n):
                    shingle += w[k : len(w) - n + 1 + k] * self.weight[k]
                w = np.unique(_mixed(shingle + _U(n)))
            out.append(w)
            start = end
        return out


_FOLD = _random(2, 13) | _U(1)


def _set_hash(shingles: np.ndarray) -> list[np.int64]:
    """Two halves of a hash of a set."""
    return [_mixed(shingles * f).sum(dtype=_U).view(np.int64) for f in _FOLD]


def class_id() -> Column:
    """One number for a class of equal sets."""
    return F.xxhash64("h1", "h2", "n_shingles")


def signature(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each of the hash functions, 16 bits of the smallest hash of a non-empty set."""
    least = np.full(len(multiply), np.iinfo(_U).max, dtype=_U)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096] ^ add[:, None]) * multiply[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (_mixed(least) & _U(0xFFFF)).astype(np.uint16)


def signatures(df: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hash of the text, n_shingles, two halves of the set's hash, the signature, and the low four bits of its positions as bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, k = Shingler(p.words), p.positions
        multiply, add = _random(k, 3) | _U(1), _random(k, 5)
        bit = _U(1) << np.arange(k, dtype=_U)
        for batch in batches:
            for part in slices(batch, "text", SHINGLE_BYTES):
                size, whole, sig, planes = [], [], [], []
                for s in shingler.sets(part.column("text").to_pylist()):
                    size.append(len(s))
                    whole.append(_set_hash(s))
                    values = signature(s, multiply, add) if len(s) else np.zeros(k, dtype=np.uint16)
                    sig.append(values.tobytes())
                    planes.append([bit[(values >> b & 1) > 0].sum(dtype=_U).view(np.int64) for b in range(4)])
                halves, low = np.array(whole).reshape(-1, 2), np.array(planes).reshape(-1, 4)
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array(size, pa.int64()), *map(pa.array, halves.T.copy())]
                columns += [pa.array(sig, pa.binary()), *map(pa.array, low.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig", "p0", "p1", "p2", "p3"]
    rows = texts(df, key, text).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, h1 long, h2 long, sig binary, p0 long, p1 long, p2 long, p3 long")


def shingle_sets(df: DataFrame, sought: DataFrame, words: int) -> DataFrame:
    """``rep`` (class) and the sorted distinct shingle hashes of the classes in ``sought`` (doc_id, rep), each once.

    A bitmap of a fixed size tells most other rows apart before their texts are read, let alone shuffled.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
    marks = sought.select(slot).groupBy(F.expr("slot div 32").alias("at"))
    marks = marks.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 AS int)))").alias("bits"))
    got = marks.toPandas()  # SLOTS / 32 rows at most
    bitmap = np.zeros(SLOTS // 32, dtype=np.int64)
    bitmap[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            held = batch.filter(pa.array((shared.value[slots // 32] >> (slots % 32) & 1).astype(bool)))
            for part in slices(held, "text", SHINGLE_BYTES):
                sets = shingler.sets(part.column("text").to_pylist())
                halves = np.array([_set_hash(x) for x in sets], np.int64).reshape(-1, 2)
                listed = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                columns = [part.column("doc_id"), *map(pa.array, halves.T.copy()), pa.array([len(x) for x in sets], pa.int64()), listed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n_shingles", "shingles"])

    kind = df.schema["doc_id"].dataType.simpleString()
    some = df.select("doc_id", "text", slot).mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, n_shingles long, shingles array<long>")
    some = some.select(class_id().alias("rep"), "shingles").join(sought.select("rep"), "rep", "left_semi")
    return some.groupBy("rep").agg(F.first("shingles").alias("shingles"))


SLOTS = 1 << 24
"""Bits of the map of sought documents: two megabytes, whatever their number."""

BLOCK = 512
"""Classes on either side of a block."""

GRID = 4096
"""Rows of a key that one task pairs with each other; those of a more frequent key are dealt to a grid of such parts."""

FEW = 16
"""Pairs of components with at most so many classes share tasks with others."""


def _chunk(sig: str, p: Params) -> str:
    """Of a signature the chunk that key ``k`` reads; the positions that this key leaves out are zero.

    One short expression for all keys: written out for each of them, planning and compiling it took 150 MB of the driver.
    """
    variants, size = comb(p.width, p.errors), 2 * p.width
    chunk = f"substring({sig}, {size} * cast(k div {variants} AS int) + 1, {size})"
    for gone in zip(*combinations(range(p.width), p.errors), strict=True):
        chunk = f"overlay({chunk} PLACING X'0000' FROM array({', '.join(str(2 * i + 1) for i in gone)})[k % {variants}])"
    return chunk


def _every_key(p: Params) -> str:
    return f"sequence(0, {p.chunks * comb(p.width, p.errors) - 1})"


def chunk_keys(p: Params) -> Column:
    """All keys of a signature: each chunk with each choice of ``errors`` positions left out."""
    return F.expr(f"transform({_every_key(p)}, k -> xxhash64(k, {_chunk('sig', p)}))")


def _sign_differences(a: str, b: str) -> str:
    """Positions that differ in their low four bits: never more than differ at all."""
    return "bit_count(" + " | ".join(f"({a}p{i} ^ {b}p{i})" for i in range(4)) + ")"


def _close(p: Params) -> str:
    """What any pair of similar sets meets: sizes near enough, signatures not far apart."""
    sizes = f"a_n * 100 >= b_n * {p.percent} AND b_n * 100 >= a_n * {p.percent}"
    return f"{sizes} AND {_sign_differences('a_', 'b_')} <= {p.far}"


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(
        F.col("rep").alias(side), F.col("n_shingles").alias(f"{side}_n"), *[F.col(f"p{i}").alias(f"{side}_p{i}") for i in range(4)]
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) whose full sets are similar; the sets go to the side of b, of which there are fewer."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_sb")).join(pairs.select("b").distinct(), "b", "left_semi")
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select(
        "a", "b", F.size("_sa").alias("_na"), F.size("_sb").alias("_nb"), F.size(F.array_intersect("_sa", "_sb")).alias("_both")
    ).filter(f"100 * _both >= {p.percent} * (_na + _nb - _both)").select("a", "b")


def _stars(rows: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """For each class at most two candidates it shares a key with: the one with most company, and a random one."""
    central = rows.groupBy("rep").agg(F.sum("_n").alias("_score"))
    scored = rows.select("key", "rep").join(central, "rep")
    best, chance = F.struct("_score", "rep"), F.struct(F.xxhash64("rep", F.lit("star")).alias("_h"), "rep")
    centres = scored.groupBy("key").agg(F.max(best).alias("_best"), F.max(chance).alias("_chance"))
    met = rows.select("key", "rep").join(centres, "key").groupBy("rep").agg(F.max("_best").alias("_best"), F.max("_chance").alias("_chance"))
    pairs = met.select(F.col("rep").alias("a"), F.explode(F.array("_best.rep", "_chance.rep")).alias("b")).filter("a <> b").distinct()
    return pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").filter(_close(p)).select("a", "b")


def _first_key(p: Params) -> str:
    """True if a_k is the first of the keys that signatures a_sig and b_sig share, so that a pair shows up once."""
    return f"NOT exists({_every_key(p)}, k -> k < a_k AND {_chunk('a_sig', p)} = {_chunk('b_sig', p)})"


def _leftover(rows: DataFrame, classes: DataFrame, label: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) that connect all components which share a key and may hold a link.

    Each key pairs its largest component with the others; two of one class each are a pair only if their signatures are
    near enough. What these stars leave apart, of one class each, is then paired one by one: a pair shows up once, and only if
    its signatures are near enough.
    """
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    placed = rows.select("key", "k", "rep").join(label.withColumnRenamed("node", "rep"), "rep")
    live = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi")
    placed = placed.join(live.select("key"), "key").join(sizes, "component")
    placed = materialise(placed.select("key", "k", "rep", "component", "_size"))
    best = F.max(F.struct("_size", "component")).alias("_top")
    tops = placed.groupBy("key").agg(best).select("key", F.col("_top._size").alias("_of"), F.col("_top.component").alias("b"))
    met = placed.select("key", F.col("component").alias("a")).join(tops, "key").filter("a <> b").groupBy("a", "b").agg(F.max("_of").alias("_of"))
    # a component of one class is called after it
    single = met.filter("_of = 1").join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").filter(_close(p))
    stars = materialise(met.filter("_of > 1").select("a", "b").union(single.select("a", "b")))
    family = components(stars, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("family"))
    ones = placed.filter("_size = 1").join(family, "component", "left").withColumn("family", F.coalesce("family", "component"))
    ends = [F.min("family").alias("_lo"), F.max("family").alias("_hi"), F.count(F.lit(1)).alias("_m")]
    live = ones.groupBy("key").agg(*ends).filter("_lo < _hi")
    about = classes.select("rep", "n_shingles", "sig", "p0", "p1", "p2", "p3")
    live = live.select("key", F.ceil(F.col("_m") / GRID).cast("int").alias("_b"))
    ones = ones.join(live, "key").join(about, "rep").withColumnRenamed("n_shingles", "n")
    shown = ("component", "family", "k", "sig", "n", "p0", "p1", "p2", "p3")
    # the rows of a frequent key are dealt to a grid, so that no task pairs more than a block with a block
    own, every = F.pmod(F.xxhash64("rep"), F.col("_b")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    one, two = (
        ones.select("key", "_b", *[F.col(c).alias(f"{x}_{c}") for c in shown], own.alias(mine)).withColumn(other, every)
        for x, mine, other in (("a", "_i", "_j"), ("b", "_j", "_i"))
    )
    near = f"a_component < b_component AND a_family <> b_family AND {_close(p)} AND {_first_key(p)}"
    pairs = one.join(two.drop("_b"), ["key", "_i", "_j"]).filter(near).select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    return stars.union(pairs)


def _block_links(pairs: DataFrame, label: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between classes of different components of a cluster, at least one for any two that are linked."""
    clusters = components(pairs, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    rows = materialise(label.join(clusters, "component").select("cluster", "component", F.col("node").alias("rep")))
    counts = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("cluster").agg(
        F.sum("n").alias("_m"), F.max(F.struct("n", "component")).alias("_top")
    ).select("cluster", "_m", (F.col("_m") - F.col("_top.n")).alias("_t"), F.col("_top.component").alias("_top"))
    shared = max(1, rows.count() // 256)
    blocks = {"_bm": f"cast(ceil(_m / {BLOCK}) AS int)", "_bt": f"cast(ceil(_t / {BLOCK}) AS int)"}
    blocks["task"] = f"if(_m <= {FEW}, pmod(xxhash64(cluster), {shared}), -1)"
    placed = rows.join(largest.withColumns({k: F.expr(e) for k, e in blocks.items()}), "cluster")
    place = """concat(
        transform(sequence(0, _bt - 1), x -> struct(true AS member, cast(pmod(xxhash64(rep), _bm) AS int) AS i, x AS j)),
        if(component = _top, array(),
            transform(sequence(0, _bm - 1), x -> struct(false AS member, x AS i, cast(pmod(xxhash64(rep, 1), _bt) AS int) AS j))))"""
    dealt = placed.select("cluster", "component", "rep", "task", F.expr(f"inline({place})"))
    whole = dealt.join(sets, "rep").withColumn("owner", F.expr("if(task < 0, cluster, NULL)"))
    kind = label.schema["node"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        found: tuple[list, list] = ([], [])
        table = table.combine_chunks().sort_by("cluster")
        owner = table.column("cluster").to_numpy()
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for start, end in zip(edges, np.append(edges[1:], len(owner)), strict=True):
            part = table.slice(start, end - start)
            member, rep, component = (part.column(c).to_numpy() for c in ("member", "rep", "component"))
            held = [x.values.to_numpy() for x in part.column("shingles")]
            for a, b in similar(held, component, np.flatnonzero(member), np.flatnonzero(~member), p.percent):
                found[0].append(rep[a])
                found[1].append(rep[b])
        return pa.table({"a": pa.array(found[0], table.schema.field("rep").type), "b": pa.array(found[1], table.schema.field("rep").type)})

    return whole.groupBy("task", "owner", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def similar(
    sets: list[np.ndarray], component: np.ndarray, members: np.ndarray, others: np.ndarray, percent: int
) -> Iterator[tuple[int, int]]:
    """For each of ``others`` and each other component with ``members`` similar to it: itself and the first of these."""
    if not len(members) or not len(others):
        return
    size = np.array([len(sets[m]) for m in members])
    values = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for t in others:
        left, right = np.searchsorted(values, sets[t]), np.searchsorted(values, sets[t], side="right")
        n = right - left
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(members))
        hit = members[100 * both >= percent * (size + len(sets[t]) - both)]
        hit = hit[component[hit] != component[t]]
        for m in np.unique(component[hit], return_index=True)[1]:
            yield t, hit[m]


def near_duplicates(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest key reachable by links), ``kept`` and ``text_hash`` of every row.

    Two rows are linked if 100 x intersection >= percent x union of their shingle sets. A text with fewer
    words than a shingle is one shingle of all its words; one without words, an empty or a null text has no
    shingle and is linked with nothing. Rows with equal keys but different texts are judged by their own texts; rows with
    null keys are linked with nothing. Texts of any length are read whole. Other columns are not read.
    """
    signed = materialise(signatures(df, p, key, text))
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = ["h1", "h2", "n_shingles"]
    shape = [F.first(c).alias(c) for c in ("sig", "p0", "p1", "p2", "p3")]
    classes = some.groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), *shape)
    classes = materialise(classes.withColumn("rep", class_id()))
    keyed = classes.select("rep", F.posexplode(chunk_keys(p)).alias("k", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = materialise(keyed.join(shared, "key"))  # (key, rep, k, _n) of keys with company
    company = materialise(classes.join(rows.select("rep").distinct(), "rep", "left_semi").select("doc_id", "rep"))
    sets = materialise(shingle_sets(texts(df, key, text), company, p.words))
    links = materialise(_confirmed(_stars(rows, classes, p), sets, p))
    alone = company.select(F.col("rep").alias("node"))
    label = _labels(alone, links)
    rest = _block_links(_leftover(rows, classes, label, p), label, sets, p)
    # what the blocks found joins components of the stars, so only these are walked again
    between = rest.join(label.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
    between = between.join(label.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    over = components(between, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    label = label.join(over, "component", "left").select(F.col("node").alias("rep"), F.coalesce("whole", "component").alias("component"))
    placed = classes.select(*equal, "rep", "doc_id").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("_component"))
    found = placed.join(least, "component").select(*equal, "_component")
    out = signed.select("doc_id", "text_hash", *equal).join(found, equal, "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component"))
    component = F.coalesce(own, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash"
    )


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The component of every node, itself if no link touches it."""
    joined = components(links, "a", "b")
    return materialise(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
