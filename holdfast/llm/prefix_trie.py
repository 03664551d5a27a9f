"""Trie of conversation prefixes: who shares which beginning, and what sharing saves.

A prefix is known by the exclusive-or of 128-bit hashes of its turns, each hashed with its depth; it runs along ranges of turns,
so that a long conversation is no single task's work. Nodes are the distinct prefixes. Their owner is their smallest
conversation: a conversation owns the nodes of its path from some depth on.

Subtree totals come from shards of conversations. A shard lists its distinct prefixes, gives each a slot by a minimal perfect
hash whose slots are checked against the full digest, scatters its counts into flat arrays and accumulates them through the array
of parent slots, deepest first. A node's totals are the sums of its totals in all shards, because what a
conversation adds to its ancestors does not depend on other conversations once the owners are known.

A conversation longer than ``SEGMENT`` turns is cut into segments that may lie in different shards; the totals of its later segments
enter at the last turn of each earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.ordered_scan import running
from holdfast.session import materialise, shuffle_width

SEGMENT = 4096
"""Turns of a conversation that lie in one shard."""
SHARD_ROWS = 200_000
"""Turns that a shard holds on average."""
_WORD = r"[^\x20\x09-\x0D]+"


def _digest(first: int, *columns: str) -> Column:
    """60 bits of a SHA-256 from hexadecimal digit ``first`` on; lengths keep neighbouring texts apart."""
    parts = [x for c in columns for x in (F.octet_length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), first, 15), 16, 10).cast("long")


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (1-based), two digests and the number of words of each turn.

    Turns are ordered by turn (null first), then role and text; a null role or text is empty; rows without a conversation are
    left out; repeated rows are turns of their own.
    """
    rows = turns.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    keep = [_digest(1, "role", "text").alias("t1"), _digest(16, "role", "text").alias("t2"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words")]
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return running(rows, "conv_id", order, (), keep).withColumnRenamed("_n", "pos")


def spliced(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Numbered turns after every conversation took over the head of its block's first one, and all conversation ids.

    Conversation c begins with the first h turns of conversation c - c % block (fewer if that has fewer, none if it is
    absent), h = crc32(c) % heads; its own turns after its first h follow.
    """
    turns = materialise(turns)
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % block})
    first = turns.filter((F.col("conv_id") % block == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("head"))
    convs = convs.join(first, "base", "left")
    taken = F.when(F.col("head").isNull() | (F.col("h") == 0), 0).otherwise(F.least("h", F.size("head")))
    convs = materialise(convs.withColumn("k", taken.cast("long")).select("conv_id", "h", "k", "head"))
    new = convs.filter("k > 0").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("k").cast("int"))).alias("t"))
    new = new.select("conv_id", "t.pos", "t.t1", "t.t2", "t.words")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t1", "t2", "words")
    return new.union(own), convs.select("conv_id")


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests: n keys, slots 0 to n - 1; a slot remembers its digest.

    Each level hashes the keys left over to twice as many places; keys alone in their place get the next free slots.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.one, self.two = np.empty_like(one), np.empty_like(two)
        left, used = np.arange(len(one)), 0
        while len(left):
            at = self._at(one[left], two[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            slots = np.cumsum(alone) - 1 + used
            self.levels.append((alone, slots))
            hit = alone[at]
            self.one[slots[at[hit]]], self.two[slots[at[hit]]] = one[left[hit]], two[left[hit]]
            used += int(alone.sum())
            left = left[~hit]

    @staticmethod
    def _at(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = one.astype(np.uint64) ^ (two.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0x632BE59BD9B4E019 & (2**64 - 1))
            for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for one that is not in the table."""
        out = np.full(len(one), -1, np.int64)
        left = np.arange(len(one))
        for level, (alone, slots) in enumerate(self.levels):
            at = self._at(one[left], two[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = slots[at[hit]]
            left = left[~hit]
        known = np.flatnonzero(out >= 0)
        at = out[known]
        out[known[(self.one[at] != one[known]) | (self.two[at] != two[known])]] = -1
        return out


_SHARD = ("d1", "d2", "p1", "p2", "depth", "words", "own", "leaf", "up_all", "up_own", "up_leaf")


def shard_totals(columns: dict[str, np.ndarray], segment: int = SEGMENT) -> dict[str, np.ndarray]:
    """Per distinct prefix of a shard: its conversations here, and subtree sums of words, owned words and leaves."""
    keys = np.unique(np.stack([columns["d1"], columns["d2"]], axis=1), axis=0)
    table = SlotTable(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
    slot = table.slots(columns["d1"], columns["d2"])
    n = len(keys)
    depth, parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    depth[slot] = columns["depth"]
    # the first turn of a later segment hands nothing up: its conversation's earlier segment knows its totals
    inner = (columns["depth"] > 0) & ((columns["depth"] == 1) | ((columns["depth"] - 1) % segment != 0))
    parent[slot[inner]] = table.slots(columns["p1"][inner], columns["p2"][inner])
    counts = {"n_convs": np.ones(len(slot), np.int64), "all": columns["words"] + columns["up_all"]}
    counts |= {"own": columns["own"] + columns["up_own"], "leaves": columns["leaf"] + columns["up_leaf"]}
    out = {}
    for name, values in counts.items():
        out[name] = np.zeros(n, np.int64)
        np.add.at(out[name], slot, values)
    order = np.argsort(-depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    for level in levels:
        level = level[parent[level] >= 0]
        for name in ("all", "own", "leaves"):
            np.add.at(out[name], parent[level], out[name][level])
    return {"d1": table.one, "d2": table.two, **out}


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node: one pass over sorted ids, none is held."""
    width = shuffle_width(rows.sparkSession)
    spread = rows.repartition(width, "d1", "d2").sortWithinPartitions("d1", "d2", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = {"d1": [], "d2": [], "ends_sha256": []}
            for one, two, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (one, two) != at:
                    if state is not None:
                        for name, value in zip(done, (*at, state.hexdigest())):
                            done[name].append(value)
                    at, state = (one, two), hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_pydict(done, pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())]))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"d1": [at[0]], "d2": [at[1]], "ends_sha256": [state.hexdigest()]})

    return spread.mapInArrow(run, "d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Node table of numbered turns (``numbered_turns``) of all conversations in ``convs`` (conv_id), turnless ones too.

    One row for each distinct sequence of first turns: digest (``d1``, ``d2``), conv_id (smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Without conversations there is no node.
    Two prefixes with one digest but another depth, parent or turn stop the job.
    """
    salted = [F.xxhash64("pos", "t1", "t2").alias("d1"), F.xxhash64("t2", "pos", "t1").alias("d2")]
    steps = turns.select("conv_id", "pos", "t1", "t2", "words", *salted)
    keep = [F.col("pos").alias("depth"), F.col("words"), F.col("d1").alias("e1"), F.col("d2").alias("e2")]
    run = running(steps, "conv_id", [F.col("pos").asc()], ("d1", "d2"), keep).drop("_n")
    none = F.lit(0).cast("long")
    root = convs.distinct().select("conv_id", *[none.alias(c) for c in ("d1", "d2", "depth", "words", "p1", "p2")])
    walked = run.select("conv_id", "d1", "d2", "depth", "words", F.col("d1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("e2")).alias("p2"))
    paths = materialise(walked.union(root))
    mark = F.xxhash64("depth", "words", "p1", "p2")
    firsts = [F.min(c).alias(c) for c in ("words", "p1", "p2")]
    nodes = paths.groupBy("d1", "d2").agg(F.min("conv_id").alias("owner"), F.min("depth").alias("_d"), F.min(mark).alias("_a"), F.max(mark).alias("_b"), *firsts)
    clash = F.raise_error(F.lit("two prefixes share a digest")).cast("long")
    nodes = materialise(nodes.withColumn("depth", F.when(F.col("_a") == F.col("_b"), F.col("_d")).otherwise(clash)).drop("_d", "_a", "_b", "words"))
    above = nodes.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(above, ["d1", "d2"], "left").fillna(0, ["n_children"]))
    chains = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    lengths = paths.groupBy("conv_id").agg(F.max("depth").alias("length"))
    known = lengths.join(chains, "conv_id", "left")
    rows = paths.join(known, "conv_id").withColumns(
        {
            "segment": F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / segment),
            "own": F.when(F.col("depth") >= F.col("owned"), F.col("words")).otherwise(0),
            "leaf": F.when(F.col("depth") == F.col("length"), F.coalesce("leaf", F.lit(0))).otherwise(0),
        }
    )
    rows = materialise(rows)
    is_long = F.col("length") > segment
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.filter(is_long).groupBy("conv_id", "segment").agg(F.sum("words").alias("a"), F.sum("own").alias("o"), F.sum("leaf").alias("l"))
    pieces = pieces.select("conv_id", "segment", *[F.coalesce(F.sum(c).over(later), none).alias(f"up_{n}") for c, n in (("a", "all"), ("o", "own"), ("l", "leaf"))])
    last = F.col("depth") == (F.col("segment") + 1) * segment
    ups = ("up_all", "up_own", "up_leaf")
    cut = rows.filter(is_long).join(pieces, ["conv_id", "segment"]).withColumns({c: F.when(last, F.col(c)).otherwise(none) for c in ups})
    whole = rows.filter(~is_long).withColumns({c: none for c in ups})
    shards = rows.count() // shard_rows + 1
    dealt = whole.unionByName(cut).select(F.pmod(F.xxhash64("conv_id", "segment"), F.lit(shards)).alias("shard"), *_SHARD)

    def total(group: pa.Table) -> pa.Table:
        return pa.table(shard_totals({c: group.column(c).to_numpy().astype(np.int64, copy=False) for c in _SHARD}, segment))

    local = dealt.groupBy("shard").applyInArrow(total, "d1 long, d2 long, n_convs long, all long, own long, leaves long")
    totals = local.groupBy("d1", "d2").agg(*[F.sum(c).alias(c) for c in ("n_convs", "all", "own", "leaves")])
    ends = _ends(rows.filter("depth = length").select("d1", "d2", "conv_id"))
    # a parent with very many children is a long run of the left side, which adaptive execution splits
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    out = nodes.join(parents, ["p1", "p2", "depth"], "left").join(totals, ["d1", "d2"]).join(ends, ["d1", "d2"], "left")
    return out.select(
        "d1",
        "d2",
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("all") - F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **sizes: int) -> DataFrame:
    """``trie`` of the conversations of a table as they are."""
    rows = materialise(numbered_turns(turns, conv, turn, role, text))
    return trie(rows, rows.select("conv_id"), **sizes)
