"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from holdfast.llm import prefix_trie as pt
from holdfast.llm import queries
from holdfast.llm.frames import ship_package
from holdfast.llm.ordered_scan import running

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def with_heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    rows = []
    for node, mine in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in mine if len(convs[c]) == len(node)))
        saved = sum((len(members[u]) - 1) * (words(u[-1][1]) if u else 0) for u in below[node])
        rows.append(
            (min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), kids[node], sum(kids[u] == 0 for u in below[node]), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


def test_query_equals_brute_force(shipped):
    rows = [tuple(r) for r in shipped.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_prefix_trie(shipped, SF)) == plain(with_heads(ordered(rows)))


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(c, int(d), ("user", "assistant", None)[int(rng.integers(3))], ("a b", "", None, "b  c\t d", "é")[int(rng.integers(5))]) for c in range(45) if c not in (20,) for d in range(int(rng.integers(0, 6)))]
    rows += [(40, None, "user", "first"), (40, None, "user", "first"), (None, 1, "user", "x"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (29, 0, "user", "only"), (60, 0, None, None)]
    return rows + [(100 + c, d, "user", "same words here") for c in range(30) for d in range(4)]


def test_nulls_ties_and_copies(shipped):
    df = shipped.createDataFrame(odd_rows(), SCHEMA).withColumn("d1", pt.F.lit(1)).withColumn("words", pt.F.lit("x")).withColumn("_part", pt.F.lit(2))
    assert got(pt.prefix_trie(df)) == plain(ordered(odd_rows()))
    turns, convs = pt.spliced(pt.numbered_turns(df))
    assert got(pt.trie(turns, convs)) == plain(with_heads(ordered(odd_rows())))


def test_empty_table(shipped):
    assert pt.prefix_trie(shipped.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversations_in_segments(shipped):
    """Short segments over many shards give the totals of whole conversations."""
    rows = [(1, d, "user", f"w{d} x") for d in range(23)] + [(2, d, "user", f"w{d} x") for d in range(11)]
    rows += [(3, d, "user", f"w{d} x" if d < 17 else "other") for d in range(30)] + [(4, 0, "user", "lone")]
    df = shipped.createDataFrame(rows, SCHEMA)
    assert got(pt.prefix_trie(df, segment=5, shard_rows=7)) == plain(ordered(rows))


def test_slot_table_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    one, two = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 5000)
    one[:50] = 7  # equal first halves are told apart by the second
    table = pt.SlotTable(one, two)
    slots = table.slots(one, two)
    assert sorted(slots) == list(range(5000))
    assert (table.slots(one, two + 1) == -1).all()
    assert len(pt.SlotTable(one[:0], two[:0]).slots(one, two)) == 5000


def test_running_positions_cross_partitions(shipped):
    """A key with most rows spreads over the ranges and is still numbered in order."""
    df = shipped.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id % 7 ELSE 5 END AS k", "id AS o", "id * 7919 AS e")
    out = running(df, "k", [pt.F.col("o").asc()], ("e",), [pt.F.col("o")]).collect()
    seen = defaultdict(list)
    for r in sorted(out, key=lambda r: r["o"]):
        seen[r["k"]].append(r)
    for rows in seen.values():
        x = 0
        for i, r in enumerate(rows):
            x ^= r["o"] * 7919
            assert (r["_n"], r["e"]) == (i + 1, x)
