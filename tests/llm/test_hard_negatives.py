"""Hard negatives against a plain search, and the bounds of the scan."""

import numpy as np
import pytest

from holdfast.llm import hard_negatives as hn
from holdfast.llm import queries
from holdfast.llm.frames import ship_package

SF = "/root/testdata/sf0.001"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, label int, vector array<long>"


def plain(rows, anchors, p=hn.Params()):
    rows = [r for r in rows if None not in r]
    out = []
    for a, label, v in {(a, lab, tuple(x)) for a, lab, x in anchors if None not in (a, lab, x)}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in rows if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label][: p.positives]:
            fits = [x for x in scored if x[2] != label and p.low * -s <= 100 * -x[0] <= p.high * -s]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits[: p.negatives])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


def test_query_equals_brute_force(shipped):
    rows = []
    for r in shipped.read.parquet(f"{SF}/embeddings.parquet").collect():
        v = [int(np.floor(256 * np.float64(np.float32(x)))) for x in r["embedding"]]
        rows.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], v))
    assert got(queries.op12_bond_hard_negatives(shipped, SF)) == plain(rows, [r for r in rows if r[0] % 50 == 0])


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), rng.integers(-4, 5, 6).tolist()) for i in range(400)]  # many equal scores
    rows += [(400 + i, 1, [2, 2, 0, 1, 0, 0]) for i in range(30)]  # copies
    rows += [(500, None, [1] * 6), (None, 1, [1] * 6), (501, 1, None), (502, 2, [1, 2]), (503, 1, [3, 3]), (504, 0, [0] * 6), (505, 7, [9] * 6)]
    return rows + [rows[3], rows[3], rows[7]]


def test_ties_nulls_copies_and_blocks(shipped):
    df = shipped.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "'x' AS row", "1 AS a", "'y' AS dims")
    asked = [r for r in odd_rows() if r[0] is not None and (r[0] % 50 == 0 or r[0] in (3, 502, 503, 505))]
    anchors = shipped.createDataFrame(asked, SCHEMA)
    want = plain(odd_rows(), asked)
    assert want
    for p in (hn.Params(), hn.Params(anchor_block=3, row_block=50, read_at_once=2)):
        assert got(hn.mine(df, anchors, p)) == want
    wide = hn.Params(2, 4, -30, 200, 5, 90, 1)
    assert got(hn.mine(df, anchors, wide)) == plain(odd_rows(), asked, wide)


def test_empty_tables(shipped):
    none = shipped.createDataFrame([], SCHEMA)
    assert hn.mine(none, none).collect() == []
    assert hn.mine(shipped.createDataFrame(odd_rows(), SCHEMA), none).collect() == []


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    block = rng.integers(-(2**28), 2**28, (8, 300))
    anchor = rng.integers(-(2**28), 2**28, 8)
    want = [sum(int(a) * int(x) for a, x in zip(anchor, column)) for column in block.T]
    at, scores = hn.top(hn._Scan(block), np.arange(300), anchor, -1, 5, 3)
    best = sorted(range(300), key=lambda i: (-want[i], i))[:5]
    assert at.tolist() == best and scores.tolist() == [want[i] for i in best]


def test_not_finite_vectors(shipped):
    rows = [(1, [1.0, None]), (2, [float("nan")]), (3, [float("inf"), 0.0]), (4, None), (5, [0.5, -0.5]), (6, [])]
    df = shipped.createDataFrame(rows, "k long, v array<float>").filter(hn.finite("v")).select("k", hn.quantised("v").alias("q"))
    assert {r["k"]: r["q"] for r in df.collect()} == {5: [128, -128], 6: []}
