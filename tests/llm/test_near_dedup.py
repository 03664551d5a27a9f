"""Near-duplicates of texts and vectors, and components, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import cover_tree, minhash_dedup
from holdfast.llm.components import components


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, words):
    w = (text or "").encode().lower().split()
    n = min(words, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, words, percent=80):
    sets = {k: shingles(t, words) for k, t in rows.items() if k is not None}
    groups = Groups(sets)
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                groups.link(a, b)
    return {k: (len(sets[k]), groups.find(k)) for k in keys}


def made_texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = [*base]
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy))
    chain = [f"w{i}" for i in range(200)]
    texts += [" ".join(chain[s : s + 150]) for s in range(0, 50, 8)]  # each like its neighbours only
    return texts


@pytest.mark.parametrize("words", [2, 5])
def test_documents_match_brute_force(spark, words):
    rows = dict(enumerate(made_texts()))
    df = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(df, minhash_dedup.Params(words=words)).collect()}
    for k, (n, component) in brute(rows, words).items():
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (n, component, k == component)


def test_documents_of_the_fixture_match_brute_force(documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(documents, minhash_dedup.Params(words=2)).collect()}
    assert got == brute(rows, 2)


def test_odd_documents(odd):
    rows = minhash_dedup.near_duplicates(odd, minhash_dedup.Params(words=2)).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    want = brute(texts, 2)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_leftover_groups_in_small_blocks(spark, monkeypatch):
    """Blocks of few classes, and tasks that few pairs share, give the same components."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "FEW", 4)
    monkeypatch.setattr(minhash_dedup, "SLOTS", 64)
    rows = dict(enumerate(made_texts()))
    df = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, minhash_dedup.Params(words=2)).collect()}
    assert got == brute(rows, 2)


def test_similar_sets_against_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 50))) for _ in range(60)]
    component = rng.integers(0, 20, 60)
    members, others = np.arange(40), np.arange(30, 60)
    want = set()
    for t in others:
        for m in members:
            both = len(np.intersect1d(sets[t], sets[m]))
            if component[t] != component[m] and 100 * both >= 40 * (len(sets[t]) + len(sets[m]) - both):
                want.add((t, component[m]))
    got = [*minhash_dedup.similar(sets, component, members, others, 40)]
    assert {(t, component[m]) for t, m in got} == want and len(got) == len(want) > 3


def test_a_pair_shows_up_at_one_of_its_shared_keys(spark):
    p = minhash_dedup.Params(chunks=4, width=4, errors=1)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, p.positions, dtype=np.uint16)
    rows = [(0, base.tobytes())]
    for i in range(1, 300):
        other = base.copy()
        other[rng.choice(p.positions, rng.integers(0, 9), replace=False)] ^= 1
        rows.append((i, other.tobytes()))
    keyed = spark.createDataFrame(rows, "id long, sig binary").select("id", "sig", F.posexplode(minhash_dedup.chunk_keys(p)).alias("k", "key"))
    one, two = (keyed.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "sig", "k")]) for x in "ab")
    pairs = one.join(two, "key").filter("a_id < b_id")
    shared = {(r.a_id, r.b_id) for r in pairs.select("a_id", "b_id").distinct().collect()}
    once = [(r.a_id, r.b_id) for r in pairs.filter(minhash_dedup._first_key(p)).select("a_id", "b_id").collect()]
    assert len(once) == len(set(once)) and set(once) == shared and len(shared) > 100


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_keys_agree_where_the_kept_positions_do(spark, errors):
    p = minhash_dedup.Params(chunks=3, width=4, errors=errors)
    rng = np.random.default_rng(6)
    one = rng.integers(0, 1 << 16, (80, p.positions), dtype=np.uint16)
    two = np.where(rng.random(one.shape) < 0.4, one ^ 256, one).astype(np.uint16)
    kept = [[c * p.width + i for i in range(p.width) if i not in gone] for c in range(p.chunks) for gone in combinations(range(p.width), errors)]
    want = [[k for k, at in enumerate(kept) if (a[at] == b[at]).all()] for a, b in zip(one, two, strict=True)]
    rows = [(i, a.tobytes(), b.tobytes()) for i, (a, b) in enumerate(zip(one, two, strict=True))]
    df = spark.createDataFrame(rows, "id long, a_sig binary, b_sig binary")
    a, b = ({r.id: r.all for r in df.withColumn("sig", F.col(x)).select("id", minhash_dedup.chunk_keys(p).alias("all")).collect()} for x in ("a_sig", "b_sig"))
    assert [[k for k in range(len(kept)) if a[i][k] == b[i][k]] for i in range(len(rows))] == want
    tried = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(kept) - 1))).alias("a_k")).join(
        spark.createDataFrame([(i, k) for i, ks in enumerate(want) for k in ks], "id long, a_k int"), ["id", "a_k"]
    )
    first = {r.id: r.a_k for r in tried.filter(minhash_dedup._first_key(p)).collect()}
    assert first == {i: ks[0] for i, ks in enumerate(want) if ks} and len(first) > 20


def test_expressions_over_all_keys_stay_short(spark):
    """The driver parses, plans and compiles what stands there: written out for each key, it took 150 MB."""
    p = minhash_dedup.Params()
    assert len(minhash_dedup._first_key(p)) < 1000 and len(str(minhash_dedup.chunk_keys(p))) < 1000


def test_white_space_and_letters_of_the_contract():
    s = minhash_dedup.Shingler(2)
    a, b, c, d, e = s.sets(["One two\x0bTHREE", "one\ttwo three", "one two three", "\x1cone two", "ÉA b"])
    assert (a == b).all() and len(c) == 1 and len(a) == 2 and len(d) == 1
    assert (s.sets(["Éa B"])[0] == e).all() and (s.sets(["éa B"])[0] != e).all()
    assert [len(x) for x in s.sets(["", " \n", "one"])] == [0, 0, 1]


def test_pigeonhole_guarantee(spark):
    p = minhash_dedup.Params()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, p.positions, dtype=np.uint16)
    rows = [(0, base.tobytes())]
    for i in range(1, 200):
        other = base.copy()
        other[rng.choice(p.positions, p.guaranteed, replace=False)] ^= 1
        rows.append((i, other.tobytes()))
    df = spark.createDataFrame(rows, "id long, sig binary").select("id", minhash_dedup.chunk_keys(p).alias("keys"))
    keys = {r["id"]: set(r["keys"]) for r in df.collect()}
    assert len(keys[0]) == p.chunks * p.width
    assert all(keys[0] & keys[i] for i in range(1, 200))


def test_components_of_paths_stars_and_odd_edges(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(rng.randrange(500, 800), rng.randrange(500, 800)) for _ in range(200)]
    edges += [(7, 7), (3, 2), (3, 2), (None, 4), (9, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    groups = Groups({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None and b is not None:
            groups.link(a, b)
    touched = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: groups.find(x) for x in touched}
    assert components(df.limit(0), "a", "b").count() == 0


def test_components_over_several_parts(spark, monkeypatch):
    """Forests of small parts are joined by star rounds: the same answer as one part gives."""
    from holdfast.llm import components as module

    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 900)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(900)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    one = {(r["node"], r["component"]) for r in components(df, "a", "b").collect()}
    monkeypatch.setattr(module, "FILE_ROWS", 100)
    assert {(r["node"], r["component"]) for r in components(df, "a", "b").collect()} == one
    assert {c for n, c in one if n < 1000} == {0}


def test_many_unlinked_members_of_one_key(spark):
    """5,000 texts that share a key but are not similar: dealt to a grid of blocks, and none is linked."""
    p = minhash_dedup.Params()
    rng = np.random.default_rng(8)
    n = 5000
    sig = rng.integers(0, 1 << 16, (n, p.positions), dtype=np.uint16)
    sig[:, : p.width] = 7  # one whole chunk in common: all six keys of it
    twin = sig[10].copy()
    twin[p.width : p.width + 9] ^= 1
    sig[11] = twin
    planes = [[sum(int(v >> b & 1) << i for i, v in enumerate(row)) for b in range(4)] for row in sig]
    signed = [(i, 100, sig[i].tobytes(), *[x - (1 << 64) if x >= 1 << 63 else x for x in planes[i]]) for i in range(n)]
    classes = spark.createDataFrame(signed, "rep long, n_shingles long, sig binary, p0 long, p1 long, p2 long, p3 long")
    keyed = classes.select("rep", F.posexplode(minhash_dedup.chunk_keys(p)).alias("k", "key"))
    label = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    pairs = minhash_dedup._leftover(keyed, classes, label, p)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()} >= {(10, 11)}
    assert pairs.count() < 50


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for label in (0, 1, 2):
        centres = rng.normal(size=(12, 16))
        for c in centres:
            for _ in range(rng.integers(1, 12)):
                out.append((label, (c + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])) * rng.choice([1.0, 3.0, 1e-3])))
    return out


def brute_links(rows, cosine):
    groups, n = Groups(r[0] for r in rows), {r[0]: 0 for r in rows}
    for i, (a, la, va) in enumerate(rows):
        for b, lb, vb in rows[i + 1 :]:
            if la != lb or la is None or va is None or vb is None or len(va) != len(vb) or any(x is None for x in (*va, *vb)):
                continue
            x, y = np.array(va), np.array(vb)
            if not np.isfinite([*x, *y]).all() or not x.any() or not y.any():
                continue
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                groups.link(a, b)
                n[a] += 1
                n[b] += 1
    return {k: (n[k], groups.find(k)) for k in n}


@pytest.mark.parametrize("cell,block", [(2000, 2048), (15, 20)])
def test_vectors_match_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(cover_tree, "CELL", cell)
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = [(i, label, [float(x) for x in v]) for i, (label, v) in enumerate(vectors())]
    n = len(rows)
    rows += [(n, 0, None), (n + 1, 0, [0.0] * 16), (n + 2, 0, [1.0, None] + [0.0] * 14), (n + 3, 0, [float("nan")] * 16)]
    rows += [(n + 4, 0, [float("inf")] * 16), (n + 5, None, rows[0][2]), (n + 6, 0, []), (n + 7, 0, [1.0, 0.0]), (n + 8, 0, [2.0, 0.0])]
    rows += [(n + 9, 1, [-0.0, 1.0] + [0.0] * 14), (n + 10, 1, [0.0, 1.0] + [0.0] * 14), (n + 11, 1, [0.0, 1e300] + [0.0] * 14)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, label int, embedding array<double>, cell long, n long, rep string")
    got = cover_tree.near_duplicates(df, 0.98).collect()
    want = brute_links(rows, 0.98)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (*want[r["vec_id"]], r["vec_id"] == want[r["vec_id"]][1])
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_balls_cover_what_they_hold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def check(ball):
        far = np.linalg.norm(x[ball.held] - x[ball.centre], axis=1)
        assert ball.centre in ball.held and far.max() <= ball.radius + 1e-6
        if ball.children:
            assert sorted(np.concatenate([c.held for c in ball.children])) == sorted(ball.held)
            assert ball.children[0].centre == ball.centre
            for c in ball.children:
                check(c)

    check(cover_tree.cover_tree(x))
