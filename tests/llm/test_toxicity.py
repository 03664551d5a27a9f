"""Toxicity: features, the non-negative risk, held-out accuracy and odd tables."""

import numpy as np
import pytest

from holdfast.llm import queries, toxicity
from holdfast.llm.frames import ship_package

MARKS = ("vilestuff", "grimwords", "hateful")


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


def test_features_of_whole_texts():
    p = toxicity.Params()
    assert toxicity.features("", p) == set()
    assert toxicity.features("Ab, ab STUPID_x", p) == {"ab", "stupid_x", "^stup", "^stupi", "^stupid"}
    assert toxicity.features("x" * 100 + " end", p) == {"end", "^xxxx", "^xxxxx", "^xxxxxx"}


def corpus(n=900, seed=4):
    """Every tenth text holds a marked word; only two thirds of those are confirmed, the rest are unlabelled."""
    rng = np.random.default_rng(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = [f"w{rng.integers(400)}" for _ in range(30)]
        truth[i] = int(i % 10 == 0)
        if truth[i]:
            words[3 : 3 + 2] = rng.choice(MARKS, 2).tolist()
        docs.append((i, " ".join(words), "x", "y"))
        if i % 3:
            labels.append((i, truth[i]))
    return docs, labels, truth


def test_unconfirmed_toxic_texts_are_found(shipped):
    docs, labels, truth = corpus()
    df = shipped.createDataFrame(docs, "doc_id long, text string, score string, k string")
    known = shipped.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score_toxicity(df, known).collect()
    assert len(rows) == len(docs)
    assert all(r["predicted"] == truth[r["doc_id"]] == int(r["score"] >= 0.7) for r in rows)
    again = toxicity.score_toxicity(df.repartition(7), known.repartition(3)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx({r["doc_id"]: r["score"] for r in rows}, abs=1e-9)


def test_held_out_labels_teach_nothing(shipped):
    docs, labels, _ = corpus()
    df = shipped.createDataFrame(docs, "doc_id long, text string, a string, b string")
    known = shipped.createDataFrame(labels, "doc_id long, toxic int")
    flipped = known.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, x).collect()} for x in (known, flipped))
    assert a == b


def test_a_negative_risk_turns_the_step():
    """With all unlabelled texts positive, plain subtraction would go on below zero; the estimate stays near it."""
    same = [np.array([0]) for _ in range(50)]
    prior = 0.5
    w = toxicity.fit(same, same, prior, 1, toxicity.Params(penalty=0.0))
    z = w[0] + w[1]
    assert np.logaddexp(0, z) * (1 - prior) >= 0 and np.isfinite(z)
    other = [np.array([], int) for _ in range(50)]
    w = toxicity.fit(same[:10], [*same[:5], *other], 0.1, 1, toxicity.Params())
    rest = np.mean([*[np.logaddexp(0, w.sum())] * 5, *[np.logaddexp(0, w[1])] * 50]) - 0.1 * np.logaddexp(0, w.sum())
    assert rest > -0.05 and toxicity._sigmoid(w.sum()) > 0.7 > 0.3 > toxicity._sigmoid(w[1])


def test_odd_and_empty_tables(shipped, odd):
    empty = shipped.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, empty).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    known = shipped.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 0), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, known).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(odd.limit(0), known).collect() == []


def test_query_on_held_out_rows(shipped):
    """Held-out confirmed texts score above held-out clean ones."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op13_pu_toxicity(shipped, sf).join(shipped.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert np.mean([r["predicted"] for r in toxic]) > 0.88 and np.mean([r["predicted"] for r in clean]) < 0.02
