"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, whatever their label, are unlabelled. The risk of a
linear classifier is estimated as prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)); when the
second part turns negative the step goes the other way, so that the classifier cannot fit the unlabelled texts by heart.
The prior is the toxic share of the labelled training rows.

Features are the words of a text and the first letters of longer words, once each. Samples of bounded size teach which
features to keep and their weights; several classifiers, each without one part of the sample, are trained in
tasks of their own and averaged. What reaches the driver is the vocabulary and its weights, both bounded by parameters.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from holdfast.llm.frames import slices
from holdfast.llm.lang_id import crc_remainder
from holdfast.session import materialise

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
LONGEST = 64
"""Longer words (runs without a break) are known by their first letters alone."""


class Params(NamedTuple):
    positives: int = 20_000
    """About so many confirmed toxic rows are learnt from, at most."""
    unlabelled: int = 20_000
    """About so many rows of the other kind, at most."""
    least_texts: int = 5
    """Positive texts that a feature must occur in."""
    least_z: float = 5.0
    """Standard errors by which its share of the positives exceeds that of the unlabelled texts."""
    vocabulary: int = 65_536
    starts: tuple[int, ...] = (4, 5, 6)
    members: int = 4
    steps: int = 300
    rate: float = 0.05
    penalty: float = 1e-4


class Model(NamedTuple):
    weights: dict[str, float]
    intercept: float
    prior: float


def features(text: str, p: Params) -> set[str]:
    """Distinct lower-case words of a whole text, and after a circumflex the starts of longer words."""
    words = set(_WORD.findall(text.lower()))
    out = {w for w in words if len(w) <= LONGEST}
    for n in p.starts:
        out |= {"^" + w[:n] for w in words if len(w) > n}
    return out


def _sampled(rows: DataFrame, key: str, most: int, salt: str) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of their key."""
    n, share = rows.count(), 1 << 30
    if n > most:
        share = max(1, int(share * most / n))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < share)


def _counted(rows: DataFrame, p: Params, known: set[str] | None = None) -> DataFrame:
    """Number of texts of each feature, or of each known one; partial sums in the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["feature", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    found = features(text, p)
                    held.update(found if shared.value is None else found & shared.value)
                if len(held) > 500_000:
                    yield out()
        yield out()

    return rows.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _chosen(positives: DataFrame, unlabelled: DataFrame, p: Params) -> list[str]:
    """Features that mark the positives, at most ``p.vocabulary``."""
    n_pos, n_all = positives.count(), unlabelled.count()
    many = _counted(positives, p).filter(F.col("n") >= p.least_texts)
    mine = {r["feature"]: r["n"] for r in many.orderBy(F.desc("n"), "feature").limit(p.vocabulary).toLocalIterator()}
    theirs = {r["feature"]: r["n"] for r in _counted(unlabelled, p, set(mine)).toLocalIterator()} if mine else {}
    out = []
    for feature in sorted(mine):
        share = (theirs.get(feature, 0) + 0.5) / (n_all + 1)
        if mine[feature] / n_pos - share > p.least_z * math.sqrt(share * (1 - share) / n_pos):
            out.append(feature)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: list[np.ndarray], other: list[np.ndarray], prior: float, width: int, p: Params) -> np.ndarray:
    """Weights and, last, the intercept of one classifier over lists of feature numbers.

    Full-batch Adam on the logistic loss; the mean over the second half of the steps is returned.
    """
    sizes = [np.array([len(x) for x in rows], np.int64) for rows in (positive, other)]
    columns = [np.concatenate([np.zeros(0, np.int64), *rows]) for rows in (positive, other)]
    owners = [np.repeat(np.arange(len(s)), s) for s in sizes]
    weights, mean = np.zeros(width + 1), np.zeros(width + 1)
    weights[-1] = math.log(prior / (1 - prior))
    first, second = np.zeros(width + 1), np.zeros(width + 1)

    def margins(k: int) -> np.ndarray:
        return np.bincount(owners[k], weights=weights[columns[k]], minlength=len(sizes[k])) + weights[-1]

    for step in range(1, p.steps + 1):
        pos, oth = margins(0), margins(1)
        as_negative = _sigmoid(pos) * (prior / len(pos))
        from_other = _sigmoid(oth) / len(oth)
        rest = np.logaddexp(0, oth).mean() - prior * np.logaddexp(0, pos).mean()
        if rest >= 0:
            by_pos, by_oth = -_sigmoid(-pos) * (prior / len(pos)) - as_negative, from_other
        else:  # the estimate of a risk is negative: step back until it is not
            by_pos, by_oth = as_negative, -from_other
        slope = np.bincount(columns[0], weights=by_pos[owners[0]], minlength=width + 1)
        slope += np.bincount(columns[1], weights=by_oth[owners[1]], minlength=width + 1)
        slope += p.penalty * weights
        slope[-1] = by_pos.sum() + by_oth.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights -= p.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        if 2 * step > p.steps:
            mean += weights / (p.steps - p.steps // 2)
    return mean


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of ``docs`` and their ``labels`` (1 toxic, anything else not confirmed).

    A document with several labels is toxic if one of them is 1. Null keys, null texts (empty) and labels without a document
    teach nothing about words. Without a toxic label no text scores more than the prior, which then is 0.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    share = known.agg(F.avg((F.col("y") == 1).cast("int"))).first()[0] or 0.0
    if share == 0.0:
        return Model({}, -30.0, 0.0)
    prior = min(max(share, 1e-4), 1 - 1e-4)
    # at most about p.positives keys
    toxic = F.broadcast(materialise(_sampled(known.filter("y = 1").select("k"), "k", p.positives, "toxic")))
    positives = materialise(rows.join(toxic, "k"))
    unlabelled = materialise(_sampled(rows, "k", p.unlabelled, "unlabelled"))
    names = _chosen(positives, unlabelled, p)
    if not names:
        return Model({}, math.log(prior / (1 - prior)), prior)
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    members = max(2, p.members)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [sorted(place.value[f] for f in features(t, p) & place.value.keys()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("part"), part.column("positive"), pa.array(found, pa.list_(pa.int32()))], ["part", "positive", "found"])

    both = positives.select("k", "text", F.lit(True).alias("positive")).union(unlabelled.select("k", "text", F.lit(False)))
    dealt = both.select(F.pmod(F.xxhash64("k", F.lit("part")), F.lit(members)).cast("int").alias("part"), "positive", "text")
    lists = materialise(dealt.mapInArrow(numbered, "part int, positive boolean, found array<int>"))
    tasks = lists.withColumn("member", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(members - 1)), F.array("part"))))
    width = len(names)

    def learn(group: pa.Table) -> pa.Table:
        # a bounded sample: p.positives + p.unlabelled rows
        marks = group.column("positive").to_pylist()
        found = [np.array(x, np.int64) for x in group.column("found").to_pylist()]
        yes, no = ([x for x, m in zip(found, marks) if m is want] for want in (True, False))
        out = fit(yes, no, prior, width, p) if yes and no else np.full(width + 1, np.nan)
        return pa.table({"w": pa.array([out.tolist()], pa.list_(pa.float64()))})

    got = [np.array(r["w"]) for r in tasks.groupBy("member").applyInArrow(learn, "w array<double>").collect()]
    got = [w for w in got if not np.isnan(w).any()]
    if not got:
        return Model({}, math.log(prior / (1 - prior)), prior)
    weights = np.mean(got, axis=0)
    return Model({f: float(w) for f, w in zip(names, weights) if w != 0.0}, float(weights[-1]), prior)


def predict(df: DataFrame, model: Model, p: Params = Params(), text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); whole texts of any length.

    A null or empty text has the score of a text without any known feature. Other columns stay and are not read; columns
    already called score or predicted are replaced.
    """
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value.weights, shared.value.intercept
        for batch in batches:
            for part in slices(batch, text):
                values = part.column(at).to_pylist()
                # the order of a set differs between processes: fsum is exact, so a repeated task gives the same score
                sums = [intercept + math.fsum(weights[f] for f in features(v or "", p) & weights.keys()) for v in values]
                score = pa.array(_sigmoid(np.array(sums, np.float64)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*kept, "score"])

    scored = rows.mapInArrow(run, StructType([*rows.schema.fields]).add("score", DoubleType()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the key leaves 1 modulo 3."""
    return crc_remainder(key, 3) == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``held_out``, ``score`` and ``predicted`` of every document, learnt from rows that are not held out."""
    model = train(docs.filter(~held_out(key)), labels.filter(~held_out(key)), p, key, text)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), held_out(key).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return predict(rows, model, p).drop("text")
