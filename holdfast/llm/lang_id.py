"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of labelled texts by language and bucket, in partial sums on the executors; what reaches
the driver is one count for each language and bucket. The log-probabilities are broadcast as a matrix of
that fixed size. Prediction turns a slice of texts into one array of buckets and sums the rows of the
matrix over each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import slices, texts

_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


GRAM_BYTES = 250_000
"""Text whose n-grams are held at once: each byte costs about 70."""


class Params(NamedTuple):
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    """Two to this power are the buckets that n-grams are hashed to."""
    languages: int = 1_000
    """More distinct languages than these are refused: the matrix has a column for each."""
    sample: int = 20_000
    """About so many labelled rows are learnt from, at most: the bound of the training sample."""
    smoothing: float = 0.5


class Model(NamedTuple):
    languages: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray
    """Log-probability of each bucket (row) in each language (column)."""
    usual: np.ndarray
    """Mean log-probability of the training n-grams of each language under its own column."""
    spread: np.ndarray
    """Standard deviation of the same."""


def _grams(texts_: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and the position of the text each belongs to.

    A text is read between two spaces; n-grams that reach into the next text are left out.
    """
    lowered = [f" {t.lower()} " for t in texts_]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(lowered)), lengths)
    shift = np.uint64(64 - p.bits)
    buckets, owners = [], []
    for n in p.orders:
        if len(codes) < n:
            continue
        rolled = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            rolled = rolled * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
        inside = owner[: len(rolled)] == owner[n - 1 :]
        buckets.append(((rolled * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)[inside])
        owners.append(owner[: len(rolled)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, by a modulus; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % modulus


def train(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows with a language; rows with a null language or no letter teach nothing.

    At most about ``p.sample`` rows, chosen by a hash of their key, are learnt from; that bounds the training and does not
    touch what is predicted. Without any labelled row the model knows no language.
    """
    rows = df.filter(F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    share = 1 << 30
    if (n := rows.count()) > p.sample:
        share = max(1, int(share * p.sample / n))
    rows = rows.filter(F.pmod(F.xxhash64("k", F.lit("training")), F.lit(1 << 30)) < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text", GRAM_BYTES):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                values = part.column("text").to_pylist()
                for one in set(langs):
                    own = [values[i] for i in np.flatnonzero(langs == one) if _LETTER.search(values[i])]
                    bucket, _ = _grams(own, p)
                    sums[one] = sums.get(one, 0) + np.bincount(bucket, minlength=1 << p.bits)
                    docs[one] = docs.get(one, 0) + len(own)
        for one, total in sums.items():
            used = np.flatnonzero(total)
            # bucket -1 holds the number of texts
            bucket, n = np.append(used, -1), np.append(total[used], docs[one])
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(n)), pa.array(bucket), pa.array(n)], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = rows.select("lang").distinct().limit(p.languages + 1).count()
    if found > p.languages:
        raise ValueError(f"more than {p.languages} languages: the column of languages is not clean, or Params.languages is too small")
    got = counted.toPandas()  # one row for each language and bucket at most
    languages = tuple(sorted(set(got["lang"][(got["bucket"] < 0) & (got["n"] > 0)])))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.full((1 << p.bits, len(languages)), p.smoothing)
    prior = np.zeros(len(languages))
    for one, part in got.groupby("lang"):
        if one in place:
            seen = part[part["bucket"] >= 0]
            counts[seen["bucket"].to_numpy(), place[one]] += seen["n"].to_numpy()
            prior[place[one]] = part["n"][part["bucket"] < 0].iloc[0]
    table = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
    share = (counts - p.smoothing) / np.maximum((counts - p.smoothing).sum(axis=0, keepdims=True), 1)
    usual = (share * table).sum(axis=0)
    spread = np.sqrt(np.maximum((share * table.astype(np.float64) ** 2).sum(axis=0) - usual**2, 0))
    return Model(languages, np.log(prior / max(prior.sum(), 1)), table, usual, spread)


def scored(values: list[str], m: Model, p: Params, unusual: float | None = None) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability of each text.

    The posterior is near 1 after a few words, whatever they are. With ``unusual``, a text whose mean log-probability per n-gram
    is further than that (in nats, and four standard errors for its length) below the usual one of its language is in none.
    """
    names, score = [UNKNOWN] * len(values), np.zeros(len(values))
    if not m.languages or not values:
        return names, score
    bucket, owner = _grams(values, p)
    sums = np.stack([np.bincount(owner, weights=m.table[bucket, k], minlength=len(values)) for k in range(len(m.languages))], axis=1)
    sums += m.prior
    best = sums.argmax(axis=1)
    chance = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    strange = np.zeros(len(values), bool)
    if unusual is not None:
        n = np.maximum(np.bincount(owner, minlength=len(values)), 1)
        mean = (sums - m.prior)[np.arange(len(values)), best] / n
        strange = mean < m.usual[best] - unusual - 4 * m.spread[best] / np.sqrt(n)
    for i, value in enumerate(values):
        if not strange[i] and _LETTER.search(value):
            names[i], score[i] = m.languages[best[i]], chance[i]
    return names, score


def predict(df: DataFrame, m: Model, p: Params = Params(), text: str = "text", unusual: float | None = None) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior probability (0 to 1) of that language.

    A null text, a text without a letter, one that is ``unusual`` (see ``scored``), or a model without languages gives ``und`` and 0. Ties go to the
    language first in alphabetical order. Texts of any length are read whole. All other columns stay and are not read;
    columns already called lang_pred or score are replaced.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(m)
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, GRAM_BYTES):
                values = [v or "" for v in part.column(at).to_pylist()]
                names, score = scored(values, shared.value, p, unusual)
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*rows.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(run, schema)


def identify(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Key, ``held_out``, ``lang_pred`` and ``score`` of every row, by a model of the rows that are not held out.

    Rows whose crc32 of the key leaves 1 modulo 3 are held out of the training.
    """
    held = crc_remainder(key, 3) == 1
    model = train(df.filter(~held), p, key, text, lang)
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text}`").alias("text"))
    return predict(rows, model, p).drop("text")
