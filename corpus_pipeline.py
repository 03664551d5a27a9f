"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Language identification drops texts without a recognisable language, near-dedup keeps one document of each group,
personal data gets pseudonyms, and what is left is packed into sequences of tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm import lang_id, minhash_dedup, packing, pii
from holdfast.llm.frames import ship_package
from holdfast.llm.queries import LIMIT, PSEUDONYM_KEY
from holdfast.session import materialise

VOCABULARY = "byte_bpe_50k.json"
SURE = 0.5
"""Least posterior probability of a language; a text with less, or without letters, is rejected."""


UNUSUAL = 2.5
"""Nats per n-gram below what is usual in its language, from which a text counts as no language that was learnt. Training texts differ
by 0.3 nats (one standard deviation), languages that were not learnt by 3 to 10."""


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with the columns they came with."""
    ship_package(spark)
    model = lang_id.train(docs)
    told = lang_id.predict(docs, model, unusual=UNUSUAL).filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= SURE))
    return told.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 80 percent).

    Of rows with one doc_id and text one stays; rows with one doc_id and different texts are judged by their texts. Rows without
    doc_id all stay.
    """
    ship_package(spark)
    key = ["doc_id", "_text_hash"]
    gone = minhash_dedup.near_duplicates(docs).filter("NOT kept").select("doc_id", F.col("text_hash").alias("_text_hash")).distinct()
    marked = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns))
    once = marked.join(gone, key, "left_anti").withColumn("_row", F.row_number().over(same)).filter("_row = 1 OR doc_id IS NULL")
    return once.select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format."""
    done = pii.pseudonymise(docs, PSEUDONYM_KEY)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    ship_package(spark)
    cut = packing.pieces(docs, public_tokenizers.path(VOCABULARY), LIMIT)
    narrow = cut.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens")
    return packing.pack(materialise(narrow), LIMIT)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("pii_pseudonyms", pseudonyms),
    ("packing", pack),
]

ORACLE_SQL = None
"""Language models, keyed permutations and encoded tokens have no SQL form; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
