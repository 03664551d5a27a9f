"""Packing tokenised documents into sequences of a fixed length.

Documents are cut into pieces of at most the capacity. The histogram of piece lengths, which has no
more bins than the capacity, is packed longest first: a length goes to the shortest open pack that
it fits (the one with most room), and packs with the same content are one pattern with a count.
Pieces then find their place by their rank among the pieces of their length, so the rows are only
numbered and joined with the patterns, never moved through the driver.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.frames import slices, texts
from holdfast.llm.vocabulary import byte_letters

CAPACITY = 1024
END = 0
"""The id that ends each document."""

GROUP = 10_000
"""About so many pieces of one length are numbered together; a frequent length is dealt to several groups."""

# The published cutting rule of the byte-level vocabulary. Letters come first and runs
# are possessive, which cuts alike and is faster.
_CUT = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def _encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a ``tokenizers`` file with byte-level merges, whose ids are its merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return tiktoken.Encoding(path, pat_str=_CUT, mergeable_ranks=ranks, special_tokens=special)


def pieces(
    df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document's ids with ``end`` behind them, cut into pieces of at most ``capacity``.

    Rows: doc_id, start, length, doc_tokens and ``tokens``, the ids as little-endian unsigned 32-bit
    integers. A null or empty text is the end id alone. Texts of any length are encoded whole; repeated
    rows give repeated pieces; null keys stay; other columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path)
        tail = np.array([end], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, length, total, data = [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    ids = np.concatenate([own.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False), tail])
                    for at in range(0, len(ids), capacity):
                        piece = ids[at : at + capacity]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        total.append(len(ids))
                        data.append(piece.tobytes())
                columns = [part.column("doc_id").take(pa.array(row, pa.int32()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, total)] + [pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "doc_tokens", "tokens"]
    rows = texts(df, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, tokens binary")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (count, ((length, times), ...)), each at most ``capacity`` long, that hold the whole histogram."""
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_.items() if packs and r >= length), default=None)
            if room is None:
                times = capacity // length
                if left >= times:
                    count, content = left // times, ((length, times),)
                else:
                    count, content = 1, ((length, left),)
                used = content[0][1]
                left -= count * used
                open_[capacity - length * used].append((count, content))
                continue
            count, content = open_[room].pop()
            taken = min(count, left)
            left -= taken
            if taken < count:
                open_[room].append((count - taken, content))
            last, times = content[-1]
            grown = (*content[:-1], (last, times + 1)) if last == length else (*content, (length, 1))
            open_[room - length].append((taken, grown))
    return [pack for room in sorted(open_) for pack in open_[room]]


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add ``sequence_id`` (from 0, gapless) and ``offset`` (in the sequence) to pieces with a ``length``.

    ``rows`` is read twice, so it should be stored. All columns are kept; an input column called
    sequence_id or offset is replaced. Lengths lie between 1 and the capacity (others raise an error);
    ties in ``order`` are interchangeable rows; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    slots, first = [], 0
    upto: dict[int, int] = defaultdict(int)
    for count, content in shortest_pack_first(counts, capacity):
        at = 0
        for length, times in content:
            slots.append((length, upto[length], upto[length] + count * times, times, first, at))
            upto[length] += count * times
            at += length * times
        first += count
    slots_df = spark.createDataFrame(slots, "_length long, _from long, _to long, _times long, _first long, _at long")
    groups = spark.createDataFrame([(x, -(-n // GROUP)) for x, n in counts.items()], "_l long, _groups long")
    dealt = (
        rows.select(*kept)
        .join(F.broadcast(groups), F.col("length") == F.col("_l"))
        .withColumn("_group", F.pmod(F.xxhash64(*order), F.col("_groups")))
        .drop("_l", "_groups")
    )
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_group").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_group"])
    rank = F.col("_before") + F.col("_rank")
    found = ranked.withColumn("_rank", rank).join(
        F.broadcast(slots_df),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    )
    nth = F.col("_rank") - F.col("_from")
    return found.select(
        *kept,
        F.expr("_first + (_rank - _from) div _times").alias("sequence_id"),
        (F.col("_at") + nth % F.col("_times") * F.col("length")).alias("offset"),
    )
