"""Token counts without tokens: heap-and-linked-list byte-pair merging.

The mergeable pairs of a piece wait in a heap by rank and position. Each merge pops the lowest,
joins two neighbours of a linked list and pushes the two new pairs; entries that no longer describe
the list are passed over. The count is the number of initial symbols minus the number of merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from holdfast.llm.frames import slices, texts
from holdfast.llm.vocabulary import Remembered, vocabulary


def count_piece(ids: list[int], rank: dict[int, int], result: list[int]) -> int:
    """Tokens that remain of one piece."""
    n = len(ids)
    if n < 2:
        return n
    get = rank.get
    heap = []
    for i in range(n - 1):
        r = get(ids[i] << 32 | ids[i + 1])
        if r is not None:
            heap.append(r * n + i)
    if not heap:
        return n
    heapify(heap)
    ids = [*ids]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        r, i = divmod(heappop(heap), n)
        gone = after[i]
        if ids[i] < 0 or gone >= n or get(ids[i] << 32 | ids[gone]) != r:
            continue
        merges += 1
        ids[i], ids[gone] = result[r], -1
        right = after[i] = after[gone]
        if right < n:
            before[right] = i
            r = get(ids[i] << 32 | ids[right])
            if r is not None:
                heappush(heap, r * n + i)
        left = before[i]
        if left >= 0:
            r = get(ids[left] << 32 | ids[i])
            if r is not None:
                heappush(heap, r * n + left)
    return n - merges


@lru_cache(maxsize=4)
def counter(path: str) -> Remembered:
    """Counts tokens of texts; one of each worker and vocabulary."""
    v = vocabulary(path)
    return Remembered(v, lambda new: [count_piece(v.symbols(p), v.rank, v.result) for p in new], sum, lambda _: 1)


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row.

    Counts equal the number of ids of the ``tokenizers`` library for the same file without added
    special tokens. A null or empty text has 0 of both; texts of any length are counted whole; repeated rows
    and null keys stay as they are; other columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                text_ = part.column("text")
                counts = pa.array(c.many(text_.to_pylist()), pa.int64())
                size = pc.binary_length(text_).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, counts], names)

    names = ["doc_id", "n_bytes", "n_tokens"]
    rows = texts(df, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
