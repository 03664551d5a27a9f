"""Byte-pair encoding and decoding of whole texts.

The adjacent pairs of a piece are the leaves of a segment tree that holds, for each pair, its rank
and position. The root is therefore the leftmost pair of the lowest rank. A merge changes three
leaves and their ancestors; a piece is done when its root holds no mergeable pair. The distinct new
pieces of a slice of texts go through this together, a row of numpy arrays each; a few long ones go one by one, over lists.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.frames import slices, texts
from holdfast.llm.vocabulary import Remembered, Vocabulary, vocabulary

_NONE = 1 << 62

BLOCK = 1 << 18
"""Leaves of the trees that are held at once."""


class PairRanks:
    """Ranks of many pairs at once: a binary search in the sorted pairs."""

    def __init__(self, v: Vocabulary):
        keys = np.fromiter(v.rank, np.int64, len(v.rank))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(v.rank.values(), np.int64, len(keys))[order], 0)
        self.result = np.array(v.result, dtype=np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """rank * width + position of each pair, _NONE where it doesn't merge; -1 stands for no symbol."""
        pair = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        found = np.searchsorted(self.keys, pair)
        return np.where(self.keys[found] == pair, self.ranks[found] * width + at, _NONE)


def merge_block(ids: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """Merge many pieces at once, a row each, padded with -1; merged-away symbols become -1.

    A row has ``size`` leaves, one for each adjacent pair, and width ``size`` + 1, a power of two and one.
    """
    m, width = ids.shape
    size = width - 1
    at = np.arange(width)
    tree = np.full((m, 2 * size), _NONE, dtype=np.int64)
    tree[:, size:] = pairs.leaves(ids[:, :-1], ids[:, 1:], at[:-1], width)
    low = size
    while low > 1:
        half = low >> 1
        tree[:, half:low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
        low = half
    after, before = np.tile(at + 1, (m, 1)), np.tile(at - 1, (m, 1))
    rows = np.arange(m)
    while True:
        root = tree[rows, 1]
        live = root < _NONE
        rows, root = rows[live], root[live]
        if not len(rows):
            return ids
        rank, i = np.divmod(root, width)
        gone = after[rows, i]
        right, left = after[rows, gone], before[rows, i]
        ids[rows, i] = merged = pairs.result[rank]
        ids[rows, gone] = -1
        after[rows, i] = right
        more = right < width
        before[rows[more], right[more]] = i[more]
        next_id = np.where(more, ids[rows, np.minimum(right, size)], -1)
        last_id = np.where(left >= 0, ids[rows, np.maximum(left, 0)], -1)
        # The leaf of a pair is that of its left symbol; the last symbol has none, nor has what was merged away.
        for leaf, value in (
            (gone, np.full(len(rows), _NONE)),
            (i, pairs.leaves(merged, next_id, i, width)),
            (left, pairs.leaves(last_id, merged, left, width)),
        ):
            there = (leaf >= 0) & (leaf < size)
            r, k = rows[there], leaf[there] + size
            tree[r, k] = value[there]
            while size > 1 and len(k) and k[0] > 1:
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])


FEW_ROWS = 12
"""Blocks of fewer pieces are merged one by one: a round of array calls costs more than so many single merges."""


def merge_long(ids: list[int], v: Vocabulary) -> list[int]:
    """Merge one piece over the same tree as plain lists; each merge costs as many steps as the tree has levels, or fewer."""
    n = len(ids)
    if n < 2:
        return ids
    size = max(1, 1 << (n - 2).bit_length())
    width = size + 1
    tree = [_NONE] * (2 * size)
    rank_of, result = v.rank, v.result
    for i in range(n - 1):
        rank = rank_of.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * width + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < _NONE:
        rank, i = divmod(root, width)
        gone = after[i]
        right, left = after[gone], before[i]
        ids[i] = merged = result[rank]
        ids[gone] = -1
        after[i] = right
        changed = []
        if gone < size:
            changed.append((gone, _NONE))
        if right < n:
            before[right] = i
            found = rank_of.get(merged << 32 | ids[right])
            changed.append((i, _NONE if found is None else found * width + i))
        else:
            changed.append((i, _NONE))
        if left >= 0:
            found = rank_of.get(ids[left] << 32 | merged)
            changed.append((left, _NONE if found is None else found * width + left))
        for leaf, value in changed:
            k = size + leaf
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1
    return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._pairs = PairRanks(v)
        self._name = [v.names.get(i, "") for i in range(max(v.names) + 1)]
        self._memo = Remembered(v, self._solve, b"".join, lambda i: array("i", [i]).tobytes())

    def _solve(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece. Pieces whose trees have the same size are merged together."""
        out: list[bytes] = [b""] * len(pieces)
        classes = defaultdict(list)
        for n, piece in enumerate(pieces):
            classes[max(1, 1 << (len(piece) - 2).bit_length()) if len(piece) > 1 else 1].append(n)
        for size, members in classes.items():
            step = max(1, BLOCK // size)
            for at in range(0, len(members), step):
                block = members[at : at + step]
                if len(block) < FEW_ROWS:
                    for n in block:
                        out[n] = array("i", merge_long(self.v.symbols(pieces[n]), self.v)).tobytes()
                    continue
                ids = np.full((len(block), size + 1), -1, dtype=np.int64)
                for row, n in enumerate(block):
                    ids[row, : len(pieces[n])] = self.v.symbols(pieces[n])
                merged = merge_block(ids, self._pairs)
                kept = merged >= 0
                ends = np.cumsum(kept.sum(axis=1)) * 4
                flat = merged[kept].astype(np.int32).tobytes()
                start = 0
                for n, end in zip(block, ends.tolist(), strict=True):
                    out[n] = flat[start:end]
                    start = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as consecutive 32-bit integers in native order."""
        return self._memo.many(texts)

    def decode(self, ids: bytes) -> str:
        """Names of the tokens joined by spaces, which is how a vocabulary without a decoder reads back."""
        return " ".join(map(self._name.__getitem__, array("i", ids)))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(vocabulary(path))


def _int_lists(encoded: list[bytes]) -> pa.Array:
    ends = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in encoded], out=ends[1:])
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(encoded))])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row; with ``decoded`` also the text read back from the ids.

    Ids equal those of the ``tokenizers`` library for the same file without added special tokens.
    A null text counts as empty and has an empty array; texts of any length are encoded whole; repeated
    rows and null keys stay as they are; other columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = c.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id"), _int_lists(ids)]
                if decoded:
                    columns.append(pa.array(map(c.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["doc_id", "ids", "decoded"]
    rows = texts(df, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` text of rows with an array of ids; a null array reads back as empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            back = [c.decode(array("i", x or []).tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["doc_id", "decoded"])

    rows = df.selectExpr(f"`{key}` AS doc_id", f"cast(`{ids}` AS array<int>) AS ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")
