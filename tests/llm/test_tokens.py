"""Encoding, counting and packing against the library that defines the ids."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from holdfast.llm import bpe, packing, token_counts
from holdfast.llm.vocabulary import vocabulary

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def random_texts(n=3000):
    rng = random.Random(5)
    letters = "aeio'sStTlLvrd  \n\t\r\x1c\x85 é́ßΣσİıKÅ12٣!<|endoftext|>日本가　😀᠎Ꟛ"
    return ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(n)]


def test_random_texts_match_the_library(library):
    texts = random_texts()
    encoded, counted = bpe.codec(WORDS), token_counts.counter(BYTES)
    for text, got, n in zip(texts, encoded.encode(texts), counted.many(texts), strict=True):
        ids = ids_of(library[WORDS], text)
        assert np.frombuffer(got, "i4").tolist() == ids
        assert encoded.decode(got) == library[WORDS].decode(ids, skip_special_tokens=False)
        assert n == len(ids_of(library[BYTES], text))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_merges_of_single_pieces_match(library, path):
    v, c = vocabulary(path), bpe.codec(path)
    pieces = [x.encode() for x in ("a", "in", "tion", "thing" * 30, "x" * 77, "antidisestablishment")]
    for piece, ids in zip(pieces, c._solve(pieces), strict=True):
        want = library[path].encode(piece.decode(), add_special_tokens=False).ids
        assert np.frombuffer(ids, "i4").tolist() == want
        assert token_counts.count_piece(v.symbols(piece), v.rank, v.result) == len(want)


def test_encode_and_decode_whole_rows(library, odd):
    rows = bpe.encode(odd, WORDS, decoded=True).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count() and rows[0].__fields__ == ["doc_id", "ids", "decoded"]
    for r in rows:
        want = ids_of(library[WORDS], texts[r["doc_id"]])
        assert list(r["ids"]) == want
        assert r["decoded"] == library[WORDS].decode(want, skip_special_tokens=False)
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(odd, WORDS), WORDS).collect()}
    assert back == {r["doc_id"]: r["decoded"] for r in rows}


def test_counts_of_rows(library, odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = token_counts.token_counts(odd, BYTES).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(ids_of(library[BYTES], text)))


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr("holdfast.llm.vocabulary.MEMO_BYTES", 50)
    c = token_counts.counter(BYTES)
    for text in random_texts(50):
        assert c.many([text]) == [len(ids_of(library[BYTES], text))]
        assert len(c._known) < 2000 or c._held > 50


def held_by(pattern):
    return sum(length * times for length, times in pattern)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_the_histogram_and_fill_well(seed):
    rng = random.Random(seed)
    histogram = Counter(min(1024, max(1, int(rng.lognormvariate(5, 1.2)))) for _ in range(5000))
    packs = packing.shortest_pack_first(histogram, 1024)
    placed = Counter()
    for count, pattern in packs:
        assert 0 < held_by(pattern) <= 1024
        for length, times in pattern:
            placed[length] += count * times
    assert placed == histogram
    total = sum(k * n for k, n in histogram.items())
    assert total / (1024 * sum(count for count, _ in packs)) > 0.97


def test_patterns_of_one_length():
    assert packing.shortest_pack_first({100: 25}, 1024) == [(2, ((100, 10),)), (1, ((100, 5),))] or sum(
        c for c, _ in packing.shortest_pack_first({100: 25}, 1024)
    ) == 3
    assert packing.shortest_pack_first({}, 1024) == []


def check_packed(rows, ids):
    """Every id once, in pieces whose places fill sequences without gap or overlap."""
    seen, at = Counter(), {}
    for r in rows:
        own = ids[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert sorted(at) == list(range(len(at)))
    return seen


def test_packing_of_odd_rows(spark, library, odd):
    from pyspark.sql import functions as F

    cut = packing.pieces(odd, BYTES).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens").cache()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    ids = {k: [*ids_of(library[BYTES], t), 0] for k, t in texts.items()}
    seen = check_packed(packing.pack(cut).collect(), ids)
    rows = Counter(r["doc_id"] for r in odd.collect())
    assert seen == {k: rows[k] * len(ids[k]) for k in ids}
    empty = packing.pack(cut.limit(0))
    assert empty.count() == 0 and empty.columns[-2:] == ["sequence_id", "offset"]


def test_packing_spreads_a_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rows = spark.range(1000).selectExpr("id AS doc_id", "0L AS start", "if(id % 10 = 0, 300L, 512L) AS length", "'x' AS offset")
    got = packing.pack(rows).collect()
    ends = Counter()
    for r in got:
        ends[r["sequence_id"]] += r["length"]
    assert len(got) == 1000 and max(ends.values()) <= 1024 and len(ends) == 450 + 34
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 1000


def test_lengths_out_of_range_are_refused(spark):
    with pytest.raises(ValueError, match="between 1 and 8"):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, start long, length long"), 8)
