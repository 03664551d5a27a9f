"""Values, words and pages that are far longer than usual take time in proportion; pages read as a plain parser reads them."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from holdfast.llm import bpe, pii, warc
from holdfast.llm.vocabulary import vocabulary

WORDS = public_tokenizers.path("word_bpe_49k.json")


def timed(call):
    start = time.perf_counter()
    out = call()
    return out, time.perf_counter() - start


def test_a_megabyte_without_a_break():
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    got, seconds = timed(lambda: bpe.Codec(vocabulary(WORDS)).encode([text])[0])
    assert seconds < 20
    assert np.frombuffer(got, np.int32).tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 17, 100, 1000])
def test_single_pieces_merge_as_blocks_do(n):
    v, rng = vocabulary(WORDS), random.Random(n)
    for _ in range(20):
        piece = "".join(rng.choices("etaoinshrdlu", k=n)).encode()
        symbols = v.symbols(piece) if n else []
        size = max(1, 1 << (n - 2).bit_length()) if n > 1 else 1
        ids = np.full((1, size + 1), -1, dtype=np.int64)
        ids[0, :n] = symbols
        block = bpe.merge_block(ids, bpe.PairRanks(v)) if n else ids
        assert bpe.merge_long([*symbols], v) == block[block >= 0].tolist()


@pytest.mark.parametrize("part", ["<a ", "<p ", "<script ", "<title>", "a='", "<meta a", "<!", "<a href=", "<a href='x' "])
def test_five_megabytes_of_unclosed_tags(part):
    page = part * (5_000_000 // len(part))
    _, seconds = timed(lambda: (warc.page_metadata(page, "http://a"), warc.plain_text(page)))
    assert seconds < 20


def test_a_tag_of_five_megabytes():
    _, seconds = timed(lambda: warc.page_metadata("<a " + "b" * 5_000_000 + ">x</a><a href=y>", "http://a"))
    assert seconds < 20


def test_a_secret_of_a_megabyte(spark):
    value = "".join(random.Random(2).choices("abcdef0123456789", k=1_000_000))
    df = spark.createDataFrame([("say token=" + value + " end",)], "text string")
    row, seconds = timed(lambda: pii.pseudonymise(df, "k", kinds="kinds").first())
    assert seconds < 40 and row["kinds"] == ["secret"]
    assert len(row["text"]) == len(value) + 14 and row["text"].startswith("say token=") and row["text"].endswith(" end")
    assert sum(a == b for a, b in zip(row["text"][10:], value)) < 150_000


class Plain(HTMLParser):
    """Visible text by the standard parser: blocks on lines of their own."""

    HIDDEN = {"script", "style", "template", "noscript"}
    BLOCKS = set("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table tr td th thead tbody section article header footer nav main aside pre blockquote form title body html".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag in self.HIDDEN
        self.out.append("\n" * (tag in self.BLOCKS))

    def handle_endtag(self, tag):
        self.inside -= tag in self.HIDDEN and self.inside > 0
        self.out.append("\n" * (tag in self.BLOCKS))

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)


def test_pages_read_as_the_standard_parser_reads_them(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html IS NOT NULL").collect()]
    assert len(pages) > 50
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        lines = (" ".join(line.split()) for line in "".join(plain.out).split("\n"))
        assert warc.plain_text(page) == "\n".join(line for line in lines if line)


def test_links_are_those_of_the_standard_parser(spark):
    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out = []

        def handle_starttag(self, tag, attrs):
            want = warc._TARGETS.get(tag)
            self.out += [(f"{tag.upper()}@/{want}", v) for k, v in attrs if k == want and v][:1] if want else []

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html IS NOT NULL").collect():
        links = Links()
        links.feed(r["html"])
        got = warc.page_metadata(r["html"], r["url"])["Links"]
        assert [x["path"] for x in got] == [p for p, _ in links.out]
        assert [x["url"] for x in got] == [warc._joined(r["url"], v) for _, v in links.out]
