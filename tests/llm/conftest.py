import pytest

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "word",
    "a  b",
    " lead and trail ",
    "It's 'St we'll\tx\r\ny",
    "tab\x1cseparator",
    "é́ ß Σσς İı Å １２٣ ！",
    "<|endoftext|>x<|startoftext|> <|endoftex",
    "日本語の文章 　 한국어 😀",
    "a" * 3000,
    "ab " * 2000,
    "same text here twice",
    "same text here twice",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a null key, a repeated row, and columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no key"), (4, "word")]
    names = "ids", "n_tokens", "length", "sequence_id", "_range", "key", "rep", "score", "_text_read", "component", "tokens"
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
