"""Order MinHash fingerprints of documents, in DataFrame functions only.

A text is a sequence of units: up to four characters of a word and one closing character, single characters of scripts that
are written without spaces, and single signs that part addresses. A unit ends behind a closing character (some vowels and
digits) and at white space, so that units behind an edit soon start where they did before, in unbroken runs of letters or
digits too. Each window of ``k`` units is a k-mer, numbered by how often it has occurred before. Of all numbered k-mers the
``chosen`` smallest by hash are kept in text order, and every ``tuple`` of neighbours among them is hashed.
The sorted hashes are the fingerprint. Two fingerprints are as alike as the share of hashes they have in
common: moved passages break tuples at their edges only, edits cost the units they touch.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from holdfast.llm.frames import texts
from holdfast.session import shuffle_width


class Params(NamedTuple):
    k: int = 3
    chosen: int = 64
    tuple: int = 2


_POSITION = 30
"""Bits for the position of a k-mer; a text in a row has fewer units than that allows."""


_SINGLE = r"\x{0E00}-\x{10FF}\x{1780}-\x{1DFF}\x{2E80}-\x{2FFF}\x{3001}-\x{10FFFF}"
"""Thai to Myanmar, Khmer to Balinese, and all that is Han, Kana, Hangul or later: characters that are units of their own."""
_PARTING = r"/?&=#%+_;:\-"
_CLOSING = "aoAO0"
_CLOSING_MORE = r"\x{0430}\x{043E}\x{0410}\x{041E}\x{03B1}\x{03BF}\x{0391}\x{039F}\x{0627}\x{05D0}"
"""a and o of Cyrillic and Greek, alef."""


def _pattern(closing: str, other: str, space: str) -> str:
    return rf"[{_PARTING}{other}]|[^\s{space}{_PARTING}{other}{closing}]{{1,4}}+[{closing}]?|[{closing}]"


ASCII_UNITS = _pattern(_CLOSING, "", "")
"""What the other pattern finds in a text of ASCII characters, without looking for others."""
UNITS = _pattern(_CLOSING + _CLOSING_MORE, _SINGLE, r"\p{Z}")


def _steps(df: DataFrame, text: str, p: Params) -> DataFrame:
    """Add ``_kept``: the chosen numbered k-mers of ``text`` in text order.

    Each step is a column of its own, so that it is worked out once. What a lambda reads from outside is
    mentioned twice, which keeps the optimiser from moving its computation into the lambda.
    """
    # a k-mer's hash is that of the hash of its first units and the next one; a missing unit does not change it
    windows = "transform(_units, a -> xxhash64(a))" if p.k == 1 else "_units"
    for i in range(1, p.k):
        windows = f"zip_with({windows}, slice(_units, {i + 1}, size(_units)), (a, b) -> xxhash64(a, b))"
    found = lambda pattern: "regexp_extract_all({}, '{}', 0)".format(text, pattern.replace("\\", "\\\\"))
    mask = (1 << _POSITION) - 1
    same = f"shiftright(x, {_POSITION})"
    before = f"shiftright(get(_sorted, i - d - s), {_POSITION})"
    number = f"aggregate(_halves, 0, (d, s) -> if({before} = {same}, d + s, d))"
    repeated = f"shiftright(get(_sorted, i - 1), {_POSITION}) = {same}"
    packed = f"shiftleft(shiftrightunsigned(x, {_POSITION + 1}), {_POSITION}) | i"
    chosen = f"filter(zip_with(_sorted, _numbered, (x, h) -> struct(x & {mask} AS at, h AS h)), e -> e.h <= _most)"
    steps = {
        "_units": f"if(octet_length({text}) = char_length({text}), {found(ASCII_UNITS)}, {found(UNITS)})",
        # a text with fewer units than a k-mer is one k-mer
        "_count": f"if(size(_units) = 0, 0, greatest(size(_units) - {p.k - 1}, 1))",
        "_packed": f"transform(slice({windows}, 1, _count), (x, i) -> {packed})",
        "_sorted": "sort_array(_packed)",
        "_halves": "transform(sequence(cast(log2(greatest(_count, 1)) AS int), 0), b -> cast(shiftleft(1, b) AS int))",
        # a k-mer's number among equals is how far back the first equal one is, found by halving steps
        "_numbered": f"if(size(_halves) = 0, NULL, transform(_sorted, (x, i) -> xxhash64({same}, if({repeated}, {number}, 0))))",
        "_most": f"get(sort_array(_numbered), least({p.chosen}, size(_numbered)) - 1)",
        "_kept": f"if(_most IS NULL, cast(array() AS array<bigint>), transform(array_sort({chosen}), e -> e.h))",
    }
    for name, step in steps.items():
        df = df.withColumn(name, F.expr(step))
    return df


def _tuples(p: Params) -> Column:
    """Sorted hashes of neighbouring chosen k-mers; fewer than a tuple make one, none make none."""
    windows = f"transform(sequence(1, greatest(size(_kept) - {p.tuple - 1}, 1)), i -> slice(_kept, i, {p.tuple}))"
    hashes = f"transform({windows}, w -> cast(xxhash64(w) & 4294967295 AS bigint))"
    return F.expr(f"if(size(_kept) = 0, cast(array() AS array<bigint>), sort_array(array_distinct({hashes})))")


def with_fingerprint(df: DataFrame, text: str, out: str, p: Params = Params()) -> DataFrame:
    """Add ``out``, the fingerprint of a text: eight hexadecimal digits for each hash, in ascending order.

    A null, empty or blank text has the empty fingerprint. Equal texts have equal fingerprints. Texts of any
    length are read whole. All other columns stay; a column that is already called ``out`` is replaced.
    """
    # positions as names, so that no column of the input can clash with those worked with here
    kept = {c: f"c{i}" for i, c in enumerate(df.columns) if c != out}
    read = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_read")
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()], read)
    done = _steps(rows, "_read", p).withColumn("_tuples", _tuples(p))
    shown = F.expr("array_join(transform(_tuples, x -> lpad(lower(hex(x)), 8, '0')), '')")
    return done.select(*[F.col(n).alias(c) for c, n in kept.items()], shown.alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of hashes that two fingerprints have in common: 1 for equal ones, also for two empty ones; null counts as 0."""
    one, two = (F.expr(f"regexp_extract_all({x}, '.{{8}}', 0)") for x in (a, b))
    both = F.size(F.array_intersect(one, two))
    union = F.size(one) + F.size(two) - both
    share = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.try_divide(both, union))
    return F.coalesce(share, F.lit(0.0))


def edges(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending keys that cut a table into about equal ranges."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = df.filter(F.col(key).isNotNull()).select(F.percentile_approx(key, shares, 10_000).alias("e")).first()["e"]
    return sorted(set(found or []))


def _range(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by halving steps over one array."""
    if not cuts:
        return F.lit(0)
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    array = F.from_json(F.lit("[" + ",".join(map(str, cuts)) + "]"), "array<bigint>")
    fits = lambda n, s: F.coalesce(F.get(array, n + s - 1) <= key, F.lit(False))
    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: F.when(fits(n, s), n + s).otherwise(n)), F.lit(0))


RANGES = 8
"""Ranges of keys for each shuffle partition."""


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with ``next_text``, null at the end of a range, and for each range the ``head`` text that follows it.

    Rows are dealt to ranges of keys and ordered inside each; only the first text of a range is handed to the
    range before, and that of the first range to the last. Keys are numbers; repeated keys follow each other in order of
    their texts; null keys come first.
    """
    docs = texts(df, key, text)
    cuts = edges(docs, "doc_id", RANGES * shuffle_width(df.sparkSession))
    placed = docs.withColumn("_range", _range(F.col("doc_id"), cuts))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id"))["doc_id"]
    firsts = placed.groupBy("_range").agg(first.alias("_first"))
    heads = placed.join(F.broadcast(firsts), "_range").filter(F.col("doc_id").eqNullSafe(F.col("_first")))
    heads = heads.groupBy("_range").agg(F.min("text").alias("head"))  # a row for each range
    ring = Window.orderBy("_range")
    before = F.coalesce(F.lag("_range").over(ring), F.max("_range").over(Window.partitionBy()))
    rings = firsts.select("_range", before.alias("_before"))  # numbers alone: one row for each range
    heads = heads.join(rings, "_range").select(F.col("_before").alias("_range"), "head")
    return placed.withColumn("next_text", F.lead("text").over(_inside())), heads


def _inside() -> WindowSpec:
    return Window.partitionBy("_range").orderBy("doc_id", "text")


def edited_pairs(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, ``edited`` text, ``fingerprint`` and ``edited_fingerprint``, and ``next_fingerprint``.

    The edited text has its last quarter of code points replaced by the first as many of the next document (or all
    of it). A null text counts as empty and stays so. A single document is followed by itself. No rows give no rows.
    """
    rows, heads = with_next(df, key, text)
    rows = rows.join(with_fingerprint(heads, "head", "head_fingerprint", p), "_range")
    quarter = "cast(floor(char_length(text) / 4) AS int)"
    replaced = f"concat(left(text, char_length(text) - {quarter}), left(coalesce(next_text, head), {quarter}))"
    rows = rows.withColumn("edited", F.expr(replaced)).drop("next_text", "head")
    rows = with_fingerprint(rows, "text", "fingerprint", p)
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", p)
    following = F.coalesce(F.lead("fingerprint").over(_inside()), F.col("head_fingerprint"))
    return rows.withColumn("next_fingerprint", following).drop("_range", "head_fingerprint")
