"""Pseudonyms for personal data that keep their format, in DataFrame functions only.

Card numbers, bank accounts, social security numbers, telephone numbers, network addresses and dates are
validated, then permuted within their format by a keyed Feistel network: two halves take turns in adding a keyed
hash of the other half, number by number, each modulo its own range. A permutation never maps two values to one, so
equal values stay linked across documents and different ones stay apart. Card and account numbers get matching
check digits. Mail addresses and quoted or assigned secrets are permuted letter by letter and digit by digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
"""Even, so that the halves end where they began."""

_NAME = r"[\p{L}\p{N}._%+-]"
_VALUE = r"[A-Za-z0-9+/_-]"

# Length of an account number by country; of other codes any length is looked at.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    def countries(names: str) -> str:
        return f"(?:{names.replace(' ', '|')})"

    fixed = [
        rf"{countries(names)}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, names in _LENGTHS.items()
    ]
    rest = rf"(?!{countries(' '.join(_LENGTHS.values()))})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<!\w)(?:{'|'.join([*fixed, rest])})(?!\w)"


# Groups of a telephone number: the North American one; after a plus sign 8 to 15 digits in groups of any length,
# which end before a date; and national ones that start with a zero.
_PHONES = (
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    r"\+[1-9](?:(?:[ .-](?!\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}))?\(?\d\)?){7,14}(?!\w)",
    r"(?!\d{4}[ -]\d{4}[ -]\d{4}[ -]\d)(?:0[1-9]\d{1,4}|\(0[1-9]\d{0,4}\))[ -]\d{3,4}[ -]\d{3,4}(?!\w)",
    r"(?:0[1-9]\d{1,4}|\(0[1-9]\d{0,4}\))[ /-]\d{5,8}(?!\w)",
    r"0[1-9](?:[ .-]\d{2}){4}(?!\w)",
)

# What is looked for, in this order; each pattern stands for the whole of a value. Kinds with a check below count
# only if they pass it.
PATTERNS = {
    "secret": rf"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?{_VALUE}{{8,}}+",
    "email": rf"(?<!{_NAME}){_NAME}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{0,8}}\.[A-Za-z]{{2,}}",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": _iban_pattern(),
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
    "phone": rf"(?<![\w+])(?:{'|'.join(_PHONES)})",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
}

# Ranges of characters that change into one another: first code and number of codes.
_CLASSES = ((48, 10), (97, 26), (65, 26), (224, 23), (192, 23), (248, 8), (216, 7))


def _quoted(pattern: str) -> str:
    """A regular expression as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_PER_DIGEST = 5
"""Numbers of 12 hexadecimal digits that one digest gives."""


def _feistel(parts: str, tweak: str, key: str) -> str:
    """New values (array of bigint) of ``parts``, an array of struct(v, m) with v in 0..m-1.

    A round hashes the other half once; the numbers to add come from digests of that hash and a counter.
    """
    other = "array_join(transform(s.r, x -> cast(x.v AS string)), ',')"
    hashed = f"sha2(concat_ws('|', {key}, {tweak}, q, {other}), 256)"
    blocks = f"transform(sequence(0, size(s.l) div {_PER_DIGEST}), b -> sha2(concat_ws('|', h, b), 256))"
    add = f"cast(conv(substr(bs[j div {_PER_DIGEST}], cast(j % {_PER_DIGEST} AS int) * 12 + 1, 12), 16, 10) AS bigint)"
    moved = f"transform(s.l, (c, j) -> struct(pmod(c.v + {add}, c.m) AS v, c.m AS m))"
    turn = f"struct(s.r AS l, {_let('h', hashed, _let('bs', blocks, moved))} AS r)"
    halves = "struct(slice(ps, 1, cast(size(ps) / 2 AS int)) AS l, slice(ps, cast(size(ps) / 2 AS int) + 1, size(ps)) AS r)"
    run = f"aggregate(sequence(1, {ROUNDS}), {halves}, (s, q) -> {turn}, s -> transform(concat(s.l, s.r), x -> x.v))"
    return _let("ps", parts, run)


def _chars(low: str, high: str, tweak: str, key: str) -> str:
    """``m`` with its letters and digits at positions low..high-1 permuted; all others stay."""
    first = " ".join(f"WHEN ascii(c) BETWEEN {a} AND {a + n - 1} THEN {a}" for a, n in _CLASSES)
    count = " ".join(f"WHEN ascii(c) BETWEEN {a} AND {a + n - 1} THEN {n}" for a, n in _CLASSES)
    classed = f"struct(i AS i, c AS c, CASE WHEN i >= lo AND i < hi THEN CASE {first} END END AS a, CASE {count} END AS n, ascii(c) AS code)"
    parts = "transform(held, e -> struct(cast(e.code - e.a AS bigint) AS v, cast(e.n AS bigint) AS m))"
    fresh = f"zip_with(held, {_feistel(parts, tweak, key)}, (e, v) -> struct(e.i AS i, chr(e.a + v) AS c))"
    others = "transform(filter(es, e -> e.a IS NULL), e -> struct(e.i AS i, e.c AS c))"
    shown = f"array_join(transform(sort_array(concat({fresh}, {others})), e -> e.c), '')"
    held = _let("held", "filter(es, e -> e.a IS NOT NULL)", shown)
    # the ends are worked out once, not again for each character
    return _let("lo", low, _let("hi", high, _let("es", f"transform(regexp_extract_all(m, '(?s).', 0), (c, i) -> {classed})", held)))


def _luhn(digits: str) -> str:
    """Weighted digit sum modulo 10; every second digit from the one before the last counts twice."""
    twice = "d * 2 - if(d > 4, 9, 0)"
    each = f"transform(transform(regexp_extract_all({digits}, '.', 0), x -> cast(x AS int)), (d, i) -> if((length({digits}) - i) % 2 = 0, {twice}, d))"
    return f"aggregate({each}, 0, (s, d) -> s + d) % 10"


def _mod97(account: str) -> str:
    """Remainder of an account number by 97, letters counting as 10 to 35."""
    value = "if(c < 'A', cast(c AS int), ascii(c) - 55)"
    moved = f"regexp_extract_all(concat(substr({account}, 5), left({account}, 4)), '.', 0)"
    numbers = f"transform({moved}, c -> {value})"
    return f"aggregate({numbers}, 0, (s, v) -> (s * if(v > 9, 100, 10) + v) % 97)"


_DIGITS = r"regexp_replace(m, '\\D', '')"


def _card(key: str) -> str:
    """A card number with new digits and the check digit that fits them."""
    new = _chars("0", "length(m) - 1", "'card'", key)
    body = r"regexp_replace(left(w, length(w) - 1), '\\D', '')"
    check = f"pmod(10 - {_luhn(f'concat({body}, 0)')}, 10)"
    return _let("w", new, f"concat(left(w, length(w) - 1), {check})")


def _iban(key: str) -> str:
    """An account number with new letters and digits behind its country, and check digits that fit them."""
    new = _chars("4", "length(m)", "'iban'", key)
    plain = "concat(left(w, 2), '00', replace(substr(w, 5), ' ', ''))"
    check = f"lpad(98 - {_let('p', plain, _mod97('p'))}, 2, '0')"
    return _let("w", new, f"concat(left(w, 2), {check}, substr(w, 5))")


def _ip(key: str) -> str:
    tweak = "'ip'"
    parts = "transform(split(m, '[.]'), x -> struct(cast(x AS bigint) AS v, 256L AS m))"
    return f"array_join(transform({_feistel(parts, tweak, key)}, x -> cast(x AS string)), '.')"


def _ssn(key: str) -> str:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area = "cast(left(m, 3) AS bigint)"
    parts = (
        f"array(struct({area} - if({area} > 666, 2, 1) AS v, 898L AS m), struct(cast(substr(m, 5, 2) AS bigint) - 1L AS v, 99L AS m), "
        "struct(cast(substr(m, 8) AS bigint) - 1L AS v, 9999L AS m))"
    )
    shown = "concat_ws('-', lpad(n[0] + if(n[0] > 664, 2, 1), 3, '0'), lpad(n[1] + 1, 2, '0'), lpad(n[2] + 1, 4, '0'))"
    return _let("n", _feistel(parts, "'ssn'", key), shown)


# Where a date's year, month and day stand: year first with hyphens, day first with dots, and with slashes month
# first unless the first number is no month.
_FIELDS = r"regexp_extract_all(m, '\\d+', 0)"
_ORDER = (
    "CASE WHEN m LIKE '%-%' THEN array(0, 1, 2) WHEN m LIKE '%.%' THEN array(2, 1, 0) "
    f"WHEN cast({_FIELDS}[0] AS int) > 12 THEN array(2, 1, 0) ELSE array(2, 0, 1) END"
)
_DATE = _let("f", _FIELDS, _let("o", _ORDER, "try_cast(concat_ws('-', f[o[0]], lpad(f[o[1]], 2, '0'), lpad(f[o[2]], 2, '0')) AS date)"))
_CYCLE = 146_097
"""Days in 400 years of the calendar, 27 x 5411; a date stays within its 400 years, counted from 1800."""


def _date(key: str) -> str:
    days = f"datediff({_DATE}, date '1800-01-01')"
    within = f"pmod({days}, {_CYCLE})"
    parts = f"array(struct(cast(floor({within} / 5411) AS bigint) AS v, 27L AS m), struct(cast({within} % 5411 AS bigint) AS v, 5411L AS m))"
    start = f"date_add(date '1800-01-01', cast(floor({days} / {_CYCLE}D) * {_CYCLE} AS int))"
    moved = _let("n", _feistel(parts, "'date'", key), f"date_add({start}, cast(n[0] * 5411 + n[1] AS int))")
    fields = "array(lpad(year(d), 4, '0'), cast(month(d) AS string), cast(day(d) AS string))"
    sign = "CASE WHEN m LIKE '%-%' THEN '-' WHEN m LIKE '%.%' THEN '.' ELSE '/' END"
    place = "transform(sequence(0, 2), i -> lpad(new[array_position(o, i) - 1], greatest(length(f[i]), length(new[array_position(o, i) - 1])), '0'))"
    shown = _let("f", _FIELDS, _let("o", _ORDER, f"array_join({place}, {sign})"))
    return _let("d", moved, _let("new", fields, shown))


def _kind() -> str:
    """The kind of a match ``m``, null if it fails the check of its kind."""
    checks = {
        "secret": "true",
        "email": "true",
        "ip": "forall(split(m, '[.]'), x -> cast(x AS int) < 256)",
        "ssn": "left(m, 3) NOT IN ('000', '666') AND left(m, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000'",
        "iban": _mod97("replace(m, ' ', '')") + " = 1",
        "date": f"{_DATE} IS NOT NULL",
        "phone": "true",
        "card": f"{_luhn(_DIGITS)} = 0",
    }
    cases = " ".join(f"WHEN m rlike {_quoted(f'^(?:{p})$')} THEN if({checks[k]}, '{k}', NULL)" for k, p in PATTERNS.items())
    return f"CASE {cases} END"


def _pseudonym(key: str) -> str:
    """The pseudonym of a match ``m`` of kind ``k``."""
    value = _quoted(f"{_VALUE}+$")
    low = f"CASE k WHEN 'secret' THEN length(m) - length(regexp_extract(m, {value}, 0)) WHEN 'phone' THEN length(regexp_extract(m, '^[+]([0-9]{{1,3}}(?![0-9])|[0-9])', 0)) ELSE 0 END"
    high = r"CASE k WHEN 'email' THEN length(m) - length(regexp_extract(m, '[.][^.]*$', 0)) ELSE length(m) END"
    own = {"ip": _ip(key), "ssn": _ssn(key), "iban": _iban(key), "date": _date(key), "card": _card(key)}
    cases = " ".join(f"WHEN k = '{k}' THEN {e}" for k, e in own.items())
    return f"CASE WHEN k IS NULL THEN m {cases} ELSE {_chars(low, high, 'k', key)} END"


def pseudonymise(df: DataFrame, key: str, text: str = "text", kinds: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` replaced by pseudonyms; a column ``kinds`` lists what was replaced, in order.

    Null texts stay null with an empty list, empty texts stay empty; texts of any length are read whole; values that
    fail the check of their kind stay as they are. Repeated rows get equal results, whatever the row or cluster. All
    other columns stay; a column already called ``kinds`` is replaced. ``key`` must have no quote or backslash.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key must have no quote or backslash")
    names = [*PATTERNS]
    before, after = ("|".join(PATTERNS[k] for k in part) for part in (names[: names.index("iban")], names[names.index("iban") + 1 :]))
    # positions as names, so that no column of the input can clash with those worked with here
    kept = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in (text, kinds)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()], F.col(f"`{text}`").alias(_TEXT))
    # the key travels as a row of its own, so that no plan, and with it no event log, shows it
    secret = F.broadcast(df.sparkSession.createDataFrame([(1, key)], f"{_ONE} int, {_KEY} string"))
    rows = rows.withColumn(_ONE, F.lit(1)).join(secret, _ONE)
    # a text without digit and @ holds nothing but a secret could, and that needs = or :
    # account numbers are checked wherever they could start, and only valid ones are looked for in the scan: others use up no text
    candidates = f"regexp_extract_all({_TEXT}, {_quoted(f'(?=({PATTERNS["iban"]}))')}, 1)"
    valid = f"filter(array_distinct({candidates}), m -> {_mod97("replace(m, ' ', '')")} = 1)"
    rows = rows.withColumn(_VALID, F.expr(f"if({_TEXT} rlike '[A-Z]{{2}}[0-9]{{2}}', {valid}, array())"))
    opened, closed = _quoted(rf"{before}|(?<!\w)(?=[A-Z]{{2}}\d{{2}})(?:"), _quoted(rf")(?!\w)|{after}")
    scan = f"if(size({_VALID}) > 0, concat({opened}, array_join({_VALID}, '|'), {closed}), {_quoted(f'{before}|{after}')})"
    rows = rows.withColumn(_SCAN, F.expr(scan))
    pattern = _SCAN
    rows = rows.withColumn(_FOUND, F.expr(f"if({_TEXT} rlike '[0-9@=:]', regexp_extract_all({_TEXT}, {pattern}, 0), array())"))
    known = f"transform({_FOUND}, m -> struct(m AS m, {_kind()} AS k))"
    rows = rows.withColumn(_FOUND, F.when(F.size(_FOUND) > 0, F.expr(known)))
    new = f"transform({_FOUND}, e -> {_let('m', 'e.m', _let('k', 'e.k', _pseudonym(_KEY)))})"
    woven = f"array_join(zip_with(split({_TEXT}, {pattern}, -1), {new}, (a, b) -> concat(a, coalesce(b, ''))), '')"
    fresh = F.when(F.col(_FOUND).isNull(), F.col(_TEXT)).otherwise(F.expr(woven))
    out = {text: fresh}
    if kinds:
        out[kinds] = F.expr(f"coalesce(filter(transform({_FOUND}, e -> e.k), k -> k IS NOT NULL), cast(array() AS array<string>))")
    columns: dict[str, Column] = {c: F.col(n) for c, n in kept.items()} | out
    order = [*df.columns, *([kinds] if kinds and kinds not in df.columns else [])]
    return rows.select(*[columns[c].alias(c) for c in order])


_TEXT, _FOUND, _VALID, _SCAN = "_text_read", "_found_values", "_valid_accounts", "_scan_pattern"
_ONE, _KEY = "_one", "_pseudonym_key"
