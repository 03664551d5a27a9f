"""Languages, pseudonyms, fingerprints, chat turns and web records."""

import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter
from datetime import date
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.llm import chat, fingerprint, lang_id, pii, warc

# --- language ------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(documents):
    rows = lang_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_bayes_by_hand(spark):
    """One order, no collisions that matter: scores equal a plain computation."""
    p = lang_id.Params(orders=(1,), bits=16, smoothing=1.0)
    df = spark.createDataFrame([(1, "aab", "x"), (2, "bbc", "y"), (3, "cc", None)], "doc_id long, text string, lang string")
    m = lang_id.train(df, p)
    assert m.languages == ("x", "y")
    size = 1 << 16
    counts = {"x": Counter(" aab "), "y": Counter(" bbc ")}
    chance = {}
    for lang, c in counts.items():
        chance[lang] = 0.5
        for letter in " ab ":
            chance[lang] *= (c[letter] + 1) / (sum(c.values()) + size)
    names, score = lang_id.scored(["ab", "", "12"], m, p)
    assert names == ["x", "und", "und"]
    assert score[0] == pytest.approx(chance["x"] / sum(chance.values()), rel=1e-5) and score[1] == 0


def test_languages_of_odd_rows(spark, odd):
    labelled = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    got = lang_id.identify(labelled).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        none = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == none and (r["score"] == 0) == none
    unlabelled = lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert lang_id.identify(labelled.limit(0)).count() == 0
    kept = lang_id.predict(odd, lang_id.train(labelled))
    assert kept.columns == [*[c for c in odd.columns if c != "score"], "lang_pred", "score"]


def test_training_sample_is_bounded(documents):
    p = lang_id.Params(sample=50)
    m = lang_id.train(documents, p)
    n = documents.filter("lang IS NOT NULL").count()
    assert n > 100 and 0 < len(m.languages) <= 4


# --- pseudonyms ----------------------------------------------------------------------------------------------------

VALID = {
    "email": ["und.34@mail7.example.com", "A_b-9@x.de", "éàü.77@a-b.co.uk"],
    "ip": ["97.51.17.173", "255.0.0.1"],
    "ssn": ["123-45-6789", "899-01-0001"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "date": ["2020-02-29", "31/12/1999", "1/2/2003", "5.6.1987", "1700-01-01"],
    "phone": ["+1 (017) 555-7713", "017-555-7713", "+49 123 456-7890"],
    "card": ["4845168114407329", "4845 1681 1440 7329", "378282246310005"],
}
INVALID = ["300.1.1.1", "666-12-1234", "GB83 WEST 1234 5698 7654 32", "2021-02-29", "45/45/2000", "9807915762804490", "version 4.0.", "1.2.3.4.5", "a@b"]


def changed(spark, texts, key="k"):
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    return {r["id"]: r for r in pii.pseudonymise(df, key, kinds="kinds").collect()}


def luhn(value):
    digits = [int(c) for c in reversed(value) if c.isdigit()]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def shape(value):
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", value))


@pytest.mark.parametrize("kind", VALID)
def test_values_change_within_their_format(spark, kind):
    got = changed(spark, [f"x {v}, y {v}" for v in VALID[kind]])
    for i, v in enumerate(VALID[kind]):
        text, kinds = got[i]["text"], got[i]["kinds"]
        first, second = re.fullmatch(r"x (.*), y (.*)", text).groups()
        assert kinds == [kind, kind] and first == second != v
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in first.split("."))
        elif kind == "date":
            assert [*re.sub(r"\d", "", first)] == [*re.sub(r"\d", "", v)]
            assert {len(x) for x in re.findall(r"\d+", first)} <= {1, 2, 4}
        else:
            assert shape(first) == shape(v)
        if kind == "card":
            assert luhn(first)
        if kind == "iban":
            plain = first.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        if kind == "email":
            assert first.rsplit(".", 1)[1] == v.rsplit(".", 1)[1]


def test_equal_numbers_in_other_spellings_stay_linked(spark):
    got = changed(spark, ["4845168114407329", "4845 1681 1440 7329", "UND@A.COM", "und@a.com"])
    assert got[0]["text"] == got[1]["text"].replace(" ", "") and got[2]["text"].lower() == got[3]["text"]
    assert changed(spark, ["4845168114407329"], "other")[0]["text"] != got[0]["text"]


def test_invalid_values_and_secrets(spark):
    got = changed(spark, [*INVALID, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" !', "API_KEY: abcDEF12345", "tokens of a kind"])
    n = len(INVALID)
    assert [got[i]["text"] for i in range(n)] == INVALID
    assert re.fullmatch(r'token = "[0-9a-z]{40}" !', got[n]["text"]) and "04dbeb" not in got[n]["text"]
    assert got[n + 1]["text"] != "API_KEY: abcDEF12345" and got[n + 1]["text"].startswith("API_KEY: ")
    assert got[n + 2]["text"] == "tokens of a kind"


def test_permutations_are_one_to_one(spark):
    ips = [f"10.0.{a}.{b}" for a in range(16) for b in range(16)]
    days = [(date(1999, 1, 1).toordinal() + i) for i in range(400)]
    dates = [date.fromordinal(d).isoformat() for d in days]
    got = changed(spark, ips + dates)
    for part in (range(len(ips)), range(len(ips), len(ips) + len(dates))):
        values = [got[i]["text"] for i in part]
        assert len(set(values)) == len(values)
    for i in range(len(ips), len(got)):
        assert 1800 <= date.fromisoformat(got[i]["text"]).year < 2200


def test_feistel_against_brute_force(spark):
    def network(values, moduli, tweak, key):
        h = len(values) // 2
        left, right = [*zip(values[:h], moduli[:h])], [*zip(values[h:], moduli[h:])]
        for q in range(1, pii.ROUNDS + 1):
            other = ",".join(str(v) for v, _ in right)
            seed = hashlib.sha256("|".join([key, tweak, str(q), other]).encode()).hexdigest()
            digests = [hashlib.sha256(f"{seed}|{b}".encode()).hexdigest() for b in range(len(left) // 5 + 1)]
            add = [int(digests[j // 5][j % 5 * 12 : j % 5 * 12 + 12], 16) for j in range(len(left))]
            left, right = right, [((v + a) % m, m) for (v, m), a in zip(left, add)]
        return [v for v, _ in left + right]

    got = changed(spark, ["97.51.17.173", "2001-09-11"])
    assert got[0]["text"] == ".".join(map(str, network([97, 51, 17, 173], [256] * 4, "ip", "k")))
    n = (date(2001, 9, 11) - date(1800, 1, 1)).days
    a, b = network([n // 5411, n % 5411], [27, 5411], "date", "k")
    assert date.fromisoformat(got[1]["text"]).toordinal() == date(1800, 1, 1).toordinal() + a * 5411 + b


def test_the_key_is_in_no_plan(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "text string")
    made = pii.pseudonymise(df, "hush hush", kinds="kinds")
    plan = made._jdf.queryExecution()
    assert "hush" not in plan.toString() and "hush" not in plan.executedPlan().toString()
    assert made.first()["text"] != pii.pseudonymise(df, "other").first()["text"]


def test_pseudonyms_of_odd_rows(odd):
    got = pii.pseudonymise(odd, "k", kinds="kinds")
    assert got.columns == [*odd.columns, "kinds"]
    same = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert [(r["doc_id"], r["text"]) for r in got.collect()] == same and all(r["kinds"] == [] for r in got.collect())
    assert pii.pseudonymise(odd.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(odd, "it's")


# --- fingerprints --------------------------------------------------------------------------------------------------


def plain_units(text):
    """Units character by character."""
    out, held = [], ""
    for c in text:
        n = ord(c)
        alone = c in "/?&=#%+_;:-" or 0xE00 <= n <= 0x10FF or 0x1780 <= n <= 0x1DFF or n >= 0x2E80 and n != 0x3000
        space = c in " \t\n\x0b\f\r" or unicodedata.category(c).startswith("Z")
        closing = c in "aoAO0аоАОαοΑΟاא"
        if alone or space:
            out += [held] * bool(held) + [c] * (not space)
            held = ""
        elif closing:
            out.append(held + c)
            held = ""
        else:
            if len(held) == 4:
                out.append(held)
                held = ""
            held += c
    return out + [held] * bool(held)


def brute_fingerprint(spark, texts, p):
    """The same selection in plain Python; only the hash function is Spark's."""
    units = [plain_units(t or "") for t in texts]
    grams = [[tuple(u[i : i + p.k]) for i in range(max(len(u) - p.k + 1, 1 if u else 0))] for u in units]

    def hashed(rows, expression, schema):
        distinct = [*dict.fromkeys(rows)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(distinct)], f"i long, {schema}")
        return {distinct[r["i"]]: r["h"] for r in df.selectExpr("i", f"{expression} AS h").collect()}

    every = [*dict.fromkeys(g for gs in grams for g in gs)]
    chained = hashed([g[:2] if len(g) > 1 else (*g, None) for g in every], "xxhash64(a, b)", "a string, b string")
    chained = {g: chained[g[:2] if len(g) > 1 else (*g, None)] for g in every}
    for n in range(2, max(map(len, every), default=0)):
        more = hashed([(chained[g], g[n]) for g in every if len(g) > n], "xxhash64(a, b)", "a long, b string")
        chained |= {g: more[chained[g], g[n]] for g in every if len(g) > n}
    for _ in range(2, p.k):  # a missing unit hashes what is there once more
        short = [g for g in every if len(g) < p.k and len(g) <= _]
        again = hashed([(chained[g],) for g in short], "xxhash64(a)", "a long")
        chained |= {g: again[(chained[g],)] for g in short}
    first = {g: (h % 2**64) >> 31 for g, h in chained.items()}
    numbered = []
    for gs in grams:
        seen = Counter()
        row = []
        for g in gs:
            h = first[g]
            row.append((h, seen[h]))
            seen[h] += 1
        numbered.append(row)
    second = hashed([x for row in numbered for x in row], "xxhash64(a, b)", "a long, b int")
    kept = []
    for row in numbered:
        hs = [second[x] for x in row]
        most = sorted(hs)[: p.chosen][-1] if hs else None
        kept.append([h for h in hs if h <= most])
    tuples = [[tuple(k[i : i + p.tuple]) for i in range(max(len(k) - p.tuple + 1, 1))] if k else [] for k in kept]
    third = hashed([(x,) for ts in tuples for x in ts], "xxhash64(w) & 4294967295", "w array<long>")
    return ["".join(f"{h:08x}" for h in sorted({third[(x,)] for x in ts})) for ts in tuples]


@pytest.mark.parametrize("p", [fingerprint.Params(), fingerprint.Params(2, 8, 3), fingerprint.Params(1, 5, 1)])
def test_fingerprints_match_brute_force(spark, p):
    texts = ["", None, "one", "a b", "spam " * 300, "to be or not to be that is the question " * 9, "".join(map(str, range(400))), "Überwäßeñ о новом мире αλφα/βητα? ตัวอย่าง 日本語 ab\u3000cd " * 7, " ".join(f"w{i % 37} x{i % 11}" for i in range(500))]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    got = fingerprint.with_fingerprint(df, "text", "print", p).orderBy("id").collect()
    assert [r["print"] for r in got] == brute_fingerprint(spark, texts, p)


def test_work_of_a_step_is_not_repeated_inside_a_lambda(documents):
    plan = fingerprint.with_fingerprint(documents, "text", "print")._jdf.queryExecution().optimizedPlan().toString()
    kept = next(line for line in plan.splitlines() if "AS _kept" in line)
    assert "sort_array(_numbered" not in kept.split("lambda", 1)[1]
    numbered = next(line for line in plan.splitlines() if "AS _numbered" in line)
    assert "log2" not in numbered and "sort_array" not in numbered


def test_edited_texts_and_likeness(documents):
    rows = {r["doc_id"]: r for r in fingerprint.edited_pairs(documents).withColumn("near", fingerprint.likeness("fingerprint", "edited_fingerprint")).withColumn("apart", fingerprint.likeness("fingerprint", "next_fingerprint")).collect()}
    texts = [r["text"] for r in documents.orderBy("doc_id").collect()]
    keys = sorted(rows)
    prints = {}
    for n, k in enumerate(keys):
        text, following = texts[n], texts[(n + 1) % len(texts)]
        q = len(text) // 4
        assert rows[k]["edited"] == text[: len(text) - q] + following[:q]
        assert rows[k]["next_fingerprint"] == rows[keys[(n + 1) % len(keys)]]["fingerprint"]
        assert prints.setdefault(text, rows[k]["fingerprint"]) == rows[k]["fingerprint"]
    near, apart = ([rows[k][c] for k in keys] for c in ("near", "apart"))
    assert sorted(near)[len(near) // 2] > 0.4 and sum(apart) / len(apart) < 0.05


def test_order_matters(spark):
    a = [f"word{i}" for i in range(300)]
    texts = [" ".join(a), " ".join(a[150:] + a[:150]), " ".join(a[::-1])]
    df = fingerprint.with_fingerprint(spark.createDataFrame([(0, *texts)], "i long, a string, b string, c string"), "a", "fa")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "b", "fb"), "c", "fc")
    r = df.select(fingerprint.likeness("fa", "fb").alias("moved"), fingerprint.likeness("fa", "fc").alias("turned")).first()
    assert r["moved"] > 0.8 and r["turned"] < 0.1


def test_fingerprints_of_odd_rows(spark, odd):
    rows = fingerprint.edited_pairs(odd).collect()
    assert len(rows) == odd.count() and {r["fingerprint"] for r in rows if not (r["text"] or "").strip()} == {""}
    one = fingerprint.edited_pairs(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdefab" and one["next_fingerprint"] == one["fingerprint"]
    assert fingerprint.edited_pairs(odd.limit(0)).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------------

NASTY = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|im_end|>", "<|", "a\n<|im_end|>\n", "\\n", "é😀<|", "<" * 5 + "|"]


def test_assembly_is_reversible():
    roles = ["user", "assistant", "sys\ntem", "a\\nb", "<|im_start|>", ""]
    turns = [(r, t) for r in roles for t in NASTY]
    formatted, first, length = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    for (role, text), f, a, n in zip(turns, formatted.to_pylist(), first, length, strict=True):
        assert chat.read_turn(f) == (role, text)
        assert f.count(chat.START) == 1 and f.count(chat.END) == 1
        assert chat._plain(f[a : a + n]) == text
    assert len({f for f in formatted.to_pylist()}) == len(turns)
    whole = "".join(formatted.to_pylist())
    assert [chat.read_turn(m[0]) for m in chat._TURN.finditer(whole)] == turns


def test_conversations_match_brute_force(spark):
    rows = [(c, t, r, x) for c in range(20) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"]) for x in [NASTY[(c + t) % len(NASTY)]]]
    rows += [(99, 0, None, None), (99, None, "assistant", "first"), (99, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert len(got) == 22
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


# --- web records ---------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style>
<script>var t="</p><a href='/no'>";</script></head><body><!-- <a href="/hidden">x</a> --><h1>Head</h1><p>One <b>two</b>
three<br>four &lt;5&gt;</p><a href="/rel?x=1&amp;y=2">link</a><img src='i.png'></body></html>"""


def test_derivatives_of_a_page(spark):
    df = spark.createDataFrame([(1, "http://h.example/d/p", PAGE, "x")], "page_id long, url string, html string, record string")
    source = bytes(warc.responses(df).first()["record"])
    line, head, _ = warc.headers_of(source.partition(b"\r\n\r\n")[0])
    http = source.partition(b"\r\n\r\n")[2][: int(head["content-length"])]
    assert line == "WARC/1.1" and http.endswith(PAGE.encode())
    assert head["warc-block-digest"] == "sha256:" + hashlib.sha256(http).hexdigest()
    rows = {r["record_type"]: r for r in warc.serialised(warc.derive(warc.responses(df))).collect()}
    text, meta = rows["conversion"], json.loads(rows["metadata"]["block"])
    assert text["block"].split("\n") == ["A & B", "Head", "One two", "three", "four <5>", "link"]
    for r in rows.values():
        assert r["refers_to"] == head["warc-record-id"] and r["target_uri"] == "http://h.example/d/p" and r["date"] == head["warc-date"]
        assert r["payload_digest"] == head["warc-payload-digest"] == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert {k.lower(): v for k, v in r["headers"].items()} == head
        own = warc.headers_of(bytes(r["record"]).partition(b"\r\n\r\n")[0])[1]
        assert own["warc-refers-to"] == r["refers_to"] and int(own["content-length"]) == len(r["block"].encode())
    assert meta["Source-Headers"]["WARC-Record-ID"] == head["warc-record-id"] and meta["HTTP-Status"] == "HTTP/1.1 200 OK"
    assert meta["HTML"]["Title"] == "A & B"
    assert [x["url"] for x in meta["HTML"]["Links"]] == ["http://h.example/rel?x=1&y=2", "http://h.example/d/i.png"]
    assert len({r["record_id"] for r in rows.values()}) == 2


def test_codings_and_malformed_records(spark, tmp_path):
    import gzip

    body = "<p>grün</p>".encode("latin-1")
    packed = gzip.compress(body)
    chunked = b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: %d\r\n\r\n" % len(http)
    record = head + http + b"\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(other + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(other))
    read = warc.read_records(spark, str(tmp_path)).withColumn("page_id", F.lit(1)).collect()
    assert sorted(bytes(r["record"]) for r in read) == sorted([other, other, record, record])
    df = spark.createDataFrame([(1, record), (2, other), (3, b"junk"), (4, None), (5, b""), (6, record[:90])], "page_id long, record binary")
    rows = warc.derive(df).filter("record_type = 'conversion'").collect()
    assert [r["block"] for r in rows if r["page_id"] == 1] == ["grün"]
    assert {r["page_id"] for r in rows} == {1, 6}


def test_odd_pages(spark):
    pages = [(1, None, None), (2, "http://a", ""), (3, "bad\r\nurl: [", "<p>x"), (3, "bad\r\nurl: [", "<p>x"), (4, "http://a", "<!-- open"), (None, "u", "t" * 100_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, block string")
    rows = warc.derive(warc.responses(df)).collect()
    assert len(rows) == 2 * len(pages)
    text = {(r["page_id"], r["target_uri"]): r["block"] for r in rows if r["record_type"] == "conversion"}
    assert text == {(1, ""): "", (2, "http://a"): "", (3, "bad url: ["): "x", (4, "http://a"): "", (None, "u"): "t" * 100_000}
    assert warc.derive(warc.responses(df.limit(0))).count() == 0


def test_likeness_follows_edit_similarity(spark):
    """More edits, less likeness."""
    base = [f"w{i}" for i in range(400)]
    last = 1.1
    for step in (50, 10, 3):
        other = [("x" + w if i % step == 0 else w) for i, w in enumerate(base)]
        df = spark.createDataFrame([(" ".join(base), " ".join(other))], "a string, b string")
        df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb")
        now = df.select(fingerprint.likeness("fa", "fb").alias("n")).first()["n"]
        assert now < last and SequenceMatcher(None, base, other).ratio() < 1
        last = now


FOLLOWED = {
    "BE68 5390 0754 7034": ["BE68 5390 0754 7034 EUR 500", "BE68 5390 0754 7034 DE", "(BE68539007547034)"],
    "ES91 2100 0418 4502 0005 1332": ["ES91 2100 0418 4502 0005 1332 2024-01-01", "to ES91 2100 0418 4502 0005 1332 A1"],
    "NO93 8601 1117 947": ["NO93 8601 1117 947 NOK 12", "NO93 8601 1117 947 2024"],
    "4111 1111 1111 1111": ["ID12 4111 1111 1111 1111", "BE12 4111 1111 1111 1111", "DE12 4111 1111 1111 1111 11"],
    "+49 30 1234567": ["+49 30 1234567", "call +49 30 1234567 2024-01-01", "+49 30 1234567 EUR"],
    "+33 1 23 45 67 89": ["+33 1 23 45 67 89."],
    "+493012345678": ["+493012345678"],
    "+44 (0)20 7946 0958": ["+44 (0)20 7946 0958"],
    "020 7946 0958": ["020 7946 0958", "(020) 7946 0958", "020 7946 0958 EUR"],
    "030 1234567": ["030 1234567", "(030) 1234567"],
    "01 23 45 67 89": ["01 23 45 67 89", "01.23.45.67.89"],
}


@pytest.mark.parametrize("value", FOLLOWED)
def test_values_next_to_words_and_numbers_are_found(spark, value):
    digits = lambda t: re.sub(r"\D", "", t)
    got = changed(spark, FOLLOWED[value])
    for i, text in enumerate(FOLLOWED[value]):
        new = got[i]["text"]
        assert shape(new) == shape(text) or "-01-01" in text
        assert got[i]["kinds"] and digits(value)[4:] not in digits(new), (text, new)
        for word in ("EUR", "NOK", "call", "ID12", "BE12", "DE12"):
            assert (word in new) == (word in text)
        if "-01-01" in text:
            date.fromisoformat(new[-10:])


UNBROKEN = {"Han": range(0x4E00, 0x4E00 + 5000), "Hiragana": range(0x3041, 0x3091), "Thai": range(0x0E01, 0x0E29), "hexadecimal": b"0123456789abcdef", "letters": b"abcdefghijklmnopqrstuvwxyz", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "Cyrillic": range(0x0430, 0x0450)}


@pytest.mark.parametrize("kind", [*UNBROKEN, "address"])
def test_one_inserted_character_costs_little_without_spaces(spark, kind):
    at = random.Random(3)
    if kind == "address":
        text, new = "https://a.b/" + "/".join(f"{at.randrange(10**5)}?k={at.randrange(10**4)}" for _ in range(300)), "x"
    else:
        text = "".join(map(chr, at.choices(UNBROKEN[kind], k=4000)))
        new = text[777]
    pairs = [(text, text[:i] + new + text[i:]) for i in (0, 1000, 2500)] + [(text, text[:1000] + text[1001:])]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb")
    assert min(r["n"] for r in df.select(fingerprint.likeness("fa", "fb").alias("n")).collect()) > 0.8


def test_ascii_texts_have_the_same_units_either_way(spark, documents):
    df = documents.filter("octet_length(text) = char_length(text)").select("text")
    either = df.select(*[fingerprint.F.expr("regexp_extract_all(text, '{}', 0)".format(u.replace("\\", "\\\\"))).alias(n) for n, u in (("a", fingerprint.ASCII_UNITS), ("b", fingerprint.UNITS))])
    assert either.count() > 20 and either.filter("a <> b").count() == 0


def test_ideographic_space_parts_words(spark):
    df = spark.createDataFrame([(0, "ab cd"), (1, "ab\u3000cd"), (2, "\u3000")], "i long, text string")
    one, two, blank = (r["p"] for r in fingerprint.with_fingerprint(df, "text", "p").orderBy("i").collect())
    assert one == two and blank == ""
