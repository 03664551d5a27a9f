"""The stages against plain versions of what they promise, and the registered queries."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from holdfast.llm import lang_id, pii, queries
from holdfast.session import materialise
from tests.llm.conftest import SF
from tests.llm.test_near_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, documents):
    junk = spark.createDataFrame(
        [(10_001, "123 456 !!", None, "s", 10), (10_002, None, "en", "s", 0), (10_003, "", "en", "s", 0), (10_004, "### ---", None, None, None)],
        documents.schema,
    )
    again = documents.limit(3).union(documents.limit(2).withColumn("doc_id", F.col("doc_id") + 20_000))
    docs = materialise(documents.union(junk).union(again))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF)))
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "pii_pseudonyms", "packing"]


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:4]:
        assert df.schema.names == stages[0].schema.names
        assert [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_language_rejects_texts_without_language_only(stages):
    before, after = stages[0].collect(), stages[1].collect()
    model = lang_id.train(stages[0])
    want = Counter()
    for r in before:
        name, score = lang_id.scored([r["text"] or ""], model, lang_id.Params(), corpus_pipeline.UNUSUAL)
        if name[0] != "und" and score[0] >= corpus_pipeline.SURE:
            want[(r["doc_id"], r["text"])] += 1
    assert Counter((r["doc_id"], r["text"]) for r in after) == want
    assert not {10_001, 10_002, 10_003, 10_004} & {r["doc_id"] for r in after}


def test_near_dedup_keeps_one_of_each_group(stages):
    texts = {k: r["text"] for k, r in rows_of(stages[1]).items()}
    kept = stages[2].collect()
    want = {k for k, (_, component) in brute(texts, 5).items() if k == component}
    assert Counter(r["doc_id"] for r in kept) == Counter(want)
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)


def test_no_text_is_lost_where_ids_repeat(spark, documents):
    """Two texts under one id are judged by their own copies; rows without id all stay."""
    one, two = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(1, one), (1, two), (2, one), (2, one + " end"), (3, two), (3, two), (None, one), (None, one)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], documents.schema)
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, SF).collect())
    assert kept == Counter({(1, one): 1, (1, two): 1, (None, one): 2})


def test_languages_that_were_not_learnt_are_rejected(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    strange = {
        1: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. " * 3,
        2: "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3,
        3: "xq zvkw jjqp wwxz kqvj zzxq pqwk vxjz qkzw jxvq " * 8,
    }
    new = spark.createDataFrame([(-i, t, None, "s", len(t)) for i, t in strange.items()], documents.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, documents.union(new), SF).collect()}
    assert not kept & {-1, -2, -3}
    clean = {r["doc_id"] for r in documents.filter("text RLIKE '[a-z]' AND NOT text RLIKE '[#$%&*!|0-9]'").collect()}
    assert len(clean) > 2000 and clean <= kept


def test_too_many_languages_are_refused(spark, documents):
    dirty = documents.withColumn("lang", F.concat("lang", F.col("doc_id").cast("string")))
    with pytest.raises(ValueError, match="languages"):
        lang_id.train(dirty, lang_id.Params(languages=20))


def test_pseudonyms_change_personal_data_only(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    assert before.keys() == after.keys()
    changed = 0
    for k, r in after.items():
        old = before[k]["text"]
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (before[k]["lang"], before[k]["source"])
        if old != r["text"]:
            changed += 1
            assert re.search(r"[0-9@=:]", old)
        for address in re.findall(r"[\w.]+@mail\d\.example\.com", old):
            assert address not in r["text"]
    assert changed and corpus_pipeline.PSEUDONYM_KEY and pii.ROUNDS % 2 == 0


def test_packing_holds_every_token_once(stages):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    ids = {k: [*library.encode(r["text"], add_special_tokens=False).ids, 0] for k, r in rows_of(stages[3]).items()}
    seen, places = Counter(), {}
    for r in stages[4].collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, dtype="<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {k: len(v) for k, v in ids.items()}
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024


def test_run_equals_the_stages(spark, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
    got = corpus_pipeline.run(spark, SF)
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, got.select(*keys).collect())) == Counter(map(tuple, docs.select(*keys).collect()))


def test_one_query_for_each_operator(spark):
    assert [re.match(r"op(\d+)_", name)[1] for name in queries.QUERIES] == [str(n) for n in range(1, 14)]
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    counts = {name: query(spark, SF).count() for name, query in queries.QUERIES.items()}
    conversations = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    for name, n in counts.items():
        if name.startswith(("op1_", "op2", "op3", "op5", "op6", "op8", "op13")):
            assert n == documents, name
    assert counts["op4_warc_derivatives"] == 2 * pages
    assert counts["op7_chat_format"] == conversations + 1
    assert counts["op9_packing"] >= documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_token_queries_equal_the_library(spark, documents):
    """Every column of op2 and op5 against the library's own encoding and decoding."""
    words, sub = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for t in (words, sub):
        t.no_truncation()
        t.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in queries.op2_bpe_round_trip(spark, SF).collect():
        ids = words.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(words.decode(ids, skip_special_tokens=False)))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    for r in queries.op5_token_counts(spark, SF).collect():
        n = len(sub.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_chat_query_reads_every_turn_back(spark):
    """Every digest column of op7 against the turns themselves, conversation -1 too."""
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {-1: [("user", said), ("assistant", said)]}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for r in rows:
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = rows_by(queries.op7_chat_format(spark, SF), "conv_id")
    assert got.keys() == turns.keys()
    for k, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        want = (len(own), sha("".join(f"{role}\n{t}\n" for role, t in own)), len(loss), sha(loss))
        assert tuple(got[k][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
        assert got[k]["formatted_chars"] > sum(len(role) + len(t) for role, t in own)


def test_fingerprint_query_holds_the_edited_texts(spark, documents):
    texts = [(r["doc_id"], r["text"] or "") for r in documents.orderBy("doc_id").collect()]
    got = rows_by(queries.op8_order_minhash_fingerprints(spark, SF), "doc_id")
    for n, (k, text) in enumerate(texts):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + texts[(n + 1) % len(texts)][1][:quarter]
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(text), sha(edited))
        prints = [{p[i : i + 8] for i in range(0, len(p), 8)} for p in (got[k]["fingerprint"], got[k]["edited_fingerprint"], got[texts[(n + 1) % len(texts)][0]]["fingerprint"])]
        for name, other in (("near_edited", prints[1]), ("near_next", prints[2])):
            union = len(prints[0] | other)
            assert got[k][name] == pytest.approx(len(prints[0] & other) / union if union else 1.0)


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}
