"""Samples that repeated or null ids do not empty, stretches without blanks, clashing names, null parts."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from emberstream.llm import byte_bpe, chat, langid, toxicity
from emberstream.llm.queries import tokenizer


@pytest.fixture(scope="module")
def library():
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    return byte_bpe.ByteBPE(byte_bpe.read_ranks(path), pattern)


def test_stretches_without_blanks_have_the_librarys_ids(codec, library):
    random.seed(8)
    everything = [chr(c) for c in [*range(1, 0x20), *range(0x21, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200), *range(0x10FF00, 0x110000)]]
    random.shuffle(everything)
    for at in range(0, len(everything), 9000):
        text = "".join(everything[at : at + 9000])
        assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.encode("\U00016eb6悄" * 5000) == library.encode_ordinary("\U00016eb6悄" * 5000)


def test_runs_of_white_space_are_matched_as_the_library_does(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WHITE", 40)
    monkeypatch.setattr(byte_bpe, "STRETCH", 64)
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    codec = byte_bpe.ByteBPE(byte_bpe.read_ranks(path), pattern)
    random.seed(9)
    blanks = [" ", "\n", "\t", "\r\n", "\xa0", "　", "\x85", "\x1c", " "]
    for _ in range(400):
        parts = ["".join(random.choice(blanks[: random.choice((1, 2, 9))]) for _ in range(random.choice((1, 3, 39, 41, 200)))) + random.choice(["x", "word", "'s", "1", "?!", "", "é悄", "​"]) for _ in range(6)]
        text = random.choice(["", "begin"]) + "".join(parts)
        assert codec.encode(text) == library.encode_ordinary(text)


def test_white_space_that_the_library_fails_on(codec):
    text = "a" + " \n" * 1_000_000 + "b"
    assert codec.decode(codec.encode(text)) == text.encode()


def test_columns_of_the_results_names_are_replaced_in_any_case(spark):
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "some text", 5, "x")], "doc_id bigint, text string, IDS int, Decoded string")
    row = byte_bpe.encode_decode(docs, path, pattern).select("doc_id", "ids", "decoded").first()
    assert bytes(row["decoded"]) == b"some text" and len(row["ids"]) == 8


def test_one_id_does_not_fill_the_sample_of_toxic_texts(spark):
    good, bad = "a calm and friendly sentence about the garden", "you zorkblat grumfiz idiot zorkblat"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(401)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows + [(1, good)] * 3500, "doc_id bigint, text string")
    model = toxicity.fit(docs, labels)
    got = {r["text"]: r["score"] for r in toxicity.score(spark.createDataFrame([(1, good), (2, bad)], "doc_id bigint, text string"), model).collect()}
    assert got[good] < 0.3 <= got[bad]


@pytest.mark.parametrize("own", [None, 3, 5000])
def test_no_language_is_lost_to_repeated_or_null_ids(spark, own):
    words = {"xx": "lalo mira tenu sopa", "yy": "krzt brnov hrdo sklep", "zz": "only one text of this"}
    rows = [(i, f"{words['xx']} {i}", "xx") for i in range(1000)] + [(own, f"{words['yy']} {i}", "yy") for i in range(3000)] + [(own, words["zz"], "zz")] * 900
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, held_out_fold=None)
    assert sorted(model.languages) == ["xx", "yy", "zz"]
    got = langid.predict(docs.select("doc_id", "text").where(F.col("text").startswith("krzt")), model)
    assert got.where("lang_pred = 'yy'").count() > 2900


def test_more_languages_than_the_bound_keep_the_most_frequent(spark):
    rows = [(i, f"word{i % 250} sample", f"l{i % 250:03d}") for i in range(750)] + [(i, "word249 sample", "l249") for i in range(1000, 1010)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), held_out_fold=None, max_per_lang=2)
    assert len(model.languages) == 200 and "l249" in model.languages


def test_a_null_part_says_nothing():
    flat = chat.PartVisitor().flatten([None, {"type": "text", "text": "a"}, None, {"type": "image", "ref": "r", "width": 28, "height": 28}])
    assert flat.text == "a<image:0>" and flat.expanded_tokens == 1
