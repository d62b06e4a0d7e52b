"""What a worker of the pipeline holds: one engine's tables, and temporaries of bounded slices of text."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from emberstream.llm import byte_bpe, shingle_join
from emberstream.llm.queries import tokenizer


def test_second_engine_is_made_for_long_white_space_only():
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    codec = byte_bpe.ByteBPE(byte_bpe.read_ranks(path), pattern)
    assert codec.decode(codec.encode("some words, é \U0001f600 " * 2000)) == ("some words, é \U0001f600 " * 2000).encode()
    assert "_one" not in vars(codec)
    text = "a" + " " * (byte_bpe.WHITE + 5) + "b"
    assert codec.decode(codec.encode(text)) == text.encode()
    assert "_one" in vars(codec)
    with pytest.raises(KeyError):
        codec.decode([10**6])


def test_shingles_of_many_texts_hold_a_slice_at_a_time():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(map(str, rng.integers(0, 10**6, 2000))) for _ in range(150)])
    sum(1 for _ in shingle_join.shingles(texts, 5))  # what the first pass makes once does not count
    tracemalloc.start()
    made = sum(len(grams) for _, _, grams in shingle_join.shingles(texts, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 150 * 1996
    assert peak < 10e6, peak


def test_stages_bound_their_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    try:
        spark.conf.unset(key)
        corpus_pipeline.bpe_stage(spark, docs, "")
        assert spark.conf.get(key) == corpus_pipeline.BATCH
        spark.conf.set(key, "2m")
        corpus_pipeline.bpe_stage(spark, docs, "")
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
