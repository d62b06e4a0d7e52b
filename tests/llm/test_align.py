"""Alignment of two tokenizers against a plain walk over their tokens; ids against the library."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from emberstream.llm import align
from emberstream.llm.queries import op13_overlap_groups, tokenizer


@pytest.fixture(scope="module")
def both():
    (a, pattern), (b, _) = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    return align._Both(Path(a).read_text(), Path(b).read_bytes(), pattern)


def plain(both, rows):
    """What the query returns, document by document, by libraries alone."""
    done = []
    for i, text in rows:
        a = both.whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        x, y = [both.a_bytes[t] for t in a], [both.b_bytes[t] for t in b]
        if text and (b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode()):
            a, b, x, y = [], [], [], []
        ends_a, ends_b = list(itertools.accumulate(map(len, x))), list(itertools.accumulate(map(len, y)))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([t for t, e in zip(a, ends_a, strict=True) if lo < e <= hi], [t for t, e in zip(b, ends_b, strict=True) if lo < e <= hi]) for lo, hi in itertools.pairwise([0, *cuts])]
        place = {e: t for t, e in zip(b, ends_b, strict=True)}
        done.append((i, a, b, groups, [(t, place[e]) for t, e in zip(a, ends_a, strict=True) if e in place]))
    count = Counter(p for *_, links in done for p in links)
    most = defaultdict(int)
    for (_, t), n in count.items():
        most[t] = max(most[t], n)
    out = []
    for i, a, b, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def aligned(spark, rows):
    (a, pattern), (b, _) = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id bigint, text string, row int, pairs string, n int").repartition(3)
    return sorted((tuple(r) for r in align.align(docs, a, b, pattern).collect()), key=repr)


def odd_texts():
    random.seed(2)
    pieces = ["hello", " world", "  ", "\n", "\t", "<|endoftext|>", "<s>", "</s>", "<unk>", "▁", "é", "ü", "ﬁ", "中文", "🙂", "don't", "1234", " ", "　", "\x85", "\x1c", "\x00", "ǅ", "ß", "a" * 50, "...", "Ġ", "<0x41>", "﻿", "é"]
    return ["".join(random.choice(pieces) for _ in range(random.randrange(1, 12))) for _ in range(300)]


@pytest.mark.parametrize("known", [1 << 18, 7, 0])
def test_against_plain_counts(spark, both, monkeypatch, known):
    monkeypatch.setattr(align, "KNOWN", known)
    rows = list(enumerate(odd_texts())) + [(500, None), (501, ""), (502, " "), (503, "word " * 3000), (None, "no id"), (504, "twice the same"), (504, "twice the same"), (505, "x" * 9000), (506, "the end ")]
    assert aligned(spark, rows) == plain(both, rows)


def test_empty_table(spark):
    assert aligned(spark, []) == []


def test_query(spark, small, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = op13_overlap_groups(spark, small).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(both, rows)


def test_ids_are_the_same_by_both_libraries(both):
    latin = [chr(c) for c in range(0x250) if not align._OTHER.search(chr(c))]
    assert len(latin) > 500 and both.fast is not None
    random.seed(4)
    texts = ["".join(random.choice(latin) for _ in range(random.randrange(1, 30))) for _ in range(3000)]
    texts += [f" {x}{y}{z}" for x in latin for y in " \n'" for z in "a1. \n"] + ["'s'S 're'LL don't", "a" * 4000 + " b", "<|endoftext|> x"]
    for t in texts:
        assert both.fast.encode_ordinary(t) == both.whole.encode(t, add_special_tokens=False).ids


def test_components_are_those_of_the_graph():
    import numpy as np

    random.seed(3)
    for _ in range(200):
        n = random.randrange(1, 40)
        cuts = [sorted({0, *random.sample(range(n), random.randrange(n))}) for _ in range(2)]
        ga, gb = align.components(*(np.array(c) for c in cuts))
        common = sorted(set(cuts[0]) & set(cuts[1]))
        for starts, got in zip(cuts, (ga, gb), strict=True):
            assert got.tolist() == [sum(c <= s for c in common) - 1 for s in starts]
