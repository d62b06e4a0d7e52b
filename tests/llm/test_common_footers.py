"""Unrelated short texts with a footer in common: the work must grow as the texts do."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberstream.llm import shingle_join
from emberstream.llm.shingle_join import Rule

FOOTER = " all rights reserved see the terms of use for details"


def texts(n: int, seed: int) -> list[str]:
    r = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in r.integers(0, 1 << 40, r.integers(20, 51))) + FOOTER for _ in range(n)]


def sets(rows: list[str], rule: Rule):
    parts = list(shingle_join.shingles(pa.array(rows), rule.words))
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x, _ in parts]))])
    return at, np.concatenate([g for _, _, g in parts])


@pytest.mark.parametrize("rule", [Rule(4, 85, 100), Rule()])
def test_a_footer_is_sent_by_few(spark, rule):
    rows = texts(2000, 5)
    at, grams = sets(rows, rule)
    frequent = shingle_join.frequencies(spark.createDataFrame([(t,) for t in rows], "text string").repartition(4), rule)
    largest = [np.unique(shingle_join.segment_keys(at, grams, rule, f)[1], return_counts=True)[1].max() for f in (None, frequent)]
    assert largest[0] > 500 and largest[1] < 20


@pytest.mark.parametrize("level", [0, 1, 2])
def test_any_order_is_exact(level):
    rule, r = Rule(4, 85, 100), np.random.default_rng(level)
    frequent = r.integers(0, 3, shingle_join.SLOTS).astype(np.uint8) * level
    for size in (1, 3, 9, 40, 63, 64, 66, 120, 400):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 62, size).astype(np.uint64))
            d = int(rule.largest_difference(2 * size))
            drop, more = d // 2, d - d // 2
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 1 << 62, more).astype(np.uint64)]))
            if not rule.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                continue
            row, key = shingle_join.segment_keys(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), rule, frequent)
            assert set(key[row == 0]) & set(key[row == 1])


def test_dealt_rows_grow_as_the_texts(spark, monkeypatch):
    dealt, deal = [], shingle_join._deal

    def counted(rest):
        out = deal(rest)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(shingle_join, "_deal", counted)
    totals = []
    for n in (1500, 3000):
        rows = texts(n, n)
        rows += [rows[7] + " more", rows[9]]  # a near copy and a copy
        dealt.clear()
        got = shingle_join.components(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4), Rule(4, 85, 100))
        links = {(x["id"], x["component_id"]) for x in got.where(F.col("id") != F.col("component_id")).collect()}
        assert links == {(n, 7), (n + 1, 9)}
        totals.append(sum(dealt))
    assert totals[0] < 150 and totals[1] < 300


def test_documents_without_sets_have_no_frequencies(spark):
    for rows in ([], [(None,), ("",), (" \t",)]):
        assert not shingle_join.frequencies(spark.createDataFrame(rows, "text string"), Rule()).any()
