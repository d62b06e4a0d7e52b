"""Substring dedup against a plain table of windows, on texts with every kind of repeat."""

import hashlib
import random

import pytest

from emberstream.llm import substrings

SCHEMA = "doc_id bigint, text string, key string, spans int, id string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "k", 1, "x") for i, t in rows], SCHEMA).repartition(parts)


def plain(rows, n=20):
    """Row by row: words, removed words, digest."""
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            least[g] = min(least.get(g, float("inf")), float("inf") if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        own, gone = set(), set()
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if least[g] < (float("inf") if i is None else i) or g in own:
                gone |= set(range(s, s + n))
            own.add(g)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def made():
    random.seed(5)
    some = lambda n, of=4000: [f"w{random.randrange(of)}" for _ in range(n)]
    line, passage, long = some(15), some(60), some(400)
    rows = []
    for i in range(120):
        w = some(random.randrange(60))
        kind = i % 8
        if kind == 1:
            w = w + line + some(12)  # too short a line to count
        elif kind == 2:
            at = random.randrange(30)
            w = w + passage[at : at + random.randrange(15, 45)] + some(random.randrange(10))
        elif kind == 3:
            w = long[random.randrange(300) :]
        elif kind == 4:
            w = w + ["again"] * random.randrange(18, 50)  # repeats itself, one word apart
        elif kind == 5:
            w = w + passage + w + passage[:30]
        elif kind == 6:
            w = random.choice([passage, long])
        rows.append((random.randrange(1000), random.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "x " * 200), (2003, "x " * 200), (None, "x " * 200), (None, " ".join(passage)), (2004, "É " * 19 + "É"), (1999, "é " * 40)]
    return rows


def digested(spark, rows, parts=3):
    return sorted((tuple(r) for r in substrings.digests(frame(spark, rows, parts)).collect()), key=repr)


@pytest.mark.parametrize("combine", [1 << 19, 40])
def test_against_all_windows(spark, monkeypatch, combine):
    monkeypatch.setattr(substrings, "COMBINE", combine)
    rows = made()
    assert digested(spark, rows) == plain(rows)
    assert digested(spark, rows, 1) == plain(rows)


def test_rows_of_one_id_are_judged_by_smaller_ids_and_themselves(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, text + " more"), (5, "other " + text + " " + text), (4, text[:-4])]
    assert digested(spark, rows) == plain(rows)


def test_a_very_long_text_and_very_many_copies(spark):
    random.seed(6)
    long = " ".join(f"v{random.randrange(50_000)}" for _ in range(300_000))
    rows = [(1, long), (2, long[: len(long) // 2])] + [(i, " ".join(f"c{k}" for k in range(25))) for i in range(10, 2010)]
    assert digested(spark, rows) == plain(rows)


def test_outputs(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = frame(spark, [(1, passage), (2, "a b " + passage + " c " + passage), (3, None)])
    assert [tuple(r) for r in substrings.repeats(docs).orderBy("first_word").collect()] == [(2, 2, 32), (2, 33, 63)]
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == {1: passage, 2: "a b c", 3: ""}
    empty = frame(spark, [])
    assert substrings.digests(empty).count() == substrings.repeats(empty).count() == substrings.without_repeats(empty).count() == 0
    assert [tuple(r) for r in substrings.repeats(docs, words=40).collect()] == []
    with pytest.raises(ValueError):
        substrings.digests(docs, words=5)
