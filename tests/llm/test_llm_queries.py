"""Every query of the subpackage over whole tables at the smallest scale."""

import hashlib
import importlib.util
import math
import re
import zlib
from collections import Counter

import pytest

from emberstream.llm import queries as llm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(same, name):
    same(llm.queries()[name], llm.oracle_sql()[name])


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_op2(spark, small, documents):
    rows = {r["doc_id"]: r for r in llm.op2_subword_toxicity(spark, small).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert rows.keys() == documents.keys()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(toxic[i], rows[i]["predicted"]) for i in toxic if rows[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.85


def test_op4_base_is_exact_and_the_model_is_better(spark, small, documents):
    rows = {r["doc_id"]: r for r in llm.op4_hidden_markov(spark, small).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    words = {i: WORD.findall(lower(r["text"])) + [None] for i, r in documents.items()}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, ws in words.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in count for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0
    out = [r for i, r in rows.items() if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op6_is_what_the_library_gives(spark, small, documents):
    import base64

    import tiktoken

    path, pattern = llm.tokenizer("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in llm.op6_byte_bpe(spark, small).collect():
        text = documents[r["doc_id"]]["text"] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op7(spark, small, documents):
    rows = {r["doc_id"]: r for r in llm.op7_byte_cnn(spark, small).collect()}
    assert rows.keys() == documents.keys() and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i, r in rows.items() if r["held_out"]]
    assert sum(rows[i]["lang_pred"] == documents[i]["lang"] for i in held) / len(held) > 0.9


def test_op10_limits(spark, small):
    rows = llm.op10_fair_queue(spark, small).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= 1.5 * sum(r["size"] for r in rows)
    again = {r["doc_id"]: r["taken"] for r in llm.op10_fair_queue(spark, small).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_against_brute_force(spark, small, documents):
    import corpus_pipeline as cp

    from emberstream.llm import toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    clean = {r["doc_id"]: r["text"] or "" for r in toxicity.reject(docs, model).collect()}
    first = {}
    for i in sorted(clean):
        first.setdefault(clean[i], i)
    sets = {}
    for i in sorted(first.values()):
        w = WORD.findall(lower(clean[i]))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = [i for i in ids if find(i) == i]
    size = {i: len(WORD.findall(clean[i])) for i in left}
    rows = cp.run(spark, small).collect()
    assert Counter(r["doc_id"] for r in rows) == fair_queue({i: (documents[i]["source"], n) for i, n in size.items()})
    assert all(r["decoded_sha256"] == hashlib.sha256(clean[r["doc_id"]].encode()).hexdigest() for r in rows)


def fair_queue(docs, weights=(3, 1, 2), budget=1.5, most=2):
    """How often each document (source, size) is taken, one instance after another."""
    sources = sorted({s for s, _ in docs.values()}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for t, n in docs.values() if t == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    limit = budget * sum(whole.values())
    target, free, left = {}, set(sources), limit
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        full = {s for s in free if share[s] > most * whole[s]}
        for s in full or free:
            target[s] = most * whole[s] if full else share[s]
        left, free = left - sum(target[s] for s in full), free - full if full else set()
    line = []
    for rank, s in enumerate(sources):
        upto = 0
        for i in sorted((i for i, (t, n) in docs.items() if t == s and n), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            upto += docs[i][1]
            line += [((upto + e * whole[s]) / target[s], rank, e, upto, i) for e in range(most)]
    taken, words = Counter(), 0
    for *_, i in sorted(line):
        words += docs[i][1]
        if words > limit:
            break
        taken[i] += 1
    return taken
