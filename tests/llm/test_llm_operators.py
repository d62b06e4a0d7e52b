"""Small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberstream.llm import byte_bpe, chat, content_sort, hmm, langid, mixing, near_vectors, shingle_join, toxicity, warc, workspace
from emberstream.llm.queries import tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, id string, row int"


def docs(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, s, None, None, "x", 1) for i, t, s in rows], DOCS)


MIXED = [(1, "same text here", "a"), (2, "same text here", "a"), (3, None, None), (4, "", "b"), (5, "word " * 30_000, "a"), (2, "same text here", "a"), (None, "same text here", "b"), (None, None, None), (7, "Same text here", "c")]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (6, 6), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 10)]
    got = {r["node"]: r["component"] for r in workspace.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | dict.fromkeys(range(10, 16), 10)
    star = [(0, i) for i in range(1, 50)] + [(i, i + 100) for i in range(1, 50)]
    got = workspace.connected_components(spark.createDataFrame(star, "a bigint, b bigint"))
    assert got.count() == 99 and got.where("component <> 0").isEmpty()
    assert workspace.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 WARC


def archive(spark, tmp_path, rows):
    path = f"file://{tmp_path}/w{random.random()}"
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string, id string, sha int"), path)
    return warc.resolve(warc.read(spark, path)).collect()


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_rejects_magic_inside_payloads(spark, tmp_path):
    random.seed(3)
    make = [lambda: None, lambda: "x" * random.randrange(300), lambda: "a\r\n\r\n" + FAKE * random.randrange(1, 4) + "b", lambda: "\r\n\r\n" + FAKE, lambda: "ends\r\n", lambda: "same body " * 20, lambda: "\r\n\r\nWARC/1.0\r\nContent-Length: 900\r\n\r\n" + "é" * random.randrange(50)]
    rows = [(i, f"http://a/WARC/{i}\r\nx", make[i % 7](), None, None) for i in range(70)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # splits inside records
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["id"]: r for r in archive(spark, tmp_path, rows)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert len(got) == 70
    first = {}
    for i, _, body, *_ in rows:
        data = (body or "").encode()
        f = first.setdefault(data, i) if len(data) >= 100 else i
        want = ("response", None) if f == i else ("revisit", f)
        assert (got[i]["n"], got[i]["sha"], got[i]["kind"], got[i]["refers"]) == (len(data), hashlib.sha256(data).hexdigest(), *want)


def test_warc_edges(spark, tmp_path):
    assert archive(spark, tmp_path, []) == []
    big = "z" * 3_000_000
    rows = archive(spark, tmp_path, [(2, None, big, None, 1), (1, None, big, None, 1), (None, None, None, None, None), (5, "u", "y" * 150, "", 0), (5, "u", "y" * 150, "", 0)])
    assert len(rows) == 5
    assert {(r["id"], r["kind"], r["refers"]) for r in rows} == {(1, "response", None), (2, "revisit", 1), (None, "response", None), (5, "response", None)}
    assert warc.parse(b"1.0\r\nno length\r\n\r\n") is None and warc.parse(b"not a version") is None


def test_warc_payloads_that_start_with_magic(spark, tmp_path):
    huge = FAKE.replace("Length: 5", "Length: " + "9" * 30).replace("page:999", "page:" + "9" * 30)
    odd = FAKE.replace("page:999", "page:--7").replace("Length: 5", "Length: " + "9" * 5000)
    bodies = ["WARC/", "WARC/1.0\r\n", "\r\nWARC/", FAKE, "\r\n" + FAKE * 2, "\r\n\r\n" + huge, "a\r\n\r\n" + odd, FAKE.replace("page:999", "page:\u00b2"), "\r", "\r\n", "ends in\r\n\r\nWARC/"]
    bodies = [b for body in bodies for b in (body, "plain")]
    rows = [(i, "http://a/", bodies[i % len(bodies)], None, None) for i in range(2 * len(bodies))]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, id string, sha int").coalesce(1)
    path = f"file://{tmp_path}/magic"
    warc.write(table, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for size in ("128m", "1009"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r["id"]: (r["n"], r["sha"]) for r in warc.read(spark, path).where("kind = 'response'").collect()}
            first = {}
            for i, _, body, *_ in rows:
                data = body.encode()
                if len(data) < 100 or first.setdefault(data, i) == i:
                    assert got.pop(i) == (len(data), hashlib.sha256(data).hexdigest()), (size, i, body[:40])
            assert not got
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_warc_broken_ends(spark, tmp_path):
    whole = FAKE.replace("999", "1")
    for i, tail in enumerate(["WARC/1.0\r\nContent-Length: 3", "WARC/1.0\r\nno length\r\n\r\n" + whole]):
        (tmp_path / f"{i}.warc").write_bytes((whole + tail).encode())
        assert [(r["id"], r["n"]) for r in warc.read(spark, f"file://{tmp_path}/{i}.warc").collect()] == [(1, 5)]
    assert warc.parse(b"1.0\r\nContent-Length: 007\r\n\r\n")[1] == 7 and warc.parse(b"1.0\r\nContent-Length: 000\r\n\r\n")[1] == 0


# --- 2 toxicity, 7 language


def test_toxicity_and_misspellings():
    rng = random.Random(1)
    plain = ["".join(rng.choice(["ba", "do", "ri", "lu", "ne"]) for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["horrible", "terrible", "wretched"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels))
    score = model.score(pa.array([*texts, None, "", "ne ba WRETCHED, lu", "ne wretchedd lu", "...", "x" * 100_000]))
    assert ((score[:300] >= 0.3) == np.array(labels)).mean() > 0.98
    assert score[300] == score[301] == score[304] and score[300] < 0.3 < score[302]
    assert score[303] > score[300] and np.isfinite(score).all()
    alone = [float(model.score(pa.array([t]))[0]) for t in texts[:20]]
    assert np.allclose(alone, score[:20], atol=1e-9)
    # without training the random vectors know nothing
    y = np.array(labels)
    auc = lambda s: (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc(score[:300]) > 0.98
    assert abs(np.mean([auc(toxicity.train(texts, y, epochs=(0, 0), seed=k).score(pa.array(texts))) for k in range(6)]) - 0.5) < 0.15


def test_toxicity_scores_against_a_loop_over_words():
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(rng.normal(0, 1, toxicity.BUCKETS), -0.5)

    def bucket(gram):
        h = np.array([gram[0]], np.uint32)
        for c in gram[1:]:
            h = (h * np.uint32(16777619)) ^ np.uint32(c)
        h = (h ^ (h >> np.uint32(15)) ^ np.uint32(len(gram) * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
        return int(h[0] >> np.uint32(15))

    def slow(text):
        words = [b" " + w + b" " for w in "".join(" " if c in toxicity._END_SIGNS else c for c in text.lower()).encode().split(b" ") if w]
        grams = [[bucket(w[i : i + n]) for n in toxicity.LENGTHS for i in range(len(w) - n + 1)] for w in words]
        last = max(1, len(grams) - toxicity.WINDOW_WORDS + 1)
        bags = [sum(grams[i : i + toxicity.WINDOW_WORDS], []) for i in range(last)] if grams else []
        return 1 / (1 + np.exp(0.5 - max((np.mean(model.weights[b]) if b else 0.0 for b in bags), default=0.0)))

    texts = ["One two three four five six", "a", "", " . ", "é ü word", "some (bracketed) [words], and \"more\"; of them. " * 3]
    assert np.allclose(model.score(pa.array(texts)), [slow(t) for t in texts])


def test_toxicity_frames(spark):
    rows = docs(spark, MIXED)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(rows, none)
    out = toxicity.reject(rows, model)
    assert out.columns == rows.columns and out.count() == len(MIXED)
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (4, 1, None), (None, 1, 1), (7, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(rows, toxicity.fit(rows, labels, held_out_fold=None)).count() == len(MIXED)
    assert toxicity.score(docs(spark, []), model).count() == 0
    clash = toxicity.score(rows.withColumn("Score", F.lit("x")), model)
    assert clash.columns.count("score") == 1 and "Score" not in clash.columns and clash.select("score").distinct().count() == 1


def test_language(spark):
    rng = random.Random(2)
    words = {"xx": ["the", "and", "of", "thing"], "yy": ["der", "und", "schön", "nicht"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(train, held_out_fold=None)
    test = spark.createDataFrame([(1, "und der schön nicht", 0), (2, None, 0), (3, " 123 ?!", 0), (4, "the thing of the", 0), (5, "", 0), (6, "und " * 100_000, 0)], "doc_id bigint, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(test, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["yy", "und", "und", "xx", "und", "yy"] and got[2][1] == 0
    assert langid.predict(test, langid.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(test.withColumnRenamed("score", "SCORE"), model).columns == ["doc_id", "text", "lang_pred", "score"]
    assert langid.predict(test.limit(0), model).count() == 0


def test_language_against_a_plain_convolution():
    rng = np.random.default_rng(8)
    k, width = 3, langid.FILTERS * len(langid.WIDTHS)
    model = langid.LanguageModel(["a", "b", "c"], [rng.normal(0, 1, (w, 256, langid.FILTERS)) for w in langid.WIDTHS], rng.normal(0, 1, width), rng.normal(0, 1, (width, k)), rng.normal(0, 1, k))
    texts = ["Short", "x" * 256, "äöü " * 200, "Mixed CASE text, " * 33]
    best, share = model.predict(pa.array(texts))
    for i, text in enumerate(texts):
        data, total = langid.LOWER[np.frombuffer(text.encode(), np.uint8)], np.zeros(k)
        for a in range(0, len(data), langid.WINDOW):
            part = data[a : a + langid.WINDOW]
            padded = np.concatenate([part, np.zeros(langid.WINDOW - len(part), np.uint8)])
            peaks = [max(sum(f[j, padded[p + j], u] for j in range(w)) for p in range(langid.WINDOW - w + 1)) for w, f in zip(langid.WIDTHS, model.filters, strict=True) for u in range(langid.FILTERS)]
            z = np.maximum(np.array(peaks) + model.filter_bias, 0) @ model.dense + model.dense_bias
            total += (z - np.log(np.exp(z).sum())) * len(part)
        p = np.exp(total / len(data) - (total / len(data)).max())
        assert best[i] == p.argmax() and share[i] == pytest.approx((p / p.sum()).max(), rel=1e-3)


# --- 3 n-gram join


def brute(texts, rule):
    import re

    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + rule.words]) for j in range(max(1, len(w) - rule.words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and rule.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rule", [shingle_join.Rule(4, 85, 100), shingle_join.Rule(5, 80, 100)])
@pytest.mark.parametrize("block", [1024, 7])
def test_join_against_brute_force(spark, rule, block, monkeypatch):
    rng = random.Random(rule.words * 1000 + block)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for n in (3, 6, 9, 14, 25, 60, 160, 400):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, n // 25)])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words += passage[: rng.randrange(3)]
            rows.append(" ".join(words))
    rows += [" ".join([rng.choice(vocab) for _ in range(rng.randrange(5, 40))] + passage) for _ in range(40)]
    rows += ["", None, " \t\n", "One", "one", "A B", "a b", "x " * 500, "x " * 3]
    texts = list(enumerate(rows))
    rng.shuffle(texts)
    monkeypatch.setattr(shingle_join, "BLOCK_SETS", block)
    monkeypatch.setattr(shingle_join, "COMBINE", 500)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.components(docs(spark, [(i, t, None) for i, t in texts]), rule).collect()}
    assert got == brute(texts, rule)


def test_join_edges(spark):
    rows = shingle_join.components(docs(spark, MIXED), shingle_join.Rule()).collect()
    assert len(rows) == len(MIXED)
    by = sorted((r["id"] or -1, r["component_id"] or -1, r["n_shingles"]) for r in rows)
    assert by == sorted([(1, 1, 1), (2, 1, 1), (2, 1, 1), (7, 1, 1), (-1, -1, 1), (-1, -1, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1)])
    assert shingle_join.components(docs(spark, []), shingle_join.Rule()).count() == 0
    kept = shingle_join.drop_near_copies(docs(spark, MIXED))
    assert kept.columns == docs(spark, MIXED).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5]


def test_a_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n in (5, 50, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for m in (n // 2, n // 10):  # of another width than a's
            b = np.unique(np.concatenate([a[: m // 2], rng.integers(0, 1 << 63, m - m // 2, dtype=np.uint64)]))
            data, start = shingle_join.sketches(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
            apart = shingle_join.hamming(data, start, np.array([0, 1, 0]), np.array([1, 0, 0]))
            assert apart[0] == apart[1] <= len(np.setxor1d(a, b)) and apart[2] == 0


@pytest.mark.parametrize("rule", [shingle_join.Rule(4, 85, 100), shingle_join.Rule(5, 80, 100), shingle_join.Rule(5, 1, 2)])
def test_linked_sets_share_a_segment(rule):
    rng = np.random.default_rng(3)
    token = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for _ in range(400):
        base = token(int(np.exp(rng.uniform(0, 7.5))))
        least = -(-len(base) * rule.num // rule.den)
        cut = int(rng.integers(0, len(base) - least + 1))
        more = int(rng.integers(0, 1 + max(0, rule.den * (len(base) - cut) // rule.num - len(base))))
        a, b = np.unique(base), np.unique(np.concatenate([base[cut:], token(more)]))
        common = len(np.intersect1d(a, b))
        assert rule.linked(common, len(a), len(b))
        row, key = shingle_join.segment_keys(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), rule)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


# --- 4 language model


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    k, n = 3, 5
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    p = hmm.Parameters(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((n, k)), 0))
    seqs = [[0], [1, 2, 3], [4, 4, 0, 1]]
    codes, at = np.concatenate(seqs), np.cumsum([0, *map(len, seqs)])
    for seq, got in zip(seqs, hmm.log_likelihood(codes, at, p), strict=True):
        total = sum(np.prod([p.start[s[0]]] + [p.move[a, b] for a, b in itertools.pairwise(s)] + [p.emit[o, x] for o, x in zip(seq, s, strict=True)]) for s in itertools.product(range(k), repeat=len(seq)))
        assert got == pytest.approx(np.log(total))
    into = [np.zeros(k), np.zeros((k, k)), np.zeros((n, k))]
    assert hmm.expect_texts(codes.astype(np.int64), at, p, into) == pytest.approx(hmm.log_likelihood(codes, at, p).sum())
    assert into[0].sum() == pytest.approx(3) and into[1].sum() == pytest.approx(5) and into[2].sum() == pytest.approx(8)


def test_language_model_edges(spark, monkeypatch):
    rows = hmm.score(docs(spark, MIXED), iterations=2, states=2)
    got = sorted((r["id"] or -1, r["n_tokens"]) for r in rows.collect())
    assert got == sorted([(1, 4), (2, 4), (2, 4), (-1, 4), (-1, 1), (3, 1), (4, 1), (5, 30_001), (7, 4)])
    assert hmm.score(docs(spark, []), iterations=1, states=2).count() == 0
    # a tiny dictionary sends most words through the join; results must not change
    texts = docs(spark, [(i, " ".join(f"w{(i * j) % 37}" for j in range(50)), None) for i in range(40)])
    base = {r["id"]: (r["n_known"], round(r["base_score"], 6)) for r in hmm.score(texts, iterations=1, states=2).collect()}
    monkeypatch.setattr(hmm, "DICTIONARY", 5)
    assert {r["id"]: (r["n_known"], round(r["base_score"], 6)) for r in hmm.score(texts, iterations=1, states=2).collect()} == base


def test_the_score_is_the_log_probability_of_the_text(spark, monkeypatch):
    """Forward sums over symbols, class terms and words beyond the dictionary, one text at a time."""
    import re
    from collections import Counter

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "gam", "dé"]) + (str(rng.randrange(30)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(0, 40))), None) for i in range(60)]
    monkeypatch.setattr(hmm, "DICTIONARY", 6)
    monkeypatch.setattr(hmm, "OWN", 3)
    kept = {}
    plain = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda encoded, v, *more: kept.setdefault("p", (plain(encoded, v, *more), v))[0])
    got = {r["id"]: r["score"] for r in hmm.score(docs(spark, rows), iterations=2, states=3).collect()}
    p, v = kept["p"]
    words = {i: re.findall(r"[^ ]+", t.lower()) for i, t, _ in rows}
    train = [w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws]
    count = Counter(train)
    coded = {}
    for w in {w for ws in words.values() for w in ws}:
        ((_, _, h, g),) = hmm.tokens(pa.array([w]))
        coded[w] = (int(h[0]), int(g[0]))
    own = [w for w in count if v.look_up(np.array([coded[w][0]]))[2][0] >= 0]
    assert len(own) == 3 and min(count[w] for w in own) >= max(count[w] for w in count if w not in own)
    group = {g: [w for w in count if w not in own and coded[w][1] == g] for g in range(hmm.CLASSES)}
    for i, ws in words.items():
        total = 0.0
        codes = []
        for w in ws:
            h, g = coded[w]
            if w in own:
                codes.append(int(v.look_up(np.array([h]))[2][0]))
            else:
                codes.append(3 + g)
                total += np.log10((count[w] + 1) / (sum(count[x] for x in group[g]) + len(group[g]) + 1))
        a = p.start * p.emit[[*codes, v.end][0]]
        for c in [*codes, v.end][1:]:
            a = (a @ p.move) * p.emit[c]
        assert got[i] == pytest.approx(total + np.log10(a.sum()), rel=1e-9)


# --- 5 vectors


@pytest.mark.parametrize("tile", [1024, 16])
def test_vectors_against_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    base = rng.normal(0, 1, (12, 8))
    data = np.concatenate([base + rng.normal(0, s, base.shape) for s in (0, 0.05, 0.15, 0.25, 0.3)])
    label = [int(x) for x in np.tile(np.arange(12) % 3, 5)]
    rows = [(i, [float(x) for x in v], lab, "x") for i, (v, lab) in enumerate(zip(data, label, strict=True))]
    extra = [(100, None, 0, ""), (101, [0.0] * 8, 0, ""), (102, [float("nan")] * 8, 0, ""), (103, [1.0, None] + [0.0] * 6, 1, ""), (104, rows[0][1], None, ""), (105, rows[0][1][:4], 0, ""), (106, [float("inf")] + [0.0] * 7, 1, "")]
    df = spark.createDataFrame(rows + extra + rows[:1], "vec_id bigint, embedding array<double>, label int, id string")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, tile=tile).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    root = near_vectors.forest(len(data), *np.nonzero(link))
    for _ in range(len(data)):
        root = np.minimum(root, np.where(link, root[None], len(data)).min(1))
    assert got == {i: (int(link[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(data))} | {i: (0, i, True) for i in range(100, 107)}
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    u = rng.normal(0, 1, (200, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, m, e = near_vectors.quantise(u)
    near = (q.astype(float) @ q.T) * s[:, None] * s[None]
    assert (np.abs(near - u @ u.T) <= e[:, None] * m[None] + e[None] + near_vectors.SLACK).all()


# --- 6 BPE


def test_bpe_safe_boundaries():
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    codec = byte_bpe.ByteBPE(byte_bpe.read_ranks(path), pattern)
    rng = random.Random(4)
    for _ in range(40):
        alphabet = rng.choice(["ab  \n'1!é", "a \t", "word it's 12   ", "日本 語 "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 10, 5000, 12_000])))
        ids = codec.encode(text)
        assert ids == codec._encoding.encode_ordinary(text) and codec.decode(ids) == text.encode()
    for text in (" " * 300_000, "a" * 100_000, "\n" * 50_000 + "x", "! " * 30_000):
        assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_frames(spark):
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    rows = byte_bpe.digests(docs(spark, MIXED), path, pattern).collect()
    assert len(rows) == len(MIXED) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["ids_sha256"] == r["decoded_sha256"] == empty for r in rows if r["doc_id"] in (3, 4))
    assert byte_bpe.digests(docs(spark, []), path, pattern).count() == 0
    kept = byte_bpe.encode(docs(spark, MIXED), path, pattern)
    assert kept.columns == [*docs(spark, []).columns, "ids"]


# --- 8 exact dedup


def test_content_sort(spark):
    marks = content_sort.mark_copies(docs(spark, MIXED), keep="largest").collect()
    assert len(marks) == len(MIXED) and sum(r["kept"] for r in marks) == len({t or "" for _, t, _ in MIXED})
    same = [r for r in marks if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {2} and sum(r["kept"] for r in same) == 1
    assert {r["keep_id"] for r in marks if r["text_sha256"] == hashlib.sha256(b"").hexdigest()} == {4}
    kept = content_sort.drop_copies(docs(spark, MIXED))
    assert kept.columns == docs(spark, MIXED).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 7]
    folded = content_sort.drop_copies(docs(spark, MIXED), keep="largest", normalise=F.lower)
    assert sorted(r["doc_id"] for r in folded.collect()) == [4, 5, 7]
    nulls = content_sort.drop_copies(docs(spark, [(None, "a", "s"), (None, "a", "s"), (None, "b", "s"), (3, "c", "s"), (3, "d", "s"), (4, "d", "s")]))
    assert sorted(r["text"] for r in nulls.collect()) == ["a", "b", "c", "d"]
    assert content_sort.mark_copies(docs(spark, [])).count() == content_sort.drop_copies(docs(spark, [])).count() == 0


def test_equality_rests_on_no_digest(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "_order", lambda text: F.lit(1).cast("bigint"))
    rows = [(i, f"the same sixteen characters {i % 7}", "s") for i in range(70)] + [(i, "hot", "s") for i in range(100, 300)]
    want = {i % 7: i for i in range(70)}
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in content_sort.mark_copies(docs(spark, rows), keep="largest").collect()}
    assert got == {i: (want[i % 7], 10, i == want[i % 7]) for i in range(70)} | {i: (299, 200, i == 299) for i in range(100, 300)}
    assert sorted(r["doc_id"] for r in content_sort.drop_copies(docs(spark, rows)).collect()) == [*range(7), 100]


def test_a_hot_text_is_dealt_over_partitions(spark):
    df = docs(spark, [(i, "hot" if i % 3 else f"text {i}", "s") for i in range(900)])
    keyed = content_sort._keyed(df, F.col("text"), [F.col("text").alias("t")])
    sizes = keyed.where("t = 'hot'").groupBy("slice").count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 400
    assert keyed.where("t <> 'hot' and slices > 1").isEmpty()


# --- 9 chat


def test_chat_round_trip(spark):
    texts = ["plain", "\\### Assistant: </turn> ok", "a\\b#c<d", "", None, "</turn>\n### user: x", "é\n\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(texts)] + [(None, None, None, None, None), (2, 0, "odd: role#", "x", 1), (2, 0, "assistant", "y" * 200_000, 1), (2, 0, "assistant", "z", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    formatted = chat.format_turns(chat.conversation_turns(df))
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = [(("assistant" if i % 2 else "user"), t or "") for i, t in enumerate(texts)]
    assert got[1]["turns_sha256"] == h("".join(f"{r}\n{t}\n" for r, t in one)) and got[1]["n_turns"] == 7
    loss = "".join(t for r, t in one if r == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), h(loss))
    assert got[2]["turns_sha256"] == h("assistant\n" + "y" * 200_000 + "\nassistant\nz\nodd: role#\nx\n") and got[None]["n_turns"] == 1
    assert chat.read_back(formatted.limit(0)).count() == 0
    for r in formatted.where("conv_id = 1").collect():
        assert "###" not in r["formatted"][4:] and r["formatted"].count("</turn>") == 1


def test_tied_turns_are_ordered_by_what_they_say(spark):
    texts = ["#x", "Ax", "a", "a\tb", "<", "\\h", "\\#", "\\\\", ":", "", "a </turn>"]
    rows = [(1, 0, role, t, "clash") for t in texts for role in ("assistant", "#r: x", "A")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    (got,) = chat.read_back(chat.format_turns(chat.conversation_turns(df.repartition(3)))).collect()
    want = sorted((r.encode(), t.encode()) for _, _, r, t, _ in rows)
    assert got["turns_sha256"] == hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in want)).hexdigest()


def test_typed_parts():
    flat = chat.PartVisitor(patch=10).flatten([{"type": "text", "text": "see <image:0>"}, {"type": "image", "ref": "a.png", "width": 25, "height": 10}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}])
    assert flat.text == "see \\limage:0><image:0><audio:1><document:2>"
    assert flat.attachments == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1200)] and flat.expanded_tokens == 1241
    with pytest.raises(ValueError):
        chat.PartVisitor().flatten([{"type": "video"}])


# --- 10 mixing


def test_targets(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 0)], "source string, source_size bigint")
    rows = {r["source"]: r["target"] for r in mixing.source_targets(sources).collect()}
    # 2265 words; b is capped at 20, the null source at 0, a and c share the rest 3 to 2, c is capped
    assert rows == {"a": pytest.approx(2265 - 20 - min(1000, 2245 * 2 / 5)), "b": 20.0, "c": pytest.approx(min(1000, 2245 * 2 / 5)), None: 0.0}


def test_mix_edges(spark):
    df = docs(spark, MIXED)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(MIXED) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs(spark, [])).count() == mixing.apply_mix(docs(spark, [])).count() == 0
    many = docs(spark, [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(600)])
    rows = mixing.mix(many).collect()
    assert {(r["id"], r["taken"]) for r in rows} == {(r["id"], r["taken"]) for r in mixing.mix(many.repartition(5)).collect()}
    for s in {r["target"] for r in rows}:
        assert sum(r["taken"] for r in rows if r["target"] == s) == pytest.approx(s, abs=20)
