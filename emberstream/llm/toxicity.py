"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

Every word is a bag of hashed character n-grams. The vectors of all n-grams of a window of
``WINDOW_WORDS`` words are averaged and go through a softmax over (clean, toxic); a text has the
score of its most toxic window, so that one insult in a long document is not averaged away. A
misspelling that training has not seen shares most n-grams, and so most vectors, with the word it
stands for. Vectors and softmax start at random and are fitted together from document labels.

The classifier is fitted on a bounded sample of labelled rows: at most ``max_per_class``
documents of each class, the first by a digest of the id. A text above ``max_train_chars`` comes as
its distinct words, in their order. Scoring covers every whole text. Since both layers are linear,
a trained model is one number for each n-gram bucket, which is all that executors get (its size
does not depend on the data).

Defined results: null and empty texts, and texts without words, get the score of the bias alone;
several labels of one id count as toxic if any is; rows that repeat are scored alike, each; of
texts that tie in the sample's order the first in code-point order is taken; with labels of one
class only, or none, every score is that class's share; an empty table gives no rows; a text of
any length is scored whole, piece by piece of a batch; a column of the score's name (in any case)
is replaced by it, other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import flat, slices
from .workspace import bounded_batches, column, crc_fold, fresh

#: n-gram lengths (in bytes, word ends included) and hash buckets.
LENGTHS, BUCKETS = (3, 4, 5), 1 << 17
#: Words of a window.
WINDOW_WORDS = 4
#: Weight in training of one more text, which is empty and clean (the labelled ones weigh 1).
EMPTY = 0.2
#: Share of the n-grams that one step of training sees.
KEPT_GRAMS = 0.5
#: Share from which a text is predicted toxic.
THRESHOLD = 0.3
#: Signs that end a word, besides white space.
_ENDS = np.zeros(256, bool)
_END_SIGNS = " \t\n\v\f\r.,;:?()[]\""
_ENDS[list(_END_SIGNS.encode())] = True
_SPLIT = r"[ \t\n\x0B\f\r.,;:?()\[\]\"]+"


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For bytes that start and end with a word end: position before each word, its word's end,
    and for every n-gram length the buckets and whether an n-gram starts there."""
    gap = _ENDS[data]
    data = np.where(gap, np.uint8(32), data)
    before = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    inner, made, n = None, [], len(data)
    h = data.astype(np.uint32)
    for length in range(2, max(LENGTHS) + 1):
        h = (h[: n - length + 1] * np.uint32(16777619)) ^ data[length - 1 :].astype(np.uint32)
        if length > 2:
            fresh = ~gap[length - 2 : n - 1]
            inner = fresh if inner is None else inner[: n - length + 1] & fresh
        if length in LENGTHS:
            bucket = (h ^ (h >> np.uint32(15)) ^ np.uint32(length * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
            made.append(((bucket >> np.uint32(15)).astype(np.int32), inner))
    return before, ends, made


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank before each text and one at the end; start of each text."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[place] = data
    return out, offsets + np.arange(n + 1)


@dataclass
class ToxicityModel:
    """The average of ``weights`` over a window's n-grams, plus ``bias``, is its toxic logit."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array, limit: int = 1 << 18) -> np.ndarray:
        out = np.empty(len(texts))
        _, offsets = flat(texts)
        for a, b in slices(offsets, limit):
            out[a:b] = self._score(texts.slice(a, b - a))
        return out

    def _score(self, texts: pa.Array) -> np.ndarray:
        data, starts = joined(texts)
        before, _, made = grams(data)
        best = np.full(len(texts), self.bias)
        if len(before):
            total, count = np.zeros(len(data)), np.zeros(len(data))
            for bucket, there in made:
                total[: len(bucket)] += self.weights[bucket] * there
                count[: len(bucket)] += there
            first = np.searchsorted(before, starts)
            some = np.flatnonzero(np.diff(first))
            value = windows(np.add.reduceat(total, before), np.add.reduceat(count, before), first)
            best[some] += np.maximum.reduceat(value, first[some])
        return 1 / (1 + np.exp(-np.clip(best, -40, 40)))


def windows(total: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The average n-gram of the window that starts at each word: from sums and counts of each
    word's n-grams, and the first word of each text (and the total)."""
    n = np.diff(first)
    end = np.minimum(np.arange(len(total)) + WINDOW_WORDS, np.repeat(first[1:], n))
    # a text's last windows are its last whole one, so that a window is short only in a short text
    start = np.maximum(np.repeat(first[:-1], n), np.minimum(np.arange(len(total)), end - WINDOW_WORDS))
    s, c = np.concatenate([[0.0], np.cumsum(total)]), np.concatenate([[0.0], np.cumsum(count)])
    return (s[end] - s[start]) / np.maximum(1, c[end] - c[start])


def _bags(texts: list[str]):
    """Of each text its words, in order; of each distinct word its n-gram buckets."""
    words: dict[bytes, int] = {}
    order, first = [], [0]
    for text in texts:
        data, _ = joined(pa.array([text], pa.large_string()))
        raw = np.where(_ENDS[data], np.uint8(32), data).tobytes()
        order.append(np.fromiter((words.setdefault(w, len(words)) for w in raw.split()), np.int64))
        first.append(first[-1] + len(order[-1]))
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    before, _, made = grams(data)
    where = np.concatenate([np.flatnonzero(there) for _, there in made])
    ids = np.concatenate([bucket[there] for bucket, there in made])
    word = np.searchsorted(before, where, "right") - 1
    placed = np.argsort(word, kind="stable")
    at = np.searchsorted(word[placed], np.arange(len(words) + 1))
    return np.concatenate(order), np.array(first), ids[placed].astype(np.int64), at


def train(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: tuple[int, int] = (30, 80), rate: float = 0.5, seed: int = 7) -> ToxicityModel:
    """Fit random n-gram vectors and a random softmax together, by gradients of the document labels.

    In the first epochs a document is the average of all its n-grams, in the others that of its
    most toxic window, each time leaving out a random part of them.
    """
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel(np.zeros(BUCKETS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    kept = [i for i, t in enumerate(texts) if t.strip(_END_SIGNS)]
    y = labels[kept]
    rng = np.random.default_rng(seed)
    vectors, softmax, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    if not kept:
        return ToxicityModel(np.zeros(BUCKETS), float(np.log(labels.mean() / (1 - labels.mean()))))
    token, first, ids, at = _bags([texts[i] for i in kept])
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    doc = np.repeat(np.arange(len(kept)), np.diff(first))
    count = np.diff(at).astype(float)
    whole = np.add.reduceat(count[token], first[:-1])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-6), np.full_like(softmax, 1e-6), np.full(2, 1e-6)
    for epoch in range(sum(epochs)):
        toward = softmax[:, 1] - softmax[:, 0]
        one = (vectors @ toward)[ids]
        if epoch < epochs[0]:
            logit = np.add.reduceat(np.add.reduceat(one, at[:-1])[token], first[:-1]) / whole
            per_doc = _slope(logit + bias[1] - bias[0], y) * weight
            per_word = np.bincount(token, (per_doc / whole)[doc], len(count))
            slope = np.bincount(ids, per_word[word], BUCKETS)
        else:
            left = rng.random(len(ids)) < KEPT_GRAMS
            some = np.add.reduceat(left.astype(float), at[:-1])
            value = windows(np.add.reduceat(one * left, at[:-1])[token], some[token], first)
            top = np.maximum.reduceat(value, first[:-1])
            hit = np.flatnonzero(value == np.repeat(top, np.diff(first)))
            hit = hit[np.unique(doc[hit], return_index=True)[1]]
            per_doc = _slope(top + bias[1] - bias[0], y) * weight
            # the window's tokens, and then their n-grams
            start = np.maximum(first[:-1], np.minimum(hit, first[1:] - WINDOW_WORDS))
            many = np.minimum(WINDOW_WORDS, first[1:] - start)
            place, owner = _spread(start, many), np.repeat(np.arange(len(hit)), many)
            size = np.maximum(1, np.bincount(owner, some[token[place]], len(hit)))
            per_word = np.bincount(token[place], (per_doc / size)[owner], len(count))
            slope = np.bincount(ids, per_word[word] * left, BUCKETS)
        # both layers from the slope of the loss by each bucket's share
        g_softmax = np.outer(vectors.T @ slope, [-1.0, 1.0])
        touched = np.flatnonzero(slope)
        g_vectors = slope[touched, None] * toward
        seen_v[touched] += (g_vectors**2).mean(1)
        vectors[touched] -= rate * g_vectors / np.sqrt(seen_v[touched])[:, None]
        seen_s += g_softmax**2
        softmax -= rate * 0.1 * g_softmax / np.sqrt(seen_s)
        extra = per_doc.sum() + EMPTY * _slope(bias[1] - bias[0], 0.0)
        g_bias = np.array([-extra, extra])
        seen_b += g_bias**2
        bias -= rate * g_bias / np.sqrt(seen_b)
    return ToxicityModel(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))


def _slope(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... many[0] numbers, then the same of the next."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_fold: int | None = 2, folds: int = 4, max_per_class: int = 1500, max_train_chars: int = 20_000) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    ids = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if held_out_fold is not None:
        ids = ids.where(crc_fold(F.col("id"), folds) != held_out_fold)
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("id"))
    sample = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy("o", "id").limit(max_per_class)
        sample = part if sample is None else sample.unionByName(part)
    # at most two times max_per_class ids: a bounded list, whatever the table's size
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where("text is not null")
    words = F.array_join(F.array_distinct(F.split("text", _SPLIT)), " ")
    rows = texts.join(F.broadcast(sample), "id").withColumn("text", F.when(F.length("text") > max_train_chars, words).otherwise(F.col("text")))
    # an id that repeats counts once, by its least text
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("id", "text").select("text", "y").toPandas()
    return train(rows["text"].tolist(), rows["y"].to_numpy())


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score", keep=None) -> DataFrame:
    """Adds the toxic share of each whole text, from the text alone."""
    bounded_batches(docs.sparkSession)
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() != score_col.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([docs.schema[c] for c in names] + [T.StructField(score_col, T.DoubleType())])
    position = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            made = pa.array(shared.value.score(batch.column(position)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(docs_index[c]) for c in names] + [made], names=[*names, score_col])

    docs_index = {c: i for i, c in enumerate(docs.columns)}
    return docs.mapInArrow(run, fields)


def reject(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    flag = fresh("_toxic_share", docs.columns)
    return score(docs, model, text_col, flag).where(F.col(flag) < threshold).drop(flag)
