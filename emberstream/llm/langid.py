"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over the bytes of fixed-length windows, the maximum of each filter
over a window goes through a ReLU and a softmax. A text is cut into windows of ``WINDOW`` bytes,
all of them, and the windows' log probabilities are averaged by their length. Filters see one-hot
bytes, so a convolution is a sum of table rows; pairs of bytes are looked up at once.

The network is fitted on windows of a bounded sample of labelled rows (``max_per_lang`` rows a
language, the first by a digest of the id). Labels, source and id are never inputs.

Defined results: ``und`` with score 0 for null texts and texts without a letter; a text without a
learned language (no training rows) is ``und`` too; ties go to the first language in code-point
order; rows that repeat are predicted alike, each, and may repeat in the sample; an empty table
gives no rows; texts of any length are predicted whole; columns of the results' names (in any
case) are replaced by them, other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import LOWER, flat
from .workspace import bounded_batches, column, crc_fold

#: Bytes of a window, filter widths, filters of each width, windows that are computed together.
WINDOW, WIDTHS, FILTERS, BATCH = 256, (2, 3, 4), 8, 256
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows of every text, their lengths, and the text that each belongs to."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(WINDOW, sizes[owner] - start)
    return offsets[owner] + start, length, owner


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as a (WINDOW, n) array of lower-cased bytes, 0 beyond a window's length."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    out = LOWER[data[np.minimum(at, len(data) - 1)]]
    return np.where(np.arange(WINDOW)[:, None] < length[None, :], out, np.uint8(0))


@dataclass
class LanguageModel:
    languages: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    filter_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def prepare(self) -> None:
        if not hasattr(self, "_tables"):
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)  # noqa: E731  first byte high
            f2, f3, f4 = self.filters
            self._tables = (pair(f2[0], f2[1]), pair(f3[0], f3[1]), f3[2].astype(np.float32), pair(f4[0], f4[1]), pair(f4[2], f4[3]))

    def log_probabilities(self, block: np.ndarray) -> np.ndarray:
        """(n, languages) for a (WINDOW, n) array of bytes."""
        self.prepare()
        t2, t3, t3b, t4, t4b = self._tables
        pairs = (block[:-1].astype(np.uint16) << 8) | block[1:]
        peaks = [
            t2[pairs].max(0),
            (t3[pairs[:-1]] + t3b[block[2:]]).max(0),
            (t4[pairs[:-2]] + t4b[pairs[2:]]).max(0),
        ]
        hidden = np.maximum(np.concatenate(peaks, 1) + self.filter_bias, 0)
        z = hidden @ self.dense + self.dense_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language (-1: none) and its share, for each whole text."""
        data, offsets = flat(texts)
        n, k = len(offsets) - 1, len(self.languages)
        total = np.zeros((n, max(k, 1)))
        if k and len(data):
            start, length, owner = windows(data, offsets)
            for i in range(0, len(start), BATCH):
                part = slice(i, i + BATCH)
                lp = self.log_probabilities(gather(data, start[part], length[part])) * length[part][:, None]
                np.add.at(total, owner[part], lp)
        mean = total / np.maximum(1, np.diff(offsets))[:, None]
        share = np.exp(mean - mean.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1) if k else np.full(n, -1)
        return best, share.max(1)


def train(texts: list[str], langs: list[str], steps: int = 700, batch: int = 96, rate: float = 0.02, seed: int = 5) -> LanguageModel:
    """Adam on random windows of the texts, languages drawn evenly."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS]
    width = FILTERS * len(WIDTHS)
    params = [*filters, np.zeros(width), rng.normal(0, 0.2, (width, max(1, len(names)))), np.zeros(max(1, len(names)))]
    model = LanguageModel(names, params[:3], *params[3:])
    if len(names) == 0:
        return model
    data, offsets = flat(pa.array(texts, pa.large_string()))
    start, length, owner = windows(data, offsets)
    y = np.array([names.index(x) for x in langs])[owner] if len(owner) else np.zeros(0, int)
    groups = [np.flatnonzero(y == k) for k in range(len(names))]
    groups = [g for g in groups if len(g)]
    if len(groups) < 2:
        return model
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, batch // len(groups) + 1) for g in groups])
        # windows of random lengths, so that short texts are met in training too
        cut = np.where(rng.random(len(pick)) < 0.5, length[pick], np.minimum(length[pick], rng.integers(16, WINDOW, len(pick))))
        block = gather(data, start[pick], cut)
        peaks, places = [], []
        for w, f in zip(WIDTHS, params[:3], strict=True):
            out = sum(f[j][block[j : WINDOW - w + 1 + j]] for j in range(w))
            at = out.argmax(0)
            places.append(at)
            peaks.append(np.take_along_axis(out, at[None], 0)[0])
        pre = np.concatenate(peaks, 1) + params[3]
        hidden = np.maximum(pre, 0)
        z = hidden @ params[4] + params[5]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), y[pick]] -= 1
        p /= len(pick)
        back = (p @ params[4].T) * (pre > 0)
        grads = [np.zeros_like(f) for f in params[:3]] + [back.sum(0), hidden.T @ p, p.sum(0)]
        column_of = np.broadcast_to(np.arange(len(pick))[:, None], (len(pick), FILTERS))
        unit = np.broadcast_to(np.arange(FILTERS)[None], (len(pick), FILTERS))
        for i, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                np.add.at(grads[i][j], (block[at + j, column_of], unit), g)
        for p_, g, a, b in zip(params, grads, m, v, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_fold: int | None = 2, folds: int = 4, max_per_lang: int = 400, max_langs: int = 200, max_train_chars: int = 4000) -> LanguageModel:
    """Fit on a bounded sample: ``max_per_lang`` rows of each of the ``max_langs`` most frequent
    languages. Of a text longer than ``max_train_chars``, pieces spread evenly over it stand for it,
    of about so many characters together.

    Rows are first thinned by a digest of id and text, to about twice what is wanted of a language, so
    that one scan finds them and only the sample moves; the row of a language's least digest always
    stays. Rows of equal digest count once.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang")).where("lang is not null and text is not null")
    if held_out_fold is not None:
        rows = rows.where(crc_fold(F.col("id"), folds) != held_out_fold)
    rows = rows.withColumn("digest", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.min("digest").alias("least")).orderBy(F.desc("count"), "lang").limit(max_langs)  # at most max_langs rows
    share = F.pmod("digest", F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = rows.join(F.broadcast(counts), "lang").where((share * F.col("count") < 2.0 * max_per_lang + 50) | (F.col("digest") == F.col("least")))
    pieces = max(2, max_train_chars // WINDOW)
    piece = lambda i: F.substring("text", (i * (F.length("text") - WINDOW) / (pieces - 1)).cast("int") + 1, F.lit(WINDOW))
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), piece), " ")
    thin = thin.withColumn("text", F.when(F.length("text") > max_train_chars, spread).otherwise(F.col("text")))
    thin = thin.groupBy("lang", "digest").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    sample = thin.withColumn("place", place).where(F.col("place") <= max_per_lang).select("lang", "place", "text").collect()
    sample.sort(key=lambda r: (r["lang"], r["place"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", keep=None) -> DataFrame:
    """Adds the predicted language and its share, from the text alone."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in (lang_out.lower(), score_out.lower())]
    places = [docs.columns.index(c) for c in names]
    text_at = docs.columns.index(text_col)
    fields = T.StructType([docs.schema[c] for c in names] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(text_at)
            best, share = shared.value.predict(texts)
            known = np.fromiter((t is not None and letter.search(t) is not None for t in texts.to_pylist()), bool, len(texts)) & (best >= 0)
            langs = [shared.value.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            made = [pa.array(langs, pa.string()), pa.array(np.where(known, share, 0.0), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + made, names=[*names, lang_out, score_out])

    return docs.mapInArrow(run, fields)
