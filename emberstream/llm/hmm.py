"""A hidden Markov language model over words, trained by Baum-Welch on the whole corpus.

States emit symbols: each of the ``OWN`` most frequent words is a symbol, every other word is one
of ``CLASSES`` ending classes, and a text's end is a symbol too. Within its class a word has the
probability (c + 1) / (C + V + 1) by its count c, the class's words C and distinct words V, so
the model is a probability of the text itself. An iteration runs the scaled forward-backward
recursions over all training texts, each as one whole sequence, sums expected counts across
partitions, and re-estimates.
Scoring runs the scaled forward recursion over each whole text: its likelihood is exact.

Counts cover every training word. The ``DICTIONARY`` most frequent ones, a fixed number, travel to
the executors; the rarer words of each text are joined with their counts by a shuffle. Words are
known by a 64-bit hash of their bytes.

Defined results: null and empty texts are one end; words in no training text have count 0; rows
with equal ids are texts of their own; with no training text every word has probability 1 / 2 or
less by the same formulas; an empty table gives no rows; texts of any length are whole sequences;
further columns, whatever their names, are not looked at. Where more than ``DICTIONARY`` words share
the highest count none travels and all are joined, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, flat, mix64, slices, word_hashes, word_spans
from .workspace import bounded_batches, column, crc_fold, materialize

STATES, ITERATIONS, OWN, CLASSES, DICTIONARY = 8, 6, 16_384, 128, 1 << 18
#: Tokens of a stretch, stretches that are computed together, weight of the unigram prior.
STRETCH, TOGETHER, PRIOR = 64, 4096, 20.0
#: Tokens up to which texts are passed through side by side, instead of their stretches.
LONG = 4096
#: Bytes of text that are tokenised together.
SLICE = 4 << 20
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"')]}*$%&|-")] = True


def tokens(texts: pa.Array):
    """Yields (first row, offsets of each row's words, word hashes, ending classes)."""
    data, offsets = flat(texts)
    for a, b in slices(offsets, SLICE):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, at)
        last = ends - 1
        mark = _PUNCTUATION[part[last]] & (ends - starts > 1) if len(last) else np.zeros(0, bool)
        stem = last - mark
        tail = part[stem].astype(np.uint64) * np.uint64(257) + part[np.maximum(stem - 1, starts)].astype(np.uint64)
        classes = (mix64(tail) % np.uint64(CLASSES // 2)).astype(np.int64) + mark * (CLASSES // 2)
        yield a, first, word_hashes(part, starts, ends).view(np.int64), classes


def _counts(batches):
    for batch in batches:
        for _, _, h, g in tokens(batch.column(0)):
            words, place, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(g[place].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "g", "c"])


class Vocabulary:
    """The dictionary (sorted hashes, counts, symbols) and the totals of the training tokens."""

    def __init__(self, hashes, counts, totals, class_words, class_types, texts: int, types: int):
        rank = np.lexsort((hashes, -counts))
        symbol = np.full(len(hashes), -1, np.int64)
        symbol[rank[:OWN]] = np.arange(min(OWN, len(hashes)))
        order = np.argsort(hashes)
        self.hashes, self.counts, self.symbol = hashes[order], counts[order], symbol[order]
        self.texts, self.types, self.total = texts, types + (texts > 0), totals + texts
        self.own = min(OWN, len(hashes))
        self.class_words, self.class_types = class_words, class_types
        self.end = self.own + CLASSES
        self.symbols = self.end + 1
        own_counts = np.zeros(self.own)
        own_counts[self.symbol[self.symbol >= 0]] = self.counts[self.symbol >= 0]
        all_counts = np.concatenate([own_counts, class_words, [texts]]) + 1.0
        self.unigram = all_counts / all_counts.sum()
        self.class_log = np.log10(class_words + class_types + 1.0)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a word is in the dictionary, its count there, its symbol (-1: by class)."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return known, np.where(known, self.counts[at], 0), np.where(known, self.symbol[at], -1)


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From (h, g, c): a dictionary of at most ``DICTIONARY`` words, those above a common count."""
    levels = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(DICTIONARY + 1).collect()
    least, room = 1 << 62, DICTIONARY
    for r in levels:
        room -= r["n"]
        if room < 0:
            break
        least = r["c"]
    rows = counts.where(F.col("c") >= least).select("h", "g", "c").toPandas()
    h, c, g = rows["h"].to_numpy(np.int64), rows["c"].to_numpy(np.int64), rows["g"].to_numpy(np.int64)
    class_words, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_words[r["g"]], class_types[r["g"]] = r["c"], r["n"]
    total, types = int(class_words.sum()), int(class_types.sum())
    own = np.lexsort((h, -c))[:OWN]
    class_words -= np.bincount(g[own], c[own], CLASSES)
    class_types -= np.bincount(g[own], minlength=CLASSES)
    vocab = Vocabulary(h, c, total, class_words, class_types, texts, types)
    vocab.least = least
    return vocab


ENCODED = "rid bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, class_logs double, symbols binary, rare array<bigint>, times array<int>"


def _encode(shared):
    def run(batches):
        v: Vocabulary = shared.value
        for batch in batches:
            for a, first, h, g in tokens(batch.column(3)):
                n = len(first) - 1
                known, count, symbol = v.look_up(h)
                logs = np.concatenate([[0.0], np.cumsum(np.log10(count + 1.0))])
                by_class = symbol < 0
                within = np.concatenate([[0.0], np.cumsum(np.where(by_class, np.log10(count + 1.0) - v.class_log[g], 0.0))])
                seen = np.concatenate([[0], np.cumsum(known)])
                coded = np.where(by_class, v.own + g, symbol).astype("<u2")
                rare = np.flatnonzero(~known)
                row = np.searchsorted(first, rare, "right") - 1
                order = np.lexsort((h[rare], row))
                row, word = row[order], h[rare][order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
                at = np.flatnonzero(fresh)
                times = np.diff(np.append(at, len(row))).astype(np.int32)
                row, word = row[at], word[at]
                bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                texts = [coded[first[i] : first[i + 1]].tobytes() + np.array([v.end], "<u2").tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, n) for i in range(3)]
                    + [pa.array(np.diff(first) + 1), pa.array(seen[first[1:]] - seen[first[:-1]]), pa.array(logs[first[1:]] - logs[first[:-1]]), pa.array(within[first[1:]] - within[first[:-1]])]
                    + [pa.array(texts, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(word)), pa.ListArray.from_arrays(bounds, pa.array(times))],
                    names=[x.split()[0] for x in ENCODED.split(", ")],
                )

    return run


class Parameters:
    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit  # emit: (symbols, states)


def initial(v: Vocabulary, states: int = STATES, seed: int = 11) -> Parameters:
    rng = np.random.default_rng(seed)
    emit = v.unigram[:, None] * rng.gamma(2.0, 0.5, (v.symbols, states))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(0))


def _live(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Rows longer than each step, of rows sorted by length, longest first."""
    return np.searchsorted(-lengths, -np.arange(steps), "left")


def transfer(obs: np.ndarray, lengths: np.ndarray, starts: np.ndarray, p: Parameters) -> np.ndarray:
    """(rows, states, states): what each stretch makes of the state before it, up to a factor.

    ``obs`` is (steps, rows) of symbols, longest first. Stretches that start a text are not moved
    into: the state before them is the start distribution.
    """
    k = len(p.start)
    out = np.where(starts[:, None, None], np.eye(k), p.move)
    for t, n in enumerate(_live(lengths, len(obs))):
        a = out[:n] if t == 0 else (out[:n].reshape(-1, k) @ p.move).reshape(n, k, k)
        a *= p.emit[obs[t, :n]][:, None, :]
        if t % 16 == 15:  # so many factors stay far inside the range of a double
            a /= a.max((1, 2))[:, None, None]
        out[:n] = a
    return out


def carried(moves: np.ndarray, first: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """The state before each stretch, and the likelihood of what follows it by the state at its end
    (up to a factor), for texts whose stretches are first[i] to first[i + 1]."""
    before, after = np.empty((len(moves), len(p.start))), np.ones((len(moves), len(p.start)))
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    live = _live(count, int(count[0]) if len(count) else 0)
    now = np.tile(p.start, (len(order), 1))
    for j, n in enumerate(live):
        at = begin[:n] + j
        before[at] = now[:n]
        now = np.einsum("ni,nij->nj", now[:n], moves[at])
        now /= now.sum(1, keepdims=True)
    for j in range(len(live) - 1, 0, -1):
        at = begin[: live[j]] + j
        back = np.einsum("nij,nj->ni", moves[at], after[at])
        after[at - 1] = back / back.max(1, keepdims=True)
    return before, after


def passed(codes: np.ndarray, start: np.ndarray, size: np.ndarray, slot: np.ndarray, p: Parameters, before: np.ndarray, after: np.ndarray) -> None:
    """Writes what ``carried`` returns for texts codes[start[i]:start[i] + size[i]] whose stretches
    begin at slot[i], by passing through the texts once in each direction, side by side."""
    order = np.argsort(-size, kind="stable")
    start, size, slot = start[order], size[order], slot[order]
    live = _live(size, int(size[0]) if len(size) else 0)
    a = np.tile(p.start, (len(order), 1))
    for t, n in enumerate(live):
        if t % STRETCH == 0:
            before[slot[:n] + t // STRETCH] = a[:n] / a[:n].sum(1, keepdims=True)
        a = (a[:n] if t == 0 else a[:n] @ p.move) * p.emit[codes[start[:n] + t]]
        if t % 16 == 15:
            a /= a.sum(1, keepdims=True)
    b = np.ones((len(order), len(p.start)))
    for t in range(len(live) - 1, 0, -1):
        n = live[t]
        back = (b[:n] * p.emit[codes[start[:n] + t]]) @ p.move.T
        if t % 16 == 0:
            back /= back.max(1, keepdims=True)
        if t % STRETCH == 0:
            after[slot[:n] + t // STRETCH - 1] = back / back.max(1, keepdims=True)
        b[:n] = back


def expect(obs: np.ndarray, lengths: np.ndarray, starts: np.ndarray, before: np.ndarray, after: np.ndarray, p: Parameters, into: list[np.ndarray]) -> float:
    """Adds the expected starts, moves and emissions of stretches of symbols, given what comes
    before and after them in their texts; returns the natural log likelihood."""
    steps, k = len(obs), len(p.start)
    live = _live(lengths, steps)
    alpha, scale, emitted, total = [], [], [], 0.0
    for t in range(steps):
        n = live[t]
        e = p.emit[obs[t, :n]]
        moved = (before if t == 0 else alpha[-1][:n]) @ p.move
        a = (np.where(starts[:, None], before, moved) if t == 0 else moved) * e
        s = a.sum(1)
        a /= s[:, None]
        total += np.log(s).sum()
        alpha.append(a)
        scale.append(s)
        emitted.append(e)
    gamma = np.zeros((steps, obs.shape[1], k))
    beta = np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        n, m = live[t], len(beta)
        back = after[:n].copy()
        back[m:] /= (alpha[t][m:] * back[m:]).sum(1, keepdims=True)  # these end here
        if m:
            ahead = beta * emitted[t + 1] / scale[t + 1][:, None]
            into[1] += p.move * (alpha[t][:m].T @ ahead)
            back[:m] = ahead @ p.move.T
        gamma[t, :n] = alpha[t] * back
        beta = back
    entered = ~starts
    into[1] += p.move * (before[entered].T @ (beta * emitted[0] / scale[0][:, None])[entered])
    into[0] += gamma[0, starts].sum(0)
    flat_obs, weights = obs.ravel(), gamma.reshape(-1, k)
    for j in range(k):
        into[2][:, j] += np.bincount(flat_obs, weights[:, j], len(into[2]))
    return total


def expect_texts(codes: np.ndarray, at: np.ndarray, p: Parameters, into: list[np.ndarray]) -> float:
    """``expect`` of whole texts codes[at[i]:at[i + 1]], none of them empty.

    A text is cut into stretches that are computed side by side. First the states between them,
    from end to end of the text: by a pass through it, or, for texts above ``LONG`` tokens, from what
    each stretch makes of any state. Then the expectations inside, so that the sums are those of
    the recursions over the whole text, however long it is.
    """
    size = np.diff(at)
    count = -(-size // STRETCH)
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(size)), count)
    start = at[owner] + (np.arange(len(owner)) - first[:-1][owner]) * STRETCH
    length = np.minimum(STRETCH, at[owner + 1] - start)
    starts = start == at[owner]
    order = np.argsort(-length, kind="stable")
    groups = [order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER)]

    def symbols(o: np.ndarray) -> np.ndarray:
        steps = np.arange(length[o[0]])[:, None]
        return np.where(steps < length[o][None, :], codes[np.minimum(start[o][None, :] + steps, len(codes) - 1)], 0)

    k = len(p.start)
    before, after = np.tile(p.start, (len(owner), 1)), np.ones((len(owner), k))
    passing = (size > STRETCH) & (size <= LONG)
    passed(codes, at[:-1][passing], size[passing], first[:-1][passing], p, before, after)
    long = np.flatnonzero(size > LONG)
    if len(long):
        cut = order[size[owner[order]] > LONG]
        moves = np.empty((len(cut), k, k))
        place = np.cumsum(size[owner] > LONG) - 1
        for i in range(0, len(cut), TOGETHER):
            o = cut[i : i + TOGETHER]
            moves[place[o]] = transfer(symbols(o), length[o], starts[o], p)
        whole = np.flatnonzero(size[owner] > LONG)
        before[whole], after[whole] = carried(moves, np.concatenate([[0], np.cumsum(count[long])]), p)
    return sum(expect(symbols(o), length[o], starts[o], before[o], after[o], p, into) for o in groups)


def _expectations(shared_p):
    def run(batches):
        p: Parameters = shared_p.value
        k, n = len(p.start), len(p.emit)
        into = [np.zeros(k), np.zeros((k, k)), np.zeros((n, k))]
        total = 0.0
        for batch in batches:
            data, offsets = _binary(batch.column(0))
            total += expect_texts(data.view("<u2"), offsets // 2, p, into)
        rows = np.concatenate([into[0][None], into[1], into[2], np.full((1, k), total / k)])
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64))] + [pa.array(rows[used, j]) for j in range(k)], names=["row", *[f"s{j}" for j in range(k)]])

    return run


def _binary(column_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column_ = column_.cast(pa.large_binary())
    offsets = np.frombuffer(column_.buffers()[1], np.int64)[column_.offset : column_.offset + len(column_) + 1]
    data = column_.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def baum_welch(encoded: DataFrame, v: Vocabulary, iterations: int = ITERATIONS, states: int = STATES) -> Parameters:
    """Each iteration covers every training text; sums are made on the executors."""
    spark = encoded.sparkSession
    p = initial(v, states)
    texts = encoded.where("not held_out").select("symbols")
    names = [f"s{j}" for j in range(states)]
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(p)
        part = texts.mapInArrow(_expectations(shared), "row bigint, " + ", ".join(f"{x} double" for x in names))
        rows = part.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
        sums = np.zeros((1 + states + v.symbols + 1, states))
        sums[rows["row"].to_numpy(np.int64)] = rows[names].to_numpy()
        start, move, emit = sums[0] + 1, sums[1 : 1 + states] + 1, sums[1 + states : -1] + PRIOR * v.unigram[:, None]
        p = Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return p


def log_likelihood(codes: np.ndarray, at: np.ndarray, p: Parameters) -> np.ndarray:
    """Exact natural log likelihood of each sequence codes[at[i]:at[i + 1]], none of them empty."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    start, sizes = at[:-1][order], length[order]
    total, a = np.zeros(len(order)), None
    n = len(order)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        while n and sizes[n - 1] <= t:
            n -= 1
        a = (p.start[None] if t == 0 else a[:n] @ p.move) * p.emit[codes[start[:n] + t]]
        s = a.sum(1)
        a /= s[:, None]
        total[:n] += np.log(s)
    out = np.empty(len(order))
    out[order] = total
    return out


def _score(shared_p):
    def run(batches):
        for batch in batches:
            data, offsets = _binary(batch.column(batch.num_columns - 1))
            ll = log_likelihood(data.view("<u2"), offsets // 2, shared_p.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(ll)], names=["rid", "id", "held_out", "n_tokens", "known", "logs", "class_logs", "ll"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 2, folds: int = 7, iterations: int = ITERATIONS, states: int = STATES) -> DataFrame:
    """Train on the texts outside the held-out fold, score all:
    id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), column(id_col).cast("bigint").alias("id"), (crc_fold(column(id_col), folds) == held_out_fold).alias("held_out"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    train = rows.where("not held_out")
    counted = train.select("text").mapInArrow(_counts, "h bigint, g int, c bigint")
    counts = materialize(counted.groupBy("h").agg(F.min("g").alias("g"), F.sum("c").alias("c")), "word_counts")
    v = vocabulary(counts, train.count())
    shared = spark.sparkContext.broadcast(v)
    encoded = materialize(rows.mapInArrow(_encode(shared), ENCODED), "symbols")
    p = spark.sparkContext.broadcast(baum_welch(encoded, v, iterations, states))
    scored = encoded.select("rid", "id", "held_out", "n_tokens", "known", "logs", "class_logs", "symbols").mapInArrow(_score(p), "rid bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, class_logs double, ll double")
    # words beyond the dictionary: one row for each text and distinct word, then one for each text
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    found = rare.join(counts.where(F.col("c") < v.least).select("h", "c"), "h")
    per_text = found.groupBy("rid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs"))
    end = math.log10(v.texts + 1)
    space = math.log10(v.total + v.types + 1)
    zero = F.lit(0.0)
    out = scored.join(per_text, "rid", "left")
    return out.select(
        "id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(v.texts > 0))).cast("bigint").alias("n_known"),
        F.lit(int(v.total)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", zero) + F.lit(end) - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("ll") + F.col("class_logs") + F.coalesce("more_logs", zero)).alias("score"),
    )
