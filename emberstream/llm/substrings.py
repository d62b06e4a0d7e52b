"""Substring dedup by seed and extend: words that repeat an earlier passage are found and removed.

A window is ``words`` consecutive words of a document. It goes when the same words also start
earlier: in a document of smaller id, or before in the same document. What goes of a document is the
union of its windows, that is its maximal repeats of at least ``words`` words.

1. Seeds: of the word n-grams (``SEED`` words) inside a window the one with the least hash is its
   anchor, so equal windows have equal anchors at equal places. Consecutive windows of one anchor are
   a run; a run goes out as one row of numbers. Equal runs meet: all but the earliest are repeats.
2. Extension: anchors that are seen with different surroundings are extended to both sides in the
   texts themselves: their windows are hashed whole and meet by that hash; all but the earliest go.
3. The repeats of a document, as intervals, meet its text once.

Every task first resolves what it holds itself, so that a passage of very many copies leaves a task
as one row; the other copies are decided there. An anchor that a task has seen with several
surroundings is known to need extension: these rows are dealt by their surroundings, and one row
tells the other tasks' rows of that anchor. No pairs are made.

Defined results: a null text has no words; a null id comes after all others; rows that share an id
are judged against smaller ids and their own text only, so repeated rows get equal results; texts
below ``words`` words lose nothing; other columns are ignored by ``repeats`` and kept by
``without_repeats``; an empty table gives no rows. Word sequences are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import _powers, flat, mix64, slices, word_hashes, word_spans
from .workspace import bounded_batches, column, fresh, materialize

#: Words of a seed. A window holds ``words - SEED + 1`` of them.
SEED = 10
#: Bytes of text that are hashed together; rows that a task resolves at once.
SLICE, COMBINE = 1 << 20, 1 << 19
#: The id of rows without one: after all others.
LAST = (1 << 63) - 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROW = "part bigint, run int, id bigint, key bigint, at bigint"
_NAMES = ["part", "run", "id", "key", "at"]
_SPAN = "key bigint, first bigint, n bigint"


class _Sequences:
    """Hashes of any range of words, by prefix sums of a polynomial over the words' hashes."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, _U)
        np.cumsum(words * _powers(_BASE, len(words)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(words) + 1)

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(_U))


def _runs(hashes: np.ndarray, first: np.ndarray, words: int):
    """Anchor, run hash, text, first window and windows of each run; ``first`` bounds the texts' words."""
    n = len(hashes) - words + 1
    if n <= 0:
        return (np.zeros(0, _U), np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3)))
    of = _Sequences(hashes)
    seeds = len(hashes) - SEED + 1
    gram = of(np.arange(seeds), np.arange(SEED, seeds + SEED))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.flatnonzero(first[text + 1] - np.arange(n) >= words)
    if not len(inside):
        return _runs(hashes[:0], first[:1], words)
    wide = words - SEED + 1
    order = mix64(gram ^ _U(0x5DEECE66D))
    place = np.zeros(n, np.int64)
    best = order[:n].copy()
    for i in range(1, wide):
        better = order[i : i + n] < best
        best = np.where(better, order[i : i + n], best)
        place = np.where(better, i, place)
    anchor = (np.arange(n) + place)[inside]
    change = np.ones(len(inside), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[inside][1:] != text[inside][:-1])
    head = np.flatnonzero(change)
    a, many = inside[head], np.diff(np.append(head, len(inside)))
    whole = mix64(of(a, a + many + words - 1) ^ (anchor[head] - a).astype(_U))
    return gram[anchor[head]], (whole >> _U(32)).astype(np.uint32), text[a], a - first[text[a]], many


def _later(group: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray):
    """The order of rows by (group, id, key, at), and which of them in that order have an earlier one:
    in the same group with a smaller id, or of the same key."""
    order = np.lexsort((at, keys, ids, group))
    g, i, k, a = group[order], ids[order], keys[order], at[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(g) else i
    new_key = new.copy()
    new_key[1:] |= k[1:] != k[:-1]
    start = a[np.flatnonzero(new_key)][np.cumsum(new_key) - 1] if len(g) else a
    return order, (i > least) | (a > start)


def _merged(keys: np.ndarray, first: np.ndarray, n: np.ndarray):
    """Intervals [first, first + n) of each key that touch or overlap become one."""
    if not len(keys):
        return keys, first, n
    order = np.lexsort((first, keys))
    k, a, e = keys[order], first[order], (first + n)[order]
    new = np.ones(len(k), bool)
    shift = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) * (int(e.max()) + 1)  # keys apart, so that one running maximum does
    reach = np.maximum.accumulate(e + shift)
    new[1:] = (a + shift)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return k[head], a[head], np.append(reach[head[1:] - 1], reach[-1]) - shift[head] - a[head]


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_NAMES)


def _pieces(*columns, rows: int = 100_000):
    for i in range(0, len(columns[0]), rows):
        yield _batch(*(c[i : i + rows] for c in columns))


#: In ``at``: the first window above these bits, below them twice the windows of the run, plus 1 if it needs extension.
BITS = 16


def _at(first: np.ndarray, n: np.ndarray, open_: np.ndarray | bool) -> np.ndarray:
    return (first << BITS) + n * 2 + open_


#: ``run`` of rows that are no runs: intervals that are decided (``at`` is their first window, ``id`` their
#: length) and the word that an anchor has several surroundings.
GONE, TOLD = -1, -2


def _gone(keys, first, n):
    k, a, n = _merged(keys, first, n)
    part = mix64(k.view(_U) + a.astype(_U)).view(np.int64)
    return _pieces(part, np.full(len(k), GONE, np.int32), n, k, a)


def _seeds(words: int):
    """From (id, key, text): runs, as rows of numbers, after the task has resolved its own."""

    def run(batches):
        held, waiting = [], 0

        def flush():
            anchor, code, ids, keys, first, n = (np.concatenate(c) for c in zip(*held, strict=True))
            cell = mix64(anchor ^ (code.astype(_U) + _U(1)) * _U(0x9FB21C651E98DF25))
            order, later = _later(cell, ids, keys, first)
            gone, stay = order[later], order[~later]
            yield from _gone(keys[gone], first[gone], n[gone])
            anchor, code, cell, ids, keys, first, n = (x[stay] for x in (anchor, code, cell, ids, keys, first, n))
            by = np.lexsort((cell, anchor))
            a, c = anchor[by], cell[by]
            head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(a)))
            differ = np.zeros(len(a), np.int64)
            differ[1:] = (c[1:] != c[:-1]) & (a[1:] == a[:-1])
            several = np.repeat(np.add.reduceat(differ, head) > 0, size) if len(a) else np.zeros(0, bool)
            open_ = np.zeros(len(a), bool)
            open_[by] = several
            part = np.where(open_, cell, anchor).view(np.int64)
            yield from _pieces(part, (code & np.uint32(0x7FFFFFFF)).astype(np.int32), ids, keys, _at(first, n, open_))
            told = np.unique(anchor[open_]).view(np.int64)
            none = np.zeros(len(told), np.int64)
            yield from _pieces(told, np.full(len(told), TOLD, np.int32), none, none, none)

        for batch in batches:
            ids, keys = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            for a, b, hashes, first in _words(batch.column(2)):
                anchor, code, text, start, n = _runs(hashes, first, words)
                held.append((anchor, code & np.uint32(0x7FFFFFFF), ids[a:b][text], keys[a:b][text], start, n))
                waiting += len(anchor)
                if waiting > COMBINE:
                    yield from flush()
                    held, waiting = [], 0
        if waiting:
            yield from flush()

    return run


def _words(texts: pa.Array):
    """Slices of rows (from, to) with the hashes of their words and where each row's begin."""
    data, offsets = flat(texts)
    for a, b in slices(offsets, SLICE):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, at)
        yield a, b, word_hashes(part, starts, ends), first


def _windows(words: int):
    """From (id, key, text, runs): each window of the runs by its hash, after the task has resolved its own."""

    def run(batches):
        held, waiting = [], 0

        def flush():
            window, ids, keys, first = (np.concatenate(c) for c in zip(*held, strict=True))
            order, later = _later(window, ids, keys, first)
            gone, stay = order[later], order[~later]
            yield from _gone(keys[gone], first[gone], np.ones(len(gone), np.int64))
            yield from _pieces(window[stay].view(np.int64), np.zeros(len(stay), np.int32), ids[stay], keys[stay], first[stay])

        for batch in batches:
            ids, keys = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            runs = batch.column(3)
            for a, b, hashes, first in _words(batch.column(2)):
                mine = runs.slice(a, b - a)
                text = np.repeat(np.arange(b - a), mine.value_lengths().to_numpy(zero_copy_only=False))
                at = mine.flatten().to_numpy(zero_copy_only=False)
                start, n = at >> BITS, (at & ((1 << BITS) - 1)) >> 1
                row = np.repeat(np.arange(len(at)), n)
                one = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                word = first[text[row]] + one
                held.append((_Sequences(hashes)(word, word + words), ids[a:b][text[row]], keys[a:b][text[row]], one))
                waiting += len(row)
                if waiting > COMBINE:
                    yield from flush()
                    held, waiting = [], 0
        if waiting:
            yield from flush()

    return run


def _earlier(rows: DataFrame, *group: str) -> DataFrame:
    """Rows with ``later``: whether the group has a row of a smaller id, or of the same key before it.

    Rows of a group are as many as tasks that have seen it; they stream through a sorted window.
    """
    by = Window.partitionBy(*group).orderBy("id", "key", "at")
    later = (F.col("id") > F.first("id").over(by)) | ((F.lag("key").over(by) == F.col("key")) & (F.lag("at").over(by) < F.col("at")))
    return rows.withColumn("later", F.coalesce(later, F.lit(False)))


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the key tells apart rows that share an id."""
    return docs.select(F.coalesce(column(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(column(id_col).cast("bigint"), column(text_col)).alias("key"), column(text_col).alias("text"))


def _removed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(key, spans): first window and windows of each interval that goes, for each key that has any."""
    if not SEED <= words < 1 << BITS - 2:
        raise ValueError(f"a window has at least {SEED} words")
    bounded_batches(docs.sparkSession)
    rows = _with_keys(docs, id_col, text_col).where(_may_repeat(F.col("text"), words))
    seeds = rows.mapInArrow(_seeds(words), _ROW).repartition("part")
    known = _earlier(seeds, "part", "run")
    anchor = Window.partitionBy("part")
    is_run = F.col("run") >= 0
    known = known.withColumn("open", (F.col("at") % 2 == 1) | (F.min("run").over(anchor) != F.max("run").over(anchor)))
    gone = F.col("run") == GONE
    marks = known.where(gone | (is_run & (F.col("later") | F.col("open")))).select(
        "key",
        F.when(gone, F.col("at")).otherwise(F.shiftright("at", BITS)).alias("first"),
        F.when(gone, F.col("id")).otherwise(F.shiftright(F.col("at").bitwiseAND(F.lit((1 << BITS) - 1)), 1).cast("bigint")).alias("n"),
        (gone | F.col("later")).alias("gone"),
    )
    marks = materialize(marks, "marks")
    wanted = marks.where("not gone").groupBy("key").agg(F.collect_list(F.shiftleft("first", BITS) + F.col("n") * 2).alias("runs"))
    # texts are sorted by key, however few are wanted: the same plan at every size
    extended = rows.join(wanted.hint("merge"), "key").select("id", "key", "text", "runs").mapInArrow(_windows(words), _ROW).repartition("part")
    found = _earlier(extended, "part", "run")
    gone = F.col("run") == GONE
    more = found.where(gone | F.col("later")).select("key", F.col("at").alias("first"), F.when(gone, F.col("id")).otherwise(F.lit(1)).alias("n"))
    spans = marks.where("gone").select("key", "first", "n").unionByName(more)
    return spans.groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def _may_repeat(text, words: int):
    """Texts that are long enough for a window: a character and a blank for each word but the last."""
    return F.coalesce(F.length(text), F.lit(0)) >= 2 * words - 1


def _joined(docs: DataFrame, words: int, id_col: str, text_col: str):
    """The documents with their spans: rows that can have some, and the other rows."""
    text = column(text_col)
    key, spans = fresh("_key", docs.columns), fresh("_spans", docs.columns)
    found = _removed(docs, words, id_col, text_col).select(F.col("key").alias(key), F.col("spans").alias(spans))
    some = docs.where(_may_repeat(text, words)).withColumn(key, F.xxhash64(column(id_col).cast("bigint"), text))
    return some.join(found.hint("merge"), key, "left").drop(key), docs.where(~_may_repeat(text, words)), spans


def _mask(count: int, spans: list | None, words: int) -> np.ndarray:
    """Which of ``count`` words stay."""
    change = np.zeros(count + 1, np.int64)
    for s in spans or ():
        change[s["first"]] += 1
        change[min(count, s["first"] + s["n"] + words - 1)] -= 1
    return np.cumsum(change[:-1]) == 0


def _kept(text: str | None, spans: list | None, words: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one blank."""
    all_words = (text or "").encode().split()
    if not spans:
        return len(all_words), 0, b" ".join(all_words)
    stay = _mask(len(all_words), spans, words)
    kept = [all_words[i] for i in np.flatnonzero(stay)]
    return len(all_words), len(all_words) - len(kept), b" ".join(kept)


def repeats(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats: (id, first_word, end_word) for each interval of words that goes."""
    some, _, spans = _joined(docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).alias("text")), words, "id", "text")

    def run(batches):
        for batch in batches:
            out = []
            for i, text, found in zip(*(batch.column(c).to_pylist() for c in ("id", "text", spans)), strict=True):
                stay = np.concatenate([[True], _mask(len((text or "").encode().split()), found, words), [True]])
                out += [(i, int(a), int(b)) for a, b in zip(np.flatnonzero(stay[:-1] & ~stay[1:]), np.flatnonzero(~stay[:-1] & stay[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["id", "first_word", "end_word"])

    return some.where(column(spans).isNotNull()).select("id", "text", spans).mapInArrow(run, "id bigint, first_word bigint, end_word bigint")


def _each(df: DataFrame, spans: str | None, text_col: str, words: int, names: list[str], make) -> DataFrame:
    """``df`` without its spans, with the columns ``names`` that ``make`` gives for each (words, removed, kept)."""
    kept = [c for c in df.columns if c != spans and c not in names]
    places = [df.columns.index(c) for c in kept]
    text_at, spans_at = df.columns.index(text_col), df.columns.index(spans) if spans else None
    types = {"n_words": T.LongType(), "n_removed": T.LongType()}
    arrow = [pa.int64() if n in types else pa.string() for n in names]

    def run(batches):
        for batch in batches:
            found = batch.column(spans_at).to_pylist() if spans else [None] * batch.num_rows
            rows = [make(*_kept(t.as_py(), s, words)) for t, s in zip(batch.column(text_at), found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + [pa.array([r[j] for r in rows], arrow[j]) for j in range(len(names))], names=[*kept, *names])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in kept] + [T.StructField(n, types.get(n, T.StringType())) for n in names]))


def without_repeats(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``text_col`` replaced by the words that stay, joined by one blank."""
    some, others, spans = _joined(docs, words, id_col, text_col)
    parts = [_each(df, s, text_col, words, [text_col], lambda n, gone, kept: (kept.decode(),)) for df, s in ((some, spans), (others, None))]
    return parts[0].unionByName(parts[1]).select(*[column(c) for c in docs.columns])


def digests(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_removed, kept_sha256."""
    some, others, spans = _joined(docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).alias("text")), words, "id", "text")
    names = ["n_words", "n_removed", "kept_sha256"]
    parts = [_each(df, s, "text", words, names, lambda n, gone, kept: (n, gone, hashlib.sha256(kept).hexdigest())) for df, s in ((some, spans), (others, None))]
    return parts[0].unionByName(parts[1]).select("id", *names)
