"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both encode a text (A with a blank before it, B adds that itself), so their tokens cut the same
bytes. Tokens whose bytes overlap are joined in a bipartite graph: a token points to the one of the
other side that covers its first byte, unless both begin there, when the one of A is a root. These
pointers are a union-find forest that holds every overlap, as of two overlapping tokens one begins
inside the other; jumping along them, all tokens of a batch at once, gives the components. They are
exactly the minimal groups of tokens that cover the same bytes. Members of a component are expanded
to links: pairs that end together.

Counts of linked id pairs are summed in tasks, then over all documents. A fixed number of the most
frequent pairs travels to all tasks (``KNOWN``, whatever the input); links of rarer pairs are joined
with their counts by a shuffle, where none of them is hot.

Defined results: texts that are null, empty, or not given back byte by byte by both tokenizers have
no tokens (zeros, and '' for the groups); special tokens inside texts are plain text; repeated rows
and null ids are rows of their own; other columns are ignored; an empty table gives no rows.

A is read from the file of a byte-level tokenizer. Texts of Latin characters only, where both agree
on what a letter is, are encoded by the faster library of byte-level ranks, made from that file's own
vocabulary and merges; all other texts by the library the file is of. The ids are the same.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import STRETCH, ByteBPE
from .textbytes import flat, slices
from .workspace import bounded_batches, column, materialize

#: Bytes of text that are encoded together; distinct pairs that a task counts before it hands them on.
SLICE, COUNTED = 1 << 20, 1 << 21
#: The most frequent pairs, whose counts travel to all tasks: 16 bytes each.
KNOWN = 1 << 18
#: A character outside of which the fast encoder is not asked.
_OTHER = re.compile("[^\t\n\r -~\xa1-\xac\xae-ɏ]")
_READY: dict[tuple[str, str], _Both] = {}


def byte_of_letter() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def fast_encoder(made: dict, pattern: str):
    """The encoder by ranks, if the vocabulary's ids rise in the order of its merges; else None."""
    import tiktoken

    vocab, spell = made["model"]["vocab"], byte_of_letter()
    special = {t["content"] for t in made.get("added_tokens", [])}
    ranks = {bytes(spell[c] for c in token): i for token, i in vocab.items() if token not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in made["model"]["merges"]]
    ids = [vocab[m] for m in merges]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or any(vocab[c] >= ids[0] for c in spell):
        return None
    return tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Both:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes, pattern: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_str(a)
        self.whole.encode_special_tokens = True
        self.fast = fast_encoder(json.loads(a), pattern)
        spell = byte_of_letter()
        self.a_bytes = [bytes(spell.get(c, 0) for c in self.whole.id_to_token(i) or "") for i in range(self.whole.get_vocab_size())]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def a_ids(self, text: str) -> list[int]:
        if self.fast is not None and not _OTHER.search(text):
            parts = list(ByteBPE.stretches(text))
            if max(map(len, parts)) <= STRETCH + 1:
                return [i for part in parts for i in self.fast.encode_ordinary(part)]
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by A and by B; none where they do not give the text back."""
        a, b = [], []
        for text, mine in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            own = self.a_ids(" " + text) if text else []
            if text:
                whole = (" " + text).encode()
                if b"".join(map(self.a_bytes.__getitem__, own)) != whole or b"".join(map(self.b_bytes.__getitem__, mine)) != whole:
                    own = []
            a.append(own)
            b.append(mine if own else [])
        return a, b


def _both(a: str, b: bytes, pattern: str) -> _Both:
    key = (hashlib.sha256(a.encode() + pattern.encode()).hexdigest(), hashlib.sha256(b).hexdigest())
    if key not in _READY:
        _READY[key] = _Both(a, b, pattern)
    return _READY[key]


def components(a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each token of A and of B, numbered in order. Both cover the same bytes."""
    n = len(a_start)
    up = np.empty(n + len(b_start), np.int64)
    over = np.searchsorted(b_start, a_start, "right") - 1
    up[:n] = np.where(b_start[over] == a_start, np.arange(n), n + over) if n else 0
    up[n:] = np.searchsorted(a_start, b_start, "right") - 1
    root = up[:n] == np.arange(n)
    while True:
        higher = up[up]
        if (higher == up).all():
            break
        up = higher
    number = np.cumsum(root) - 1
    return number[up[:n]], number[up[n:]]


def _strings(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``a1,a2|b1;a3|b2`` for each text; ``cuts`` are the groups before each text, and all."""
    def first(g):
        return np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)

    groups = int(cuts[-1])
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = np.arange(len(a))
    order[np.arange(len(b)) + np.cumsum(na)[gb]] = len(a) + np.arange(len(b))
    mark_a = np.where(first(ga), 1, 0)
    starts = np.isin(ga, cuts[:-1][np.diff(cuts) > 0]) & first(ga)  # the first of a text
    mark = np.concatenate([np.where(starts, 3, mark_a), np.where(first(gb), 2, 0)])
    text = pc.binary_join_element_wise(pa.array([",", ";", "|", ""]).take(pa.array(mark[order])), pa.array(np.concatenate([a, b])[order]).cast(pa.string()), "")
    upto = np.concatenate([[0], np.cumsum(na + nb)])[cuts]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), text), "")


_ENCODED = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def aligned_batch(both: _Both, texts: list[str | None]):
    """n_a, n_b, n_groups, links (text, a, b) in order, and the groups of each text as a string."""
    a_ids, b_ids = both.encode(texts)
    na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())) for ids, n in ((a_ids, na), (b_ids, nb)))
    a_end, b_end = np.cumsum(both.a_len[a]), np.cumsum(both.b_len[b])
    ga, gb = components(a_end - both.a_len[a], b_end - both.b_len[b])
    owner = np.repeat(np.arange(len(texts)), na)
    head = np.concatenate([[True], ga[1:] != ga[:-1]]) if len(ga) else np.zeros(0, bool)
    groups = np.bincount(owner[head], minlength=len(texts))
    cuts = np.concatenate([[0], np.cumsum(groups)])
    # of a component's members, those pairs that end together
    at = np.searchsorted(b_end, a_end)
    pair = np.flatnonzero((at < len(b)) & (b_end[np.minimum(at, max(0, len(b) - 1))] == a_end)) if len(b) else np.zeros(0, np.int64)
    assert (ga[pair] == gb[at[pair]]).all()
    return na, nb, groups, owner[pair], a[pair], b[at[pair]], _strings(a, b, ga, gb, cuts)


def _encode(a: str, b, pattern: str):
    def run(batches):
        for batch in batches:
            both = _both(a.value, b.value, pattern)
            _, offsets = flat(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                na, nb, groups, owner, x, y, strings = aligned_batch(both, texts)
                code = x * len(both.b_bytes) + y
                order = np.lexsort((code, owner))
                o, c = owner[order], code[order]
                head = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])])) if len(c) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(c))).astype(np.int32)
                upto = pa.array(np.concatenate([[0], np.cumsum(np.bincount(o[head], minlength=hi - lo))]).astype(np.int32))
                shown = [hashlib.sha256(s.as_buffer()).hexdigest() if n else "" for s, n in zip(strings, na, strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(v) for v in (na, nb, groups, np.bincount(owner, minlength=hi - lo).astype(np.int64))), pa.array(shown, pa.string())]
                columns += [pa.ListArray.from_arrays(upto, pa.array(c[head])), pa.ListArray.from_arrays(upto, pa.array(times))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def encoded(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: token, group and link counts, the digest of its groups, and its
    distinct linked pairs (a * size of B + b) with how often it has each."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    a, b = sc.broadcast(Path(a_path).read_text()), sc.broadcast(Path(b_path).read_bytes())
    return docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).alias("text")).mapInArrow(_encode(a, b, pattern), _ENCODED)


def _count(batches):
    """(pair, n) of a task's links, summed before they are shuffled."""
    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(p, t):
        for i in range(0, len(p), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(p[i : i + 100_000]), pa.array(t[i : i + 100_000])], names=["pair", "n"])

    for batch in batches:
        p = np.concatenate([pairs, batch.column(0).flatten().to_numpy(zero_copy_only=False)])
        t = np.concatenate([times, batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)])
        pairs, back = np.unique(p, return_inverse=True)
        times = np.bincount(back, t, len(pairs)).astype(np.int64)
        if len(pairs) > COUNTED:
            yield from rows(pairs, times)
            pairs, times = pairs[:0], times[:0]
    yield from rows(pairs, times)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links of all documents have each pair, and whether no other pair of its B id has more."""
    counts = materialize(rows.select("pairs", "times").mapInArrow(_count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    b_id = F.col("pair") % b_size
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    return counts.join(F.broadcast(most), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _lookup(known, rare: bool):
    """Of (row, pairs, times): sums over the known pairs of each row, or else its other pairs."""

    def run(batches):
        pair, n, best = known.value
        for batch in batches:
            lists = batch.column(1)
            p, t = lists.flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(pair, p), max(0, len(pair) - 1))
            hit = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            if rare:
                row = batch.column(0).take(pa.array(owner[~hit]))
                yield pa.RecordBatch.from_arrays([row, pa.array(p[~hit]), pa.array(t[~hit])], names=["row", "pair", "times"])
                continue
            o, a, t = owner[hit], at[hit], t[hit]
            total, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, o, t * n[a])
            np.add.at(top, o, t * best[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(3, 9)), pa.array(total), pa.array(top)], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "count_sum", "n_best"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = materialize(encoded(docs, a_path, b_path, pattern, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "encoded")
    counts = materialize(pair_counts(rows, b_size), "pair_counts")
    top = counts.orderBy(F.col("n").desc(), "pair").limit(KNOWN).toPandas().sort_values("pair")
    known = docs.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))
    sums = rows.select("row", "pairs", "times", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").mapInArrow(_lookup(known, False), "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, count_sum bigint, n_best bigint")
    others = rows.select("row", "pairs", "times").mapInArrow(_lookup(known, True), "row bigint, pair bigint, times bigint")
    more = others.join(counts.hint("merge"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    nothing = F.lit(0).cast("bigint")
    return sums.join(more.hint("merge"), "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", nothing)).alias("n_best"), (F.col("count_sum") + F.coalesce("more", nothing)).alias("count_sum"), "groups_sha256")
