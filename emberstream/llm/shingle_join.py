"""N-gram Jaccard join by parity sketches, with exact components.

A document is the set of its distinct word n-grams, as 64-bit hashes. A token toggles one bit of
a sketch, so the Hamming distance of two sketches is at most the size of the symmetric difference
of the sets. Sizes fall into bands; a band's very wide sketch is cut into segments, each known by
the XOR of the hashes of its bits. Linked sets differ by at most d tokens, so of s segments at
least s - d agree; in any common order of segments the first that agrees is among the first d + 1
of either set. Only these are sent, segments of many tokens first, since they seldom agree by chance.

1. Each task emits (segment, set) rows, combined: sets that share a segment within the task become
   one bucket, so that a segment of very many near copies reaches its reducer as one row per task.
   A packed sketch of two to four bits a token goes along with each document.
2. Rows of equal segments, sorted, give groups of sets that might be linked.
3. Groups are joined up by packed sketches alone, which rejects nearly all chance meetings. What is
   left are clusters of suspects; texts of these, and of no other documents, are compared next.
4. Clusters are joined up by comparing whole sets. Components of these links are the result;
   copies of a set share one.

Steps 3 and 4 work alike: every member is first compared with its group's least one, in salted
slices, so that a group of very many copies of one text costs as much as its size. Only members
that share no linked leader then are compared further, block by block; a task returns
links between components, at most one for each, and never its pairs.

Everything is exact but for equal 64-bit hashes of different n-grams or sets (63 bits).

Defined results: a null or empty text has no set and is linked with nothing; fewer words than n
are one n-gram; copies are linked; a null id is linked with nothing and has no component; rows
with equal ids each get the component of their own text (the smallest of both where ids repeat);
an empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, flat, mix64, slices, word_hashes, word_spans
from .workspace import bounded_batches, column, connected_components, fresh, materialize, sliced_join

#: Bytes of text that are cut into words together; rows of segments that a task combines at once.
SLICE, COMBINE = 1 << 18, 1 << 19
#: Sets of a block, and n-grams of all its sets together.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 20
#: Rows and bytes of whole tasks that are worked on at once; pairs of numbers compared at once.
CHUNK_ROWS, CHUNK_BYTES, PAIRS = 8192, 4 << 20, 1 << 16
#: Sets below this size have a sketch so wide that each segment is one token.
SMALL, WIDE = 64, 1024
#: Slots in which segments are counted; what a task reports holds more than so many times its average, and so many.
SLOTS, ABOVE, AT_LEAST = 1 << 22, 2, 4
#: Tags of rows: a bucket's member, a segment's bucket. A document has its set's size instead.
MEMBER, SEGMENT = -2, -1
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Sets of n-grams of ``words`` words link when den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def largest_difference(self, total):
        """The largest symmetric difference of linked sets whose sizes sum up to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest_partner(self, size):
        return size * self.den // self.num


@lru_cache(maxsize=8)
def bands(rule: Rule, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band (and of the one after the last), segments of each band's sketch.

    Linked sets lie in the same or in adjacent bands. Covers sizes up to ``largest``; the tables
    are the same for any larger one, as far as they go.
    """
    ratio = max(1.6, 1.28 * rule.den / rule.num)
    first, segments = [1], []
    while first[-1] <= rule.largest_partner(largest) + 1:
        first.append(max(first[-1] + 1, int(first[-1] * ratio)))
    for after in first[1:]:
        d = rule.largest_difference(after - 1 + rule.largest_partner(after - 1))
        segments.append(WIDE if after <= SMALL else max(d + 1 + 8, math.ceil(1.12 * (d + 1)) + 8))
    return np.array(first), np.array(segments)


def shingles(texts: pa.Array, words: int):
    """Yields (first row, offsets, sorted distinct n-gram hashes) for slices of rows."""
    data, offsets = flat(texts)
    for a, b in slices(offsets, SLICE):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, at)
        h = word_hashes(part, starts, ends)
        count = np.diff(first)
        full = np.maximum(0, len(h) - words + 1)
        gram = np.full(full, words, _U)
        for i in range(words):
            gram = mix64(gram ^ h[i : i + full]) * _U(0x9FB21C651E98DF25) + _U(i)
        sets = []
        for i in range(b - a):
            if count[i] >= words:
                sets.append(np.unique(gram[first[i] : first[i + 1] - words + 1]))
            elif count[i]:
                one = _U(count[i])
                for x in h[first[i] : first[i + 1]]:
                    one = mix64(np.array([one ^ x]))[0]
                sets.append(np.array([one], _U))
            else:
                sets.append(np.zeros(0, _U))
        sizes = np.array([len(s) for s in sets], np.int64)
        yield a, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets) if sets else np.zeros(0, _U)


def set_ids(at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """An even 63-bit number for each set; those of empty sets mean nothing."""
    sums = np.concatenate([[_U(0)], np.cumsum(mix64(grams + _U(0x51ED270B)))])
    total = mix64((sums[at[1:]] - sums[at[:-1]]) ^ mix64(np.diff(at).astype(_U)))
    return (total & ~_U(1)).view(np.int64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _name(scheme: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return mix64(scheme.astype(_U) * _U(1 << 32) + segment.astype(_U) + _U(1))


def _segments(at: np.ndarray, grams: np.ndarray, rule: Rule):
    """For the sketch of each set's own band and for that of the band below: (scheme of each set,
    segments of each scheme, how many segments each set sends, and row, segment, key, tokens of each
    segment that is not empty, by row)."""
    sizes = np.diff(at)
    first, segments = bands(rule, 1 << int(sizes.max(initial=1)).bit_length())
    band = np.searchsorted(first, np.maximum(sizes, 1), "right") - 1
    for below in (0, 1):
        scheme = np.maximum(band - below, 0)
        most = first[scheme + 1] - 1  # the largest set of the scheme's own band
        partner = np.minimum(rule.largest_partner(sizes), most if below else rule.largest_partner(most))
        live = (sizes > 0) & ((band > 0) & (sizes <= rule.largest_partner(most)) if below else True)
        need = np.where(live, rule.largest_difference(sizes + partner) + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), np.where(live, sizes, 0))
        g = grams[np.repeat(live, sizes)]
        h = mix64(g ^ mix64(scheme[owner].astype(_U) + _U(77)))
        segment = ((h >> _U(32)) * segments[scheme[owner]].astype(_U) >> _U(32)).astype(np.int64)
        order = np.argsort((owner << 32) + segment, kind="stable")
        cell = ((owner << 32) + segment)[order]
        starts = _starts(cell)
        content = np.bitwise_xor.reduceat(mix64(h[order]), starts) if len(starts) else np.zeros(0, _U)
        tokens = np.diff(np.append(starts, len(cell)))
        row, segment = cell[starts] >> 32, cell[starts] & 0xFFFFFFFF
        yield scheme, segments, need, row, segment, mix64(content ^ _name(scheme[row], segment)) + tokens.astype(_U), tokens


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + _U(0x2545F491)) & _U(SLOTS - 1)).astype(np.int64)


def _count(rule: Rule):
    """(slot, n) of a task's slots that hold clearly more segments than its average one."""

    def run(batches):
        counts = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for _, at, grams in shingles(batch.column(0), rule.words):
                for *_, key, _ in _segments(at, grams, rule):
                    slot, n = np.unique(_slot(key), return_counts=True)
                    counts[slot] += n.astype(np.int32)
        slot = np.flatnonzero(counts > AT_LEAST + ABOVE * int(counts.sum(dtype=np.int64)) / SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(counts[slot].astype(np.int64))], names=["slot", "n"])

    return run


def frequencies(texts: DataFrame, rule: Rule) -> np.ndarray:
    """The order's first part for each slot (a byte), from rows of one column, text.

    However many documents there are, these are ``SLOTS`` bytes on the driver and in each worker."""
    found = texts.mapInArrow(_count(rule), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = materialize(found.select("slot", F.ceil(F.log2("n")).cast("tinyint").alias("level")), "frequencies").toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[found["slot"].to_numpy()] = found["level"].to_numpy()
    return out


def segment_keys(at: np.ndarray, grams: np.ndarray, rule: Rule, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of each key, key): the first segments of each set, in the sketch of its own band and,
    if it can be linked with a set of the band below, in that band's; seldom ones first."""
    rows, keys = [], []
    for scheme, segments, need, row, segment, key, tokens in _segments(at, grams, rule):
        level = np.zeros(len(key), np.uint8) if frequent is None else frequent[_slot(key)]
        best = np.lexsort((key, -tokens, level, row))
        row, key, segment = row[best], key[best], segment[best]
        filled = np.bincount(row, minlength=len(need))
        place = np.arange(len(row)) - (np.cumsum(filled) - filled)[row]
        rows.append(row[place < need[row]])
        keys.append(key[place < need[row]])
        for i in np.flatnonzero(need > filled):  # empty segments come last, by their names
            taken = segment[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
            free = np.setdiff1d(np.arange(segments[scheme[i]]), taken)
            names = np.sort(_name(np.full(len(free), scheme[i]), free))[: need[i] - filled[i]]
            rows.append(np.full(len(names), i))
            keys.append(names)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def sketches(at: np.ndarray, grams: np.ndarray, bits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Packed parity sketches end to end, and where each starts: a power of two of 64-bit words, at
    least ``bits`` bits for each token. Halves of a sketch, XORed, are the sketch of half the width."""
    sizes = np.diff(at)
    width = np.int64(1) << np.ceil(np.log2(np.maximum(1, sizes * bits / 64))).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = mix64(grams)
    out = np.zeros(start[-1], _U)
    np.bitwise_xor.at(out, start[owner] + ((h >> _U(6)).astype(np.int64) & (width[owner] - 1)), _U(1) << (h & _U(63)))
    return out, start


def hamming(data: np.ndarray, start: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of sketches i and j, the wider one folded to the width of the other."""
    width = np.diff(start)
    out = np.zeros(len(i), np.int64)
    code = width[i] * (1 << 32) + width[j]
    for c in np.unique(code):
        a, b = int(c >> 32), int(c & 0xFFFFFFFF)
        low, step = min(a, b), max(1, (1 << 20) // max(a, b))
        of = np.flatnonzero(code == c)
        for k in range(0, len(of), step):
            p = of[k : k + step]
            x = np.bitwise_xor.reduce(data[start[i[p]][:, None] + np.arange(a)].reshape(len(p), -1, low), axis=1)
            y = np.bitwise_xor.reduce(data[start[j[p]][:, None] + np.arange(b)].reshape(len(p), -1, low), axis=1)
            out[p] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


_ROW = "k bigint, v bigint, n int, s binary"
_NAMES = ["k", "v", "n", "s"]


def _out(k, v, n, s=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int32()), pa.nulls(len(v), pa.binary()) if s is None else s], names=_NAMES)


def _pieces(k, v, n, rows: int = 100_000):
    for i in range(0, len(k), rows):
        yield _out(k[i : i + rows], v[i : i + rows], np.full(len(k[i : i + rows]), n, np.int32))


def combine(keys: np.ndarray, sids: np.ndarray):
    """Of (segment, set) rows: (segment, bucket) with one row per segment, and (bucket, set) for
    buckets of several sets, whose numbers are odd."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[fresh], sids[fresh]
    at = _starts(keys)
    size = np.diff(np.append(at, len(keys)))
    bucket = sids[at].copy()
    several = size > 1
    if several.any():
        total = np.add.reduceat(mix64(sids.view(_U)), at)
        bucket[several] = (mix64(total[several] + size[several].astype(_U)) | _U(1)).view(np.int64)
    owner = np.repeat(np.arange(len(at)), size)
    inside = several[owner]
    pairs = np.unique(np.stack([bucket[owner[inside]], sids[inside]]), axis=1) if inside.any() else np.zeros((2, 0), np.int64)
    return keys[at], bucket, pairs[0], pairs[1]


def _packed(data: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer((start * 8).astype(np.int32)), pa.py_buffer(data)])


def _emit(rule: Rule, frequent: np.ndarray):
    def run(batches):
        keys, sids, waiting = [], [], 0

        def flush():
            k, bucket, b, s = combine(np.concatenate(keys), np.concatenate(sids))
            yield from _pieces(k, bucket, SEGMENT)
            yield from _pieces(b, s, MEMBER)

        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            for a, at, grams in shingles(batch.column(1), rule.words):
                n = len(at) - 1
                sid = set_ids(at, grams)
                yield _out(ids.slice(a, n), sid, np.diff(at).astype(np.int32), _packed(*sketches(at, grams)))
                row, key = segment_keys(at, grams, rule, frequent)
                use = known[a : a + n][row]
                keys.append(key[use])
                sids.append(sid[row[use]])
                waiting += len(keys[-1])
                if waiting > COMBINE:
                    yield from flush()
                    keys, sids, waiting = [], [], 0
        if waiting:
            yield from flush()

    return run


def _gather(batches):
    """From rows sorted by (k, n, v): documents and members as they are, and for each segment the
    rows (first bucket, bucket) if it has several buckets or one of several sets."""
    last_k, pivot, told = None, None, True
    for batch in batches:
        n = np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).astype(np.int32)
        other = np.flatnonzero(n != SEGMENT)
        if len(other):
            take = pa.array(other)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(4)], names=_NAMES)
        seg = np.flatnonzero(n == SEGMENT)
        if not len(seg):
            continue
        # taken before they are converted: keys of documents may be null, those of segments are not
        k, v = (batch.column(i).take(pa.array(seg)).to_numpy(zero_copy_only=False) for i in range(2))
        head = np.concatenate([[last_k is None or k[0] != last_k], k[1:] != k[:-1]])
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        first = np.where(group >= 0, v[at[np.maximum(group, 0)]] if len(at) else 0, 0)
        if not head[0]:
            first[group < 0] = pivot
        size = np.bincount(group + 1, minlength=len(at) + 1)
        rows_a, rows_b = [], []
        if not head[0]:
            if not told:
                rows_a.append(np.array([pivot]))
                rows_b.append(np.array([pivot]))
            told = True
        several = (size > 1)[group + 1] | (group < 0) | ((v & 1 == 1) & head)
        rows_a.append(first[several])
        rows_b.append(v[several])
        a, b = np.concatenate(rows_a), np.concatenate(rows_b)
        if head.any():
            told = bool(several[at[-1]])
        last_k, pivot = k[-1], first[-1]
        pairs = np.unique(np.stack([a, b]), axis=1)
        yield from _pieces(pairs[0], pairs[1], SEGMENT)


def _sets(words: int):
    """(wanted, text) rows with their set's number and size."""

    def run(batches):
        for batch in batches:
            for a, at, grams in shingles(batch.column(1), words):
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(set_ids(at, grams)), pa.array(np.diff(at).astype(np.int32)), batch.column(1).slice(a, n)], names=["wanted", "sid", "size", "text"])

    return run


class _Sketched:
    """Packed sketches of a chunk's rows: pairs that may be linked by their Hamming distance."""

    def __init__(self, rule: Rule, load: pa.Array, size: np.ndarray):
        self.rule, self.size = rule, size
        load = load.cast(pa.large_binary())
        offsets = np.frombuffer(load.buffers()[1], np.int64)[load.offset : load.offset + len(load) + 1]
        self.data, self.start = np.frombuffer(load.buffers()[2], _U, (offsets[-1] - offsets[0]) // 8, int(offsets[0])), (offsets - offsets[0]) // 8

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of the pairs that may be linked."""
        most = self.rule.largest_difference(self.size[i] + self.size[j])
        of = np.flatnonzero(np.abs(self.size[i] - self.size[j]) <= most)
        return of[hamming(self.data, self.start, i[of], j[of]) <= most[of]]

    def linked(self, a: int, b: int) -> bool:
        return True


class _Whole(_Sketched):
    """Whole sets of a chunk's rows, and wider sketches of them."""

    def __init__(self, rule: Rule, load: pa.Array, size: np.ndarray):
        self.rule, parts, total = rule, [], [np.zeros(1, np.int64)]
        for _, at, grams in shingles(load, rule.words):
            parts.append(grams)
            total.append(at[1:] + total[-1][-1])
        self.at, self.grams = np.concatenate(total), np.concatenate(parts) if parts else np.zeros(0, _U)
        self.size = np.diff(self.at)
        self.data, self.start = sketches(self.at, self.grams, 8)

    def linked(self, a: int, b: int) -> bool:
        x, y = self.grams[self.at[a] : self.at[a + 1]], self.grams[self.at[b] : self.at[b + 1]]
        return self.rule.linked(_common(x, y), len(x), len(y))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


_TASK = ["part", "p", "q", "side", "x", "home", "size", "load"]
_EDGE = "a bigint, b bigint"


def _whole_tasks(batches):
    """Tables of whole tasks (part, p, q), from rows sorted by them."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK_ROWS and sum(b.nbytes for b in held) < CHUNK_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([table[c].to_numpy() for c in _TASK[:3]])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
        if len(change):
            yield table.slice(0, change[-1] + 1).combine_chunks()
            held = table.slice(change[-1] + 1).to_batches()
        else:
            held = table.to_batches()
        rows = sum(b.num_rows for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... many[0] numbers, then the same of the next."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _compare(rule: Rule, kind):
    """Links between components of the same task: rows of side 0 with those of side 1, or with each
    other where there are none of side 1. Pairs that the task has already joined up are not compared."""

    def run(batches):
        for table in _whole_tasks(batches):
            part, p, q, side, x, home = (table[c].to_numpy() for c in _TASK[:6])
            load = table["load"].chunk(0)
            rows = kind(rule, load, table["size"].to_numpy())
            starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            task = np.cumsum(np.isin(np.arange(len(part)), starts)) - 1
            ends = np.append(starts[1:], len(part))
            lefts = np.bincount(task, side == 0, len(starts)).astype(np.int64)
            alone = lefts == ends - starts
            left = np.flatnonzero(side == 0)
            first = np.where(alone[task[left]], left + 1, (starts + lefts)[task[left]])
            many = ends[task[left]] - first
            names, root = np.unique(home, return_inverse=True)
            up = np.arange(len(names))

            def find(i):
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            found, at = [], 0
            upto = np.cumsum(many)
            while at < len(left):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                i, j = np.repeat(left[at:to], many[at:to]), _spread(first[at:to], many[at:to])
                now = np.array([find(k) for k in range(len(up))]) if len(found) else up
                apart = now[root[i]] != now[root[j]]
                i, j = i[apart], j[apart]
                near = rows.near(i, j)
                for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    ra, rb = find(root[a]), find(root[b])
                    if ra != rb and rows.linked(a, b):
                        up[max(ra, rb)] = min(ra, rb)
                        found.append((names[root[a]], names[root[b]]))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _stars(rule: Rule, kind):
    """Links of rows of side 1 with the row of side 0 that comes before them."""

    def run(batches):
        for table in _whole_tasks(batches):
            side, x = table["side"].to_numpy(), table["x"].to_numpy()
            rows = kind(rule, table["load"].chunk(0), table["size"].to_numpy())
            member = np.flatnonzero(side == 1)
            leader = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), 0))[member]
            good = rows.near(member, leader)
            good = np.array([k for k in good if rows.linked(int(member[k]), int(leader[k]))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[leader[good]]), pa.array(x[member[good]])], names=["a", "b"])

    return run


def _blocks(n, weight, unit: int):
    return F.greatest(F.lit(1), F.ceil(n / BLOCK_SETS), F.ceil(weight / unit)).cast("int")


def _deal(rest: DataFrame) -> DataFrame:
    """(part, p, q, side, x, home): which rows meet in which task, from (part, x, home, size).

    Of a part, the rows of its most frequent component need not be compared with each other. They
    are cut into slices, the others into blocks; a block meets every slice and every other block.
    Rows of the frequent component are sent once for each block of others.
    """
    cells = rest.groupBy("part", "home").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    tops = cells.groupBy("part").agg(F.max(F.struct("n", "w", "home")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    tops = tops.select("part", F.col("top.home").alias("main"), _blocks(F.col("top.n"), F.col("top.w"), BLOCK_GRAMS).alias("slices"), _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"), BLOCK_GRAMS).alias("blocks"))
    rows = sliced_join(rest, materialize(tops, "tops"), "part", "x")
    inside = F.col("home") == F.col("main")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("x"), F.when(inside, F.col("slices")).otherwise(F.col("blocks"))).cast("int"))
    one = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(side).alias("side"))
    own, last = F.col("own"), F.col("slices") + F.col("blocks") - 1
    as_slice = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda p: one(p, own, 1))
    as_left = F.transform(F.concat(F.sequence(F.lit(0), F.col("slices") - 1), F.sequence(F.col("slices") + own, last)), lambda q: one(own, q, 0))
    as_right = F.transform(F.filter(F.sequence(F.lit(0), own), lambda p: p < own), lambda p: one(p, F.col("slices") + own, 1))
    return rows.withColumn("t", F.explode(F.when(inside, as_slice).otherwise(F.concat(as_left, as_right)))).select("part", "t.p", "t.q", "t.side", "x", "home", "size")


def _join_up(groups: DataFrame, loads: DataFrame, rule: Rule, kind, name: str) -> DataFrame:
    """Components (node, component) of the links between rows of a group (part, leader, x), by
    comparing what ``loads`` (x, size, load) holds of them. The leader is a group's least x."""
    star = groups.where("x <> leader").select("leader", "x").distinct()
    slots = star.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("slots"))
    slots = materialize(slots, f"{name}_leaders")
    none = F.lit(0).cast("bigint").alias("home")
    member = sliced_join(star, slots, "leader", "x").select(F.col("leader").alias("part"), F.pmod(F.xxhash64("x"), F.col("slots")).cast("int").alias("p"), F.lit(0).alias("q"), F.lit(1).alias("side"), "x", none)
    leader = slots.select(F.col("leader").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), F.col("leader").alias("x"), none)

    def compared(tasks: DataFrame, by) -> DataFrame:
        full = tasks.join(loads.select("x", "size", "load"), "x").select(*_TASK)
        placed = full.repartition("part", "p", "q").sortWithinPartitions("part", "p", "q", "side", "x")
        return materialize(placed.mapInArrow(by(rule, kind), _EDGE), f"{name}_links")

    links = compared(member.unionByName(leader), _stars)
    # the leader has met all others; of them, those that do not share their least linked leader are left
    home = links.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("home"))
    others = groups.where("x <> leader").join(home, "x", "left").select("part", "x", F.coalesce("home", "x").alias("home"))
    others = materialize(others, f"{name}_others")
    mixed = others.groupBy("part").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("part")
    rest = materialize(sliced_join(others, mixed, "part", "x").join(loads.select("x", "size"), "x"), f"{name}_rest")
    return connected_components(links.unionByName(compared(_deal(rest).drop("size"), _compare)))


def components(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    return _components(docs, rule, id_col, text_col).drop("sid")


def _components(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """The same with the document's set, sid."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).alias("text"))
    frequent = frequencies(rows.where("id is not null").select("text"), rule)
    emitted = rows.mapInArrow(_emit(rule, frequent), _ROW).repartition(F.coalesce("k", "v")).sortWithinPartitions("k", "n", "v")
    gathered = materialize(emitted.mapInArrow(_gather, _ROW), "segments")
    per_doc = gathered.where("n >= 0").select(F.col("k").alias("id"), F.col("v").alias("sid"), "n")
    member = gathered.where(F.col("n") == MEMBER).select(F.col("k").alias("bucket"), F.col("v").alias("x")).distinct()
    pair = gathered.where(F.col("n") == SEGMENT).select(F.col("k").alias("part"), F.col("v").alias("bucket")).distinct()
    single = pair.where("bucket % 2 = 0").select("part", F.col("bucket").alias("x"))
    group = materialize(pair.where("bucket % 2 <> 0").join(member, "bucket").select("part", "x").unionByName(single).distinct(), "groups")
    # of groups with the same sets, one
    sums = group.groupBy("part").agg(F.count("*").alias("m"), F.sum(F.xxhash64("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("leader")).where("m > 1")
    once = materialize(sums.groupBy("m", "s").agg(F.min(F.struct("part", "leader")).alias("g")).select("g.*"), "distinct_groups")
    group = materialize(sliced_join(group, once, "part", "x"), "groups_once")
    # combined before any shuffle: a set may have very many copies
    least = materialize(per_doc.where("id is not null and n > 0").groupBy("sid").agg(F.min("id").alias("least")), "least")
    known = least.join(group.select(F.col("x").alias("sid")).distinct(), "sid")
    own = gathered.where("n > 0 and k is not null").select(F.col("k").alias("least"), F.col("v").alias("sid"), F.col("n").alias("size"), F.col("s").alias("load"))
    sketched = materialize(own.join(known, ["sid", "least"]).select(F.col("sid").alias("x"), "size", "load"), "sketches")
    suspects = _join_up(group, sketched, rule, _Sketched, "suspects")
    wanted = materialize(suspects.join(least, F.col("node") == F.col("sid")).select(F.col("least").alias("of"), F.col("sid").alias("wanted")), "wanted")
    # texts are sorted once by id, however few are wanted: the same plan at every size
    texts = rows.join(wanted.hint("merge"), F.col("id") == F.col("of")).select("wanted", "text")
    sets = texts.mapInArrow(_sets(rule.words), "wanted bigint, sid bigint, size int, text string").where("wanted = sid")
    sets = materialize(sets.select(F.col("sid").alias("x"), "size", F.col("text").alias("load")), "sets")
    part = _join_up(suspects.select(F.col("component").alias("part"), F.col("component").alias("leader"), F.col("node").alias("x")), sets, rule, _Whole, "clusters")
    inside = materialize(part.join(least, F.col("node") == F.col("sid")).select("sid", "component", "least"), "linked_sets")
    smallest = inside.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = inside.join(smallest, "component").select("sid", "component_id")
    by_set = materialize(least.join(joined, "sid", "left").select("sid", F.coalesce("component_id", "least").alias("component_id")), "set_ids")
    linked = per_doc.where("n > 0").join(by_set, "sid", "left").select("id", "sid", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return linked.unionByName(per_doc.where("n = 0").select("id", "sid", F.lit(0).cast("bigint").alias("n_shingles"), F.col("id").alias("component_id")))


def drop_near_copies(docs: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: of each component the rows with the smallest
    id. Rows with a null id stay; of rows that share an id, those go whose own text is a near copy."""
    rule = rule or Rule()
    marks = _components(docs, rule, id_col, text_col).where("id is not null").select("id", "sid", (F.col("component_id") != F.col("id")).alias("gone"))
    name, digest = fresh("_gone", docs.columns), fresh("_digest", docs.columns)
    ids = marks.groupBy("id").agg(F.max("gone").alias("gone"), F.min("gone").alias("all")).where("gone")
    ids = materialize(ids.select("id", "all"), "near_copies")
    gone = ids.where("all").select(F.col("id").alias(name), F.lit(None).cast("string").alias(digest))
    some = ids.where("not all").select("id")
    if not some.isEmpty():  # of these ids, texts are told apart by their digests
        text = column(text_col)
        texts = docs.select(column(id_col).cast("bigint").alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text")).join(some, "id")
        sets = texts.select(F.struct("id", "digest").alias("wanted"), "text").mapInArrow(_sets(rule.words), "wanted struct<id:bigint,digest:string>, sid bigint, size int, text string")
        sets = sets.where("size > 0").select("wanted.id", "wanted.digest", "sid")
        pairs = marks.where("gone").join(some, "id", "left_semi").select("id", "sid").distinct()
        pairs = sets.join(pairs, ["id", "sid"]).select(F.col("id").alias(name), F.col("digest").alias(digest)).distinct()
        gone = materialize(gone.unionByName(pairs), "near_copies")
    same = F.col(digest).isNull() | (F.col(digest) == F.sha2(column(text_col).cast("binary"), 256))
    return docs.join(gone, (column(id_col) == F.col(name)) & same, "left_anti")
