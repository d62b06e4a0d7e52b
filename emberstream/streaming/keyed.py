"""A model for each key of a stream, with its input buffer, in the state store.

Rows of a key wait in the state until ``input_buffer`` of them have come; each full group is learned
and scored by the model's real steps on arrays, and its rows leave with the number of their group.
What waits is state like the model: a restart goes on with it, and a processing-time timer
(``wait_ms``) hands out the rest of a key that gets no more rows. Every row leaves once. A query with
timers never ends by itself, so it needs a processing-time trigger.

The model is a map state from observer to its numbers and its color map, and one clock, so that the
``statestore`` reader shows the models of any batch as tables (``observers``, ``waiting``).

Within a micro-batch the rows of a key are ordered by (t, idx). A task holds ``HELD`` rows of a key at
most, however many a micro-batch, a buffer or a group has: more are sorted as runs in the state, which
are merged block by block, and a group is read from its blocks three times, to draw observers, to count
hits and to score.

``score_in_order`` orders rows over micro-batches, too: they are held until the watermark has passed
them. What is learned then does not depend on the order in which rows come, as long as none comes
later than the delay; those that do are scored, marked and counted, and not learned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import decay
from ..operators import steps
from ..operators.steps import Parameters, State

_OBSERVER = "features array<double>, observations double, added double, touched double, label int, cutoff double, colors array<int>, weights array<double>, colored array<double>"
_CLOCK = "version bigint, rows bigint, next_color bigint"
_BLOCK = "idx array<bigint>, t array<double>, features array<array<double>>"
_SCORED = "key {}, grp bigint, idx bigint, label int, score double"
_COLUMNS = ["key", "grp", "idx", "label", "score"]
_POINT = ["idx", "t", "features"]

#: The most rows of a key that a task sorts at once, and those of a block of its state.
HELD, BLOCK = 1 << 17, 1 << 12


class Blocks:
    """Rows of a key as blocks of ``BLOCK`` rows in a map state, in runs of adjacent blocks. The rows of a
    run are ordered by (t, idx), if those that are added are, and are taken in that order over all runs."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, more: str = ""):
        self.state = handle.getMapState(name, "block bigint", _BLOCK + more)
        self.index = handle.getValueState(f"{name}_index", "first array<bigint>, last array<bigint>, rows bigint")
        self.columns = [c.split()[0] for c in (_BLOCK + more).split(", ")]

    def _runs(self) -> tuple[list[int], list[int], int]:
        """The first block of each run, the one behind its last, and the number of rows."""
        first, last, rows = self.index.get() if self.index.exists() else ([], [], 0)
        return list(first), list(last), rows

    def __len__(self) -> int:
        return self._runs()[2]

    def _read(self, block: int) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.columns, self.state.getValue((block,)), strict=True)))

    def _write(self, block: int, rows: pd.DataFrame) -> None:
        lists = (rows[c].tolist() if c != "features" else [np.asarray(f, float).tolist() for f in rows[c]] for c in self.columns)
        self.state.updateValue((block,), tuple(lists))

    def add(self, rows: pd.DataFrame, ordered: bool = True) -> None:
        """A run of its own if ``ordered``; a short one joins a short one before it."""
        if not len(rows):
            return
        first, last, many = self._runs()
        many += len(rows)
        at = max(last, default=0)
        if len(rows) < BLOCK and first and last[-1] == at and (not ordered or at - first[-1] == 1):
            short = self._read(at - 1)
            if len(short) + len(rows) <= BLOCK:
                rows, at = pd.concat([short, rows], ignore_index=True), at - 1
                rows = _sorted(rows) if ordered else rows
                if first[-1] == at:
                    first, last = first[:-1], last[:-1]
                else:
                    last[-1] = at
        for a in range(0, len(rows), BLOCK):
            self._write(at + a // BLOCK, rows.iloc[a : a + BLOCK])
        end = at + -(-len(rows) // BLOCK)
        if first and not ordered:
            last[-1] = end
        else:
            first, last = [*first, at], [*last, end]
        self.index.update((first, last, many))

    def __iter__(self) -> Iterator[pd.DataFrame]:
        for a, b in zip(*self._runs()[:2], strict=True):
            for block in range(a, b):
                yield self._read(block)

    def take(self, until: int | None = None) -> Iterator[pd.DataFrame]:
        """Merges the runs and removes what it yields: all rows, or those with ``ms`` before ``until``. One block of each run is held."""
        first, last, many = self._runs()
        at_hand: list[pd.DataFrame | None] = [None] * len(first)
        whole = [True] * len(first)
        while True:
            for r in range(len(first)):
                if at_hand[r] is None and first[r] < last[r]:
                    at_hand[r], whole[r] = self._read(first[r]), True
            live = [r for r, rows in enumerate(at_hand) if rows is not None]
            # up to the least of the last rows of runs that go on, all rows are at hand
            end = min(((at_hand[r]["t"].iat[-1], at_hand[r]["idx"].iat[-1]) for r in live if first[r] + 1 < last[r]), default=None)
            parts = []
            for r in live:
                t, idx = at_hand[r]["t"].to_numpy(), at_hand[r]["idx"].to_numpy()
                near = np.ones(len(t), bool) if end is None else (t < end[0]) | ((t == end[0]) & (idx <= end[1]))
                if until is not None:
                    near &= at_hand[r]["ms"].to_numpy() < until
                n = int(near.sum())
                if n:
                    parts.append(at_hand[r].iloc[:n])
                    at_hand[r], whole[r] = at_hand[r].iloc[n:], False
                if not len(at_hand[r]):
                    self.state.removeKey((first[r],))
                    at_hand[r], first[r] = None, first[r] + 1
            if not parts:
                break
            rows = parts[0] if len(parts) == 1 else _sorted(pd.concat(parts, ignore_index=True))
            many -= len(rows)
            yield rows
        for r, rows in enumerate(at_hand):
            if rows is not None and not whole[r]:
                self._write(first[r], rows)
        kept = [r for r in range(len(first)) if first[r] < last[r]]
        if kept:
            self.index.update(([first[r] for r in kept], [last[r] for r in kept], many))
        else:
            self.index.clear()

    def least(self, column: str):
        """The least number of ``column`` that the first rows of runs have."""
        return min(self._read(block)[column].iloc[0] for block in self._runs()[0])

    def clear(self) -> None:
        self.state.clear()
        self.index.clear()


class KeyedClusterer(StatefulProcessor):
    """``StreamClusterer`` for each key. Rows with a null or non-finite number, or of another dimension
    than the key's model, leave at once with label -1, no score and no group."""

    #: What a row that is sorted has beside its point.
    more = ""

    def __init__(self, parameters: Parameters, wait_ms: int | None = None):
        self.params, self.wait_ms = parameters, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.observers = handle.getMapState("observers", "oid bigint", _OBSERVER)
        self.clock = handle.getValueState("clock", _CLOCK)
        self.waiting, self.early = Blocks(handle, "waiting"), Blocks(handle, "early", self.more)

    # --- rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest = yield from self._sorted_runs(self._finite(key, rows))
        if len(self.early):
            self.early.add(rest)
            yield from self._accept(key, self.early.take())
        else:
            yield from self._accept(key, [rest])
        if self.wait_ms is not None and len(self.waiting):
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def _finite(self, key, rows: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
        """Each frame of rows, and whether it goes on: those with odd numbers leave at once."""
        for frame in rows:
            good = _widths(frame) > 0
            if not good.all():
                yield self._odd(key, frame[~good]), False
            yield frame[good], True

    def _sorted_runs(self, frames: Iterator[tuple[pd.DataFrame, bool]]) -> Iterator[pd.DataFrame]:
        """Puts the rows that go on into sorted runs of ``HELD`` rows, hands the others out and returns, sorted, those of the last, short run."""
        held, many = [], 0
        for frame, goes_on in frames:
            if not goes_on:
                yield frame
                continue
            held.append(frame)
            many += len(frame)
            if many >= HELD:
                self.early.add(_sorted(pd.concat(held, ignore_index=True)))
                held, many = [], 0
        return _sorted(pd.concat(held, ignore_index=True)) if held else pd.DataFrame(columns=self.early.columns)

    def _accept(self, key, chunks: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Puts ordered rows into the buffer and learns the groups that are full with them."""
        size, many = max(1, self.params.input_buffer), len(self.waiting)
        state, before, learned = None, set(), False
        wide = len(next(iter(self.waiting))["features"].iloc[0]) if many else None
        if wide is None and self.clock.exists():
            state = self._load()
            before, wide = set(state.oid.tolist()), state.data.shape[1] if len(state.oid) else None
        tail: list[pd.DataFrame] = []
        for new in chunks:
            own = _widths(new)
            wide = wide or next(iter(own[own > 0].tolist()), None)
            good = (own > 0) & (own == wide)
            if not good.all():
                yield self._odd(key, new[~good])
            new = new.loc[good, _POINT]
            while many + len(new) >= size:
                if state is None:
                    state = self._load()
                    before = set(state.oid.tolist())
                full, new = new.iloc[: size - many], new.iloc[size - many :]
                state = yield from self._learn(key, state, [*tail, full])
                tail, many, learned = [], 0, True
            if len(new):
                tail.append(new)
                many += len(new)
                if sum(map(len, tail)) >= BLOCK:
                    self.waiting.add(pd.concat(tail, ignore_index=True), ordered=False)
                    tail = []
        if tail:
            self.waiting.add(pd.concat(tail, ignore_index=True), ordered=False)
        if learned:
            self._store(state, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The rest of a key that has waited long enough is a group of its own."""
        if len(self.waiting):
            state = self._load()
            before = set(state.oid.tolist())
            state = yield from self._learn(key, state, [])
            self._store(state, before)

    def _learn(self, key, s: State, last: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sample, count, rebuild and score, as the model of a whole stream does, the group of what waits
        and the ``last`` rows, block by block. Returns the state; nothing waits any more."""
        p, number, held, drawn, latest, many = self.params, s.version, len(self.waiting), None, -np.inf, 0
        parts = self._parts(held, last)
        for part in parts():
            drawn = steps.drawn(part if drawn is None else pd.concat([drawn, part], ignore_index=True), p, first=not number)
            latest, many = max(latest, float(part["t"].max())), many + len(part)
        s = steps.admit(s, p, drawn)
        now = max(latest, s.now)
        act, counted, waves = steps.active(s, p, now), 0, 0
        for part in parts():
            c, w = steps.hits(part, s, p, act, False, p.named, now)
            counted, waves = counted + c, waves + w
        s = steps.update(steps.absorb(s, p, counted, waves, now, many), p)
        s.version += 1
        act = steps.active(s, p, s.now)
        for part in parts():
            label, score = steps.score(part, s, p, act, False, p.named)
            yield self._out(key, number, part["idx"], label, score)
        if held:
            self.waiting.clear()
        return s

    def _parts(self, held: int, last: list[pd.DataFrame]) -> Callable[[], Iterable[pd.DataFrame]]:
        """Reads the ``held`` rows that wait and the ``last`` ones, a block at a time, as often as it is called; few rows are kept."""
        short = [rows.iloc[a : a + BLOCK] for rows in last for a in range(0, len(rows), BLOCK)]
        if held <= HELD:
            short = [*(self.waiting if held else ()), *short]
            return lambda: short
        return lambda: chain(self.waiting, short)

    def _odd(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return self._out(key, None, rows["idx"], np.full(len(rows), -1), np.full(len(rows), np.nan))

    def _out(self, key, number, idx, label, score) -> pd.DataFrame:
        name, missing = key
        own = pd.Series([None if missing else name] * len(idx), dtype=object)
        out = pd.DataFrame({"key": own, "grp": number, "idx": idx.to_numpy(), "label": label, "score": score})[_COLUMNS]
        return out.astype({"grp": "Int64", "label": "int32", "idx": "int64"})

    # --- state

    def _load(self) -> State:
        s = State.new(bins=self.params.freq_bins)
        if not self.clock.exists():
            return s
        s.version, s.rows, s.next_color = self.clock.get()
        rows = sorted(((oid, *row) for (oid,), row in self.observers.iterator()), key=lambda r: (r[3], r[0]))
        if not rows:
            return s
        oid, features, observations, added, touched, label, cutoff, colors, weights, colored = zip(*rows, strict=True)
        many = [len(c) for c in colors]
        s.oid, s.data = np.array(oid, np.int64), np.array([list(f) for f in features], float)
        s.observations, s.added, s.touched, s.cutoff = (np.array(v, float) for v in (observations, added, touched, cutoff))
        s.label, s.waves = np.array(label, np.int64), np.zeros((len(oid), self.params.freq_bins), complex)
        s.owner, s.color = np.repeat(s.oid, many), np.array([c for x in colors for c in x], np.int64)
        s.weight, s.colored = (np.array([v for x in part for v in x], float) for part in (weights, colored))
        return s

    def _store(self, s: State, before: set[int]) -> None:
        for oid in before - set(s.oid.tolist()):
            self.observers.removeKey((oid,))
        maps = {o: s.owner == o for o in s.oid.tolist()}
        for i, oid in enumerate(s.oid.tolist()):
            mine = maps[oid]
            self.observers.updateValue((oid,), (s.data[i].tolist(), float(s.observations[i]), float(s.added[i]), float(s.touched[i]), int(s.label[i]), float(s.cutoff[i]), s.color[mine].tolist(), s.weight[mine].tolist(), s.colored[mine].tolist()))
        self.clock.update((int(s.version), int(s.rows), int(s.next_color)))

    def close(self) -> None:
        pass


class OrderedClusterer(KeyedClusterer):
    """The same over rows in the order of event time (``ms``), whatever order they come in.

    Rows are held until the watermark has passed them, then go to the buffer ordered by (t, idx). A row
    is late when it should have gone before others of its key that went already: it gets the score of
    the model as it is, or none, and is counted. Rows without a time or with odd numbers leave at once.
    State is what came within the delay, beside the model and its buffer.
    """

    more = ", ms array<bigint>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.passed = handle.getValueState("passed", "ms bigint, late bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least: list[int] = []
        rest = yield from self._sorted_runs(self._in_time(key, rows, least))
        self.early.add(rest)
        if least:
            self._wake(max(min(least), timerValues.getCurrentWatermarkInMs()) + 1)

    def _in_time(self, key, rows: Iterable[pd.DataFrame], least: list[int]) -> Iterator[tuple[pd.DataFrame, bool]]:
        """Each frame of rows, and whether it goes on: odd rows and late ones do not. The least times of those that do are noted."""
        until, many = self._passed()
        model, before = None, many
        for frame in rows:
            timed = frame["ms"].notna().to_numpy() & (_widths(frame) > 0)
            if not timed.all():
                yield self._odd(key, frame[~timed]), False
            new = frame[timed].astype({"ms": "int64"})
            late = new["ms"].to_numpy() < until
            if late.any():
                model, many = model or self._load(), many + int(late.sum())
                yield self._behind(key, model, new[late]), False
            if not late.all():
                new = new[~late]
                least.append(int(new["ms"].min()))
                yield new, True
        if many > before:
            self.passed.update((until, many))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What lies before the watermark is learned, the rest is held further."""
        until = timerValues.getCurrentWatermarkInMs()
        self.passed.update((max(until, self._passed()[0]), self._passed()[1]))
        yield from self._accept(key, self.early.take(until))
        if len(self.early):
            self.handle.registerTimer(int(self.early.least("ms")) + 1)

    def _passed(self) -> tuple[int, int]:
        """The time before which rows of this key have gone on, and how many came after that."""
        return self.passed.get() if self.passed.exists() else (-(1 << 62), 0)

    def _wake(self, ms: int) -> None:
        """A key has one timer, the least."""
        timers = list(self.handle.listTimers())
        if not timers or ms < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)

    def _behind(self, key, s: State, rows: pd.DataFrame) -> pd.DataFrame:
        p = self.params
        label, score = np.full(len(rows), -1), np.full(len(rows), np.nan)
        good = _widths(rows) == s.data.shape[1] if len(s.oid) else np.zeros(len(rows), bool)
        if good.any():
            label[good], score[good] = steps.score(rows[good], s, p, steps.active(s, p, s.now), False, p.named)
        return super()._out(key, None, rows["idx"], label, score).assign(late=True)

    def _out(self, key, number, idx, label, score) -> pd.DataFrame:
        return super()._out(key, number, idx, label, score).assign(late=False)


def _widths(rows: pd.DataFrame) -> np.ndarray:
    """How many numbers each row has; 0 if it has none, or one that is null or not finite, or no time."""
    timed = np.isfinite(rows["t"].to_numpy(float, na_value=np.nan))
    try:
        values = np.array(rows["features"].tolist(), float)
    except (TypeError, ValueError):  # nulls, or rows of several dimensions
        own = (np.array([] if f is None else [np.nan if v is None else v for v in f], float) for f in rows["features"])
        return np.where(timed, np.array([len(v) if np.isfinite(v).all() else 0 for v in own], np.int64), 0)
    if values.ndim != 2:
        return np.zeros(len(rows), np.int64)
    return np.where(timed & np.isfinite(values).all(1), values.shape[1], 0)


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["t", "idx"], kind="stable", ignore_index=True)


def score_by_key(stream: DataFrame, key: str, wait_ms: int | None = None, **parameters) -> DataFrame:
    """(key, grp, idx, label, score) of a stream (key, idx, t, features), one model for each key; a null
    key has one too. Needs the RocksDB state store. ``parameters`` are those of ``StreamClusterer``."""
    kind = _kind(stream, key)
    processor = KeyedClusterer(Parameters(**parameters), wait_ms)
    rows = stream.select(*_named(key, kind), "idx", "t", "features")
    return rows.groupBy("key", "missing").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_SCORED.format(kind), outputMode="Append", timeMode="None" if wait_ms is None else "ProcessingTime")


def score_in_order(stream: DataFrame, key: str, delay: str, **parameters) -> DataFrame:
    """(key, grp, idx, label, score, late) of a stream (key, idx, t, features), t in seconds since 1970:
    one model for each key, which learns its rows in the order of t although they may come up to
    ``delay`` (as in "2 hours") out of it. Later ones are ``late``. What the watermark has not passed at
    the end of a query stays in its state (``early``); a row far in the future makes others late."""
    kind = _kind(stream, key)
    processor = OrderedClusterer(Parameters(**parameters))
    timed = stream.withColumn("_ts", F.timestamp_micros(F.expr("try_cast(round(t * 1e6) AS bigint)"))).withWatermark("_ts", delay)
    # the time goes on as a plain number, so that late rows reach the processor and are not dropped before
    rows = timed.select(*_named(key, kind), "idx", "t", "features", F.unix_millis("_ts").alias("ms"))
    return rows.groupBy("key", "missing").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_SCORED.format(kind) + ", late boolean", outputMode="Append", timeMode="EventTime")


def _kind(stream: DataFrame, key: str) -> str:
    kind = dict(stream.dtypes)[key]
    if kind not in ("string", "bigint", "int", "smallint", "tinyint", "boolean"):
        raise ValueError("a key is a string, an integer or a boolean")
    return kind


def _named(key: str, kind: str) -> list[Column]:
    """A null would reach a worker as NaN, which is equal to nothing: it is told by a column of its own."""
    return [F.coalesce(F.col(key), F.lit("0").cast(kind)).alias("key"), F.col(key).isNull().alias("missing")]


def _state(spark: SparkSession, checkpoint: str, variable: str, batch: int | None) -> DataFrame:
    reader = spark.read.format("statestore").option("stateVarName", variable)
    rows = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return rows.withColumn("key", F.when(~F.col("key.missing"), F.col("key.key")))


def observers(spark: SparkSession, checkpoint: str, T: float, time: float | None = None, batch: int | None = None) -> DataFrame:
    """(key, oid, features, label, observations, av_observations) of all keys' models after a batch, the
    last without one, as of ``time`` or, without it, of when each was last touched."""
    rows = _state(spark, checkpoint, "observers", batch).select("key", F.col("user_map_key.oid").alias("oid"), "user_map_value.*")
    now = F.col("touched") if time is None else F.lit(float(time))
    count = F.col("observations") * decay.weight(now, F.col("touched"), T)
    return rows.select("key", "oid", "features", "label", count.alias("observations"), (count / decay.age(now, F.col("added"), T)).alias("av_observations"))


def _blocks(spark: SparkSession, checkpoint: str, variable: str, batch: int | None, *columns: str) -> DataFrame:
    rows = _state(spark, checkpoint, variable, batch).select("key", "user_map_value.*")
    return rows.select("key", F.inline(F.arrays_zip(*columns)))


def waiting(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(key, idx, t, features): the rows of all keys that have not been learned after a batch."""
    return _blocks(spark, checkpoint, "waiting", batch, *_POINT)


def early(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(key, idx, t, features, ms): the rows of all keys that the watermark has not passed after a batch."""
    return _blocks(spark, checkpoint, "early", batch, *_POINT, "ms")


def late(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(key, ms, late): the time before which a key's rows have gone on, and how many came after that."""
    return _state(spark, checkpoint, "passed", batch).select("key", "value.*")
