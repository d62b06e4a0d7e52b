"""Models of keys hold a bounded number of rows, however many a micro-batch or a group has."""

import pickle
import tracemalloc
import uuid

import numpy as np
import pandas as pd
import pytest

from emberstream.operators.steps import Parameters
from emberstream.streaming import keyed

ROWS, STEP, GROUP = 60_000, 30_000, 22_000


class Kept:
    """A state variable of one key in files, so that what it holds is not in memory."""

    def __init__(self, place):
        self.place, self.files = place, {}

    def updateValue(self, key, value):
        self.files.setdefault(key, self.place / uuid.uuid4().hex).write_bytes(pickle.dumps(value))

    def getValue(self, key):
        return pickle.loads(self.files[key].read_bytes())

    def removeKey(self, key):
        self.files.pop(key).unlink()

    def iterator(self):
        return ((k, self.getValue(k)) for k in list(self.files))

    def exists(self):
        return bool(self.files)

    def clear(self):
        for key in list(self.files):
            self.removeKey(key)

    # of one value, and of a list
    def update(self, value):
        self.updateValue(0, value)

    def get(self):
        return self.getValue(0) if 0 in self.files else (row for part in list(self.files) for row in self.getValue(part))

    def appendList(self, rows):
        self.updateValue(f"part {len(self.files)}", rows)

    def put(self, rows):
        self.clear()
        self.appendList(rows)


class Handle:
    def __init__(self, place):
        self.place, self.timers = place, set()

    def getMapState(self, *_):
        return Kept(self.place)

    getValueState = getListState = getMapState

    def listTimers(self):
        return sorted(self.timers)

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def frames(ids):
    """Rows, a thousand at a time, by a shuffle of their ids; four share a time."""
    for a in range(0, len(ids), 1000):
        idx = ids[a : a + 1000]
        values = np.stack([np.sin(idx * 0.7), np.cos(idx * 1.3)], 1)
        t = (idx // 4).astype(float)
        yield pd.DataFrame({"idx": idx, "t": t, "features": list(values), "ms": (t * 1000).astype("int64")})


def fed(kind, place):
    """The scores of all steps of a key, the numbers of its observers, and the most memory that was used."""
    place.mkdir()
    processor, handle, out, peak = kind(Parameters(k=20, T=2e4, input_buffer=GROUP)), Handle(place), [], 0
    processor.init(handle)
    for a in range(0, ROWS, STEP):
        ids = np.random.default_rng(a).permutation(np.arange(a, a + STEP))
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        results = [processor.handleInputRows((1, False), frames(ids), Times(0))]
        if kind is keyed.OrderedClusterer:  # a timer's turn, with the latest eighth of a step not due
            results.append(processor.handleExpiredTimer((1, False), Times(int((a + STEP * 7 / 8) / 4) * 1000), None))
        for result in results:
            for rows in result:
                rows.to_pickle(place / f"out-{len(out):09}")
                out.append(place / f"out-{len(out):09}")
        peak = max(peak, tracemalloc.get_traced_memory()[1] - before)
        tracemalloc.stop()
    scores = pd.concat([pd.read_pickle(p) for p in out]).sort_values("idx", ignore_index=True)
    return scores, sorted(k for (k,), _ in processor.observers.iterator()), peak


@pytest.mark.parametrize("kind", [keyed.KeyedClusterer, keyed.OrderedClusterer])
def test_rows_beyond_a_block_are_sorted_and_learned_through_the_state(kind, tmp_path, monkeypatch):
    whole, observers, _ = fed(kind, tmp_path / "whole")
    monkeypatch.setattr(keyed, "HELD", 4000, raising=False)
    monkeypatch.setattr(keyed, "BLOCK", 500, raising=False)
    scores, same, peak = fed(kind, tmp_path / "blocks")
    assert len(scores) == 2 * GROUP and scores["idx"].tolist() == list(range(2 * GROUP))
    assert (scores["grp"] == scores["idx"] // GROUP).all() and same == observers
    pd.testing.assert_frame_equal(scores, whole)
    assert peak < 6 << 20  # 60,000 rows as objects are more than that
