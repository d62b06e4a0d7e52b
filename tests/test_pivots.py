"""Nearest observers of large models: equal to brute force, with few distances and bounded memory."""

import resource

import numpy as np
import pandas as pd
import pytest

from emberstream.operators import neighbours, steps
from emberstream.operators.steps import Parameters, Pivots, State
from emberstream.plans import queries as core
from emberstream.sources import points as sources


def brute(data, rows, x, skip, named, eps=0.0):
    d = steps.distances(rows, data, *named) + eps
    d[np.arange(len(data))[None] == skip[:, None]] = np.inf
    order = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :x]
    return np.take_along_axis(d, order, 1), order


def test_against_sql(same):
    same(core.queries()["large_model_nearest"], core.oracle_sql()["large_model_nearest"])


@pytest.mark.parametrize("named", [("euclidean",), ("manhattan",), ("chebyshev",), ("minkowski", 3.0)])
@pytest.mark.parametrize("shape", ["blobs", "grid", "copies", "wide"])
def test_equal_to_brute_force(named, shape):
    rng = np.random.default_rng(1)
    if shape == "blobs":
        data = rng.normal(0, 0.05, (600, 2)) + rng.integers(0, 5, (600, 1))
    elif shape == "grid":  # many ties
        data = rng.integers(0, 12, (600, 2)).astype(float)
    elif shape == "copies":  # one group holds a third of all
        data = np.where(rng.random((600, 1)) < 0.34, 0.5, rng.random((600, 3)))
    else:
        data = rng.normal(0, 1e3, (600, 24))
    rows = np.concatenate([data[:150], rng.normal(0, 2, (50, data.shape[1]))])
    skip = np.where(np.arange(200) < 150, np.arange(200), -1)
    eps = rng.random(600) * 0.3
    for extra in (0.0, eps):
        near, place, _ = Pivots.of(data, named).nearest(rows, 7, skip, extra)
        want, order = brute(data, rows, 7, skip, named, extra)
        assert np.allclose(near, want, atol=1e-8) and (place == order).mean() > 0.999
        if shape in ("grid", "copies"):
            assert (place == order).all()


def test_the_models_rows_are_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    data, k = rng.random((3000, 3)), 1500
    s, p = State.new(3), Parameters(k=k, x=4, perturb=0.01)
    rows = pd.DataFrame({"idx": np.arange(3000), "t": np.arange(3000.0), "features": list(data)})
    s = steps.admit(s, p, rows[:k])
    act = np.arange(k)
    got = steps.nearest(rows, s, p, act, False, p.named)
    monkeypatch.setattr(steps, "PIVOTED", 10**9)
    want = steps.nearest(rows, s, p, act, False, p.named)
    assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all()


def test_fewer_observers_than_asked_for():
    near, place, _ = Pivots.of(np.array([[0.0], [1.0]]), ("euclidean",)).nearest(np.array([[0.2]]), 3, np.array([0]))
    assert near.tolist() == [[0.8, np.inf, np.inf]] and place[0, 0] == 1


def test_most_pairs_of_a_large_model_are_pruned(spark):
    rng = np.random.default_rng(3)
    data = rng.random((6000, 2))
    pts = sources.from_arrays(spark, data, np.arange(6000.0))
    observers = pts.where("idx < 4000").selectExpr("idx AS oid", "features")
    share = neighbours.pruning(pts, observers, 5).first()
    assert share["pairs"] == 24_000_000 and share["taken"] < 0.1 * share["pairs"]
    empty = neighbours.pruning(pts.where("false"), observers, 5).first()
    assert tuple(empty) == (0, 0)


def test_memory_of_the_largest_model():
    rng = np.random.default_rng(4)
    data, rows = rng.random((20_000, 4)), rng.random((10_000, 4))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    near, _, taken = Pivots.of(data, ("euclidean",)).nearest(rows, 5, np.full(10_000, -1))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert grown < 400 and taken < 0.2 * len(data) * len(rows)  # MB; a matrix of all pairs has 1,600
    d = steps.distances(rows[:50], data, "euclidean")
    assert np.allclose(near[:50], np.sort(d, axis=1)[:, :5])
