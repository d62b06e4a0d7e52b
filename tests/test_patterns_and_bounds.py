"""Temporal patterns read back from Fourier sums, and what happens beyond a model's capacity."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstream.operators import graph, neighbours, scoring, steps
from emberstream.operators.model import TemporalStreamClusterer
from emberstream.plans import queries as core
from emberstream.sources import points as sources


@pytest.mark.parametrize("name", ["temporal_patterns", "temporal_peaks", "model_temporal_predict"])
def test_against_sql(same, name):
    same(core.queries()[name], core.oracle_sql()[name])


def test_a_periodic_observer_shows_its_phase(spark):
    bins, top = 6, 1.0
    period = 2 * math.pi / (top / (bins - 1))
    hits = [(1, 7.5 + n * period) for n in range(12)] + [(2, n * period / 40) for n in range(480)] + [(3, 20.0 + n * period) for n in range(12)]
    near = spark.createDataFrame(hits, "oid bigint, t double")
    now = near.agg(F.max("t").alias("now"))
    pattern = scoring.patterns(scoring.fourier_sums(near, now, 1e9, bins, top), bins, top, 48)
    best = {r["oid"]: r for r in scoring.peaks(pattern).collect()}
    assert abs(best[1]["phase"] - 7.5) <= period / 48 and abs(best[3]["phase"] - 20.0) <= period / 48
    assert best[1]["density"] > 5 and best[2]["density"] == pytest.approx(1.0, abs=0.01)
    mean = pattern.groupBy("oid").agg(F.avg("density").alias("d")).collect()
    assert all(r["d"] == pytest.approx(1.0) for r in mean)
    with pytest.raises(ValueError):
        scoring.patterns(near, 1, 1.0, 8)


def test_a_model_shows_its_patterns(spark):
    period = 2 * math.pi / (1.0 / 3)
    rng = np.random.default_rng(3)
    where, t = np.repeat([[0.0, 0.0], [5.0, 5.0]], 60, 0) + rng.normal(0, 0.05, (120, 2)), np.concatenate([2 + period * np.arange(60), 11 + period * np.arange(60)])
    pts = sources.from_arrays(spark, where, t)
    model = TemporalStreamClusterer(spark, k=120, T=1e6, chi_min=3, freq_bins=4, max_freq=1.0).fit(pts)
    best = {r["oid"]: r["phase"] for r in scoring.peaks(model.get_patterns(36)).collect()}
    for oid, x in zip(model.state.oid.tolist(), model.state.data[:, 0], strict=True):
        if np.abs(model.state.waves[model.state.oid == oid]).sum():
            assert abs(best[oid] - (2 if x < 2 else 11)) <= period / 18


def test_components_hold_few_edges_and_no_more_nodes_than_a_model(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 3000), rng.integers(0, 500, 3000)
    keep = a // 50 == b // 50  # ten groups
    edges = pd.DataFrame({"kind": graph._EDGE, "a": a[keep], "b": b[keep]})
    nodes = pd.DataFrame({"kind": graph._HERE, "a": np.arange(510), "b": 0})
    (whole,) = graph._solve(iter([nodes, edges]))
    monkeypatch.setattr(graph, "HELD", 10)
    (parts,) = graph._solve(iter([edges[:100], nodes[:300], edges[100:200], edges[200:], nodes[300:]]))
    assert whole.equals(parts) and (whole["component"][500:] == whole["oid"][500:]).all()
    assert (graph._solve(iter([])).__next__()).empty
    monkeypatch.setattr(graph, "MOST_OBSERVERS", 100)
    with pytest.raises(ValueError, match="at most 100"):
        next(graph._solve(iter([nodes])))


def test_more_observers_than_a_model_has_are_refused(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_OBSERVERS", 5)
    pts = sources.from_arrays(spark, np.arange(20.0).reshape(10, 2), np.arange(10.0))
    few, many = (pts.limit(n).select(F.col("idx").alias("oid"), F.col("t").alias("time_added"), "features") for n in (5, 6))
    assert neighbours.nearest(pts, few, 2, eps=None, metric=lambda a, b: F.abs(a[0] - b[0])).count() == 20
    assert neighbours.pair_distances(few).count() == 20
    for fails in (lambda: neighbours.nearest(pts, many, 2, metric=lambda a, b: F.abs(a[0] - b[0])).count(), lambda: neighbours.pair_distances(many).count()):
        with pytest.raises(Exception, match="at most 5 observers"):
            fails()


def test_tiles_change_nothing(spark, monkeypatch):
    pts = sources.from_arrays(spark, np.random.default_rng(6).normal(size=(300, 3)), np.arange(300.0)).toPandas()
    p = steps.Parameters(k=50, T=100.0)
    s = steps.admit(steps.State.new(3), p, pts[:50])
    act = steps.active(s, p, 299.0)
    want = steps.nearest(pts, s, p, act, False, p.named)
    monkeypatch.setattr(steps, "TILE", 100)
    got = steps.nearest(pts, s, p, act, False, p.named)
    assert all((g == w).all() for g, w in zip(got, want, strict=True))
