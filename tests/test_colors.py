"""Color maps of observers over splits and merges, the bounded update, and sampling that no partition changes."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberstream.operators import sampling, steps
from emberstream.operators.model import StreamClusterer
from emberstream.operators.steps import Parameters, State
from emberstream.plans import queries as core
from emberstream.sources import points as sources

LINE = Parameters(k=50, T=10.0, idle_observers=0.0, chi_min=2, chi_prop=0.0, e=2, x=2)


@pytest.mark.parametrize("name", ["model_colors", "model_color_votes", "model_random_sampling", "reservoir_sample"])
def test_against_sql(same, name):
    same(core.queries()[name], core.oracle_sql()[name])


def line(xs, t):
    return pd.DataFrame({"idx": [int(x) for x in xs], "t": float(t), "features": [[float(x), 0.0] for x in xs]})


def later(s, t):
    return steps.absorb(s, LINE, np.zeros(len(s.oid)), np.zeros((len(s.oid), 1)), float(t), 0)


def colors(s, oid):
    mine = s.owner == oid
    return dict(zip(s.color[mine].tolist(), s.weight[mine].tolist(), strict=True))


def test_a_split_and_a_merge():
    s = steps.update(steps.admit(State.new(2), LINE, line(range(10), 0)), LINE)
    assert set(s.label) == {0} and colors(s, 3) == {0: 1.0}
    # the link between them goes: the larger part keeps the color, the smaller gets a new one
    apart = s.only(np.flatnonzero(s.oid != 3))
    for t in (1, 2):
        apart = steps.update(later(apart, t), LINE)
    left, right = apart.label[apart.oid < 3], apart.label[apart.oid > 3]
    assert set(left) == {1} and set(right) == {0} and apart.next_color == 2
    f = LINE.fade
    assert colors(apart, 0) == pytest.approx({0: f * f, 1: f + 1})
    assert colors(apart, 9) == pytest.approx({0: f * f + f + 1})
    # votes are sums of distributions: near the left part color 1 leads, though each observer knows color 0 too
    label, _ = steps.score(line([0.4], 2), apart, LINE, steps.active(apart, LINE, apart.now), False, LINE.named)
    assert label.tolist() == [1]
    # the link comes back: one cluster, with the color of the greatest summed weight
    one = steps.update(later(steps.admit(apart, LINE, line([3], 3)), 3), LINE)
    assert set(one.label) == {0}
    assert colors(one, 3) == {0: 1.0} and colors(one, 0) == pytest.approx({0: f**3 + 1, 1: (f + 1) * f})


def test_fading_is_lazy_and_evicted_maps_go():
    s = steps.update(steps.admit(State.new(2), LINE, line([*range(6), 30], 0)), LINE)
    assert colors(s, 30) == {} and s.label[s.oid == 30] == -1
    s = steps.update(later(s.only(np.flatnonzero(s.oid != 2)), 5), LINE)
    lone = s.owner[s.colored < 5]
    assert 2 not in s.owner and all(w == 1.0 for o in lone for w in colors(s, o).values())
    assert State.unpacked(s.packed()).weight.tolist() == s.weight.tolist()


def test_one_color_for_one_cluster_greatest_weight_first():
    part, color, weight = np.array([7, 7, 8, 8, 9]), np.array([0, 1, 0, 1, 5]), np.array([3.0, 2.0, 4.0, 1.0, 9.0])
    assert steps.inherit(part, {7: 0, 8: 1}, color, weight) == {8: 0, 7: 1}  # 9 is too small
    assert steps.inherit(part, {7: 0, 8: 1}, color * 0, weight) == {7: 0}  # 5 each: the larger cluster
    assert steps.inherit(part, {7: 1, 8: 0}, color * 0, weight) == {8: 0}


def test_votes_break_ties_by_the_least_color():
    s = steps.admit(State.new(1), LINE, pd.DataFrame({"idx": [1, 2, 3], "t": 0.0, "features": [[0.0], [1.0], [9.0]]}))
    s.owner, s.color, s.weight, s.colored = np.array([1, 1, 2]), np.array([4, 2, 4]), np.array([1.0, 3.0, 0.1]), np.zeros(3)
    assert steps.vote(s, np.array([[0, 1], [0, 2], [2, 2], [1, 2]])).tolist() == [4, 2, -1, 4]


def test_the_update_holds_tiles_and_not_a_matrix(monkeypatch):
    monkeypatch.setattr(steps, "TILE", 1 << 18)
    rng = np.random.default_rng(0)
    p = Parameters(k=4000, T=4000.0, idle_observers=0.0, chi_min=5, chi_prop=0.0)
    s = steps.admit(State.new(4), p, pd.DataFrame({"idx": range(4000), "t": 0.0, "features": list(rng.normal(size=(4000, 4)))}))
    tracemalloc.start()
    tiled = steps.update(s, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # one matrix of all pairs would take 122 MB
    monkeypatch.setattr(steps, "TILE", 1 << 26)
    whole = steps.update(s, p)
    assert (tiled.label == whole.label).all() and np.allclose(tiled.cutoff, whole.cutoff)


def many(spark, n=4000):
    rng = np.random.default_rng(2)
    return sources.from_arrays(spark, rng.normal(size=(n, 2)), np.arange(n) / 10)


def test_the_reservoir_does_not_depend_on_partitions_and_merges(spark):
    pts = many(spark)
    draw = lambda df, seed=3: [(r["idx"], r["priority"]) for r in sampling.reservoir(df, 100, 50.0, seed).orderBy("priority").collect()]
    want = draw(pts)
    assert draw(pts.repartition(7)) == draw(pts.repartition(3, "t")) == want and draw(pts, 4) != want
    parts = [sampling.reservoir(pts.where(F.col("idx") % 3 == r), 100, 50.0, 3) for r in range(3)]
    both = sampling.merged(sampling.merged(parts[2], parts[0], 100), parts[1], 100)
    assert sorted(r["idx"] for r in both.collect()) == sorted(i for i, _ in want)
    # weights are exp(t / horizon): of 400 units of time nearly all that is drawn is from the last 150
    assert np.mean([i / 10 > 250 for i, _ in want]) > 0.9
    even = [r["idx"] for r in sampling.reservoir(pts, 100, 1e12, 3).collect()]
    assert 0.35 < np.mean([i > 2000 for i in even]) < 0.65


def test_random_models_are_equal_whatever_the_partitions(spark):
    one, two = (StreamClusterer(spark, k=60, T=600.0, chi_min=5, random_sampling=True, seed=9) for _ in range(2))
    for a in range(0, 4000, 1000):
        part = many(spark).where(F.col("idx").between(a, a + 999))
        one.fit(part)
        two.fit(part.repartition(6))
    assert one.state.oid.tolist() == two.state.oid.tolist() and np.allclose(one.state.weight, two.state.weight)
    assert 0.15 < sampling.sampled(many(spark), 0.2, 4, random=True).count() / 4000 < 0.25


def test_arrays_draw_what_columns_draw(spark):
    pts = many(spark, 500)
    rows = pts.toPandas()
    for p in (Parameters(k=30, T=100.0, seed=3), Parameters(k=30, T=100.0, seed=3, random_sampling=True)):
        for first in (True, False):
            model = StreamClusterer(spark, k=30, T=100.0, seed=3, random_sampling=p.random_sampling)
            if not first:
                model.state = State.new(2)
            model._sample(pts)
            assert sorted(model.state.oid.tolist()) == sorted(steps.drawn(rows, p, first)["idx"].tolist())


def test_rows_that_wait_are_saved_with_the_model(spark, tmp_path):
    pts = many(spark, 900)
    blocks = [pts.where(F.col("idx").between(a, a + 299)) for a in (0, 300, 600)]
    options = {"k": 60, "T": 600.0, "chi_min": 5, "input_buffer": 500}
    plain, saved = StreamClusterer(spark, **options), StreamClusterer(spark, **options)
    for b in blocks:
        plain.fit(b)
    saved.fit(blocks[0]).fit(blocks[1])
    saved.save(str(tmp_path / "m"))
    again = StreamClusterer(spark, **options).load(str(tmp_path / "m"))
    assert again._waiting_rows == 300 and again.state.version == 1
    again.fit(blocks[2])
    assert again.state.version == plain.state.version == 2 and again.state.rows == plain.state.rows == 900
    assert np.allclose(again.state.observations, plain.state.observations)
