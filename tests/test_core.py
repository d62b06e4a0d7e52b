import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstream.functions import codec, decay, distance, metrics
from emberstream.operators import graph, neighbours, sampling, scoring
from emberstream.operators.model import Parameters, StreamClusterer, TemporalStreamClusterer, distances
from emberstream.plans import queries as core
from emberstream.sources import points as sources
from emberstream.streaming import runner

QUICK = ["dist_euclidean", "dist_manhattan", "dist_chebyshev", "dist_minkowski3", "knn_top5", "av_observations", "active_observers", "outlier_score_relative", "zeta_edges", "roc_auc", "temporal_fourier_sums", "codec_round_trip", "fit_predict_flagship", "ari", "color_distribution", "event_points", "block_ids", "csv_points", "model_fit_predict", "model_temporal_fit_predict", "model_predict_only", "model_get_observers", "streaming_fit_predict", "csv_fit_predict"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(same, name):
    same(core.queries()[name], core.oracle_sql()[name])


def vectors(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>")


@pytest.mark.parametrize("name,p,want", [("euclidean", None, 5.0), ("manhattan", None, 7.0), ("chebyshev", None, 4.0), ("minkowski", 3, (27 + 64) ** (1 / 3))])
def test_distances(spark, name, p, want):
    df = vectors(spark, [0.0, 0.0], [3.0, 4.0])
    got = df.select(distance.metric(name, p)(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(want)
    assert distances(np.zeros((1, 2)), np.array([[3.0, 4.0]]), name, p or 2)[0, 0] == pytest.approx(want)


def test_metric_errors_and_own_metric(spark):
    with pytest.raises(ValueError):
        distance.minkowski(0.5)
    with pytest.raises(ValueError):
        distance.metric("none")
    own = distance.vectorised(lambda a, b: np.abs(a - b).max(1))
    assert vectors(spark, [1.0], [3.0]).select(own(F.col("a"), F.col("b"))).first()[0] == 2.0


def test_fading_composes_and_age_of_a_new_observer_is_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 5.0)], "now double, t double")
    rows = df.select(decay.weight(F.col("now"), F.col("t"), 10.0), decay.age(F.col("now"), F.col("t"), 10.0)).collect()
    assert rows[0][0] == pytest.approx(math.exp(-0.5)) and rows[1] == (1.0, None)
    f = decay.fading(10.0)
    assert f**2 * f**3 == pytest.approx(f**5)
    with pytest.raises(ValueError):
        decay.fading(0)


def test_codec(spark):
    values = [0, 1, -1, 127, -128, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame([(v,) for v in values], "n bigint").withColumn("b", codec.encode_int(F.col("n"), 4))
    for r in df.select("n", "b", codec.decode_int(F.col("b"), 4).alias("back")).collect():
        assert bytes(r["b"]) == r["n"].to_bytes(4, "big", signed=True) and r["back"] == r["n"]


def test_float_codec_is_the_machines_eight_bytes(spark):
    import struct

    values = [0.0, -0.0, 1.5, -1e300, 5e-324, float("inf"), 0.1, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("b", codec.encode_double(F.col("x")))
    rows = df.select("x", "b", codec.decode_double(F.col("b")).alias("back")).collect()
    for r in rows:
        assert (r["b"] is None and r["back"] is None) if r["x"] is None else (bytes(r["b"]) == struct.pack("=d", r["x"]) and r["back"] == r["x"])


def test_rows_are_numbered_and_large_indices_are_sampled(spark, tmp_path):
    df = spark.createDataFrame([(float(i // 2), 1.0, 2.0, 0) for i in range(101)], "timestamp double, f0 double, f1 double, label int")
    df.repartition(5).write.option("header", True).csv(str(tmp_path / "d"))
    pts = sources.read_csv(spark, str(tmp_path / "d"))
    rows = pts.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(101)) and [r["t"] for r in rows] == [float(i // 2) for i in range(101)]
    far = pts.withColumn("idx", F.lit((1 << 62) + 5) - F.col("idx"))
    assert StreamClusterer(spark, k=20, T=50.0, perturb=1e-6).fit_predict(far).count() == 101
    assert sampling.sampled(far, 1.0).count() == 101


def test_one_outlier_does_not_fill_a_slot(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("y"), F.when(F.col("id") == 7, 1e12).otherwise(F.col("id").cast("double")).alias("s"))
    assert metrics.roc_auc(df, F.col("y") == 1, "s").first()[0] == pytest.approx(0.5001, abs=2e-4)


def test_state_outlives_the_model_and_a_replayed_batch_counts_once(spark, tmp_path):
    first, _, _ = blobs(spark)
    second, _, _ = blobs(spark, first=1000)
    bad = spark.createDataFrame([(5000, 3.0, None), (5001, 4.0, [1.0, float("nan")]), (5002, 5.0, [1.0])], first.schema)
    options = {"k": 60, "T": 1000, "chi_min": 12, "e": 3}
    plain = StreamClusterer(spark, **options)
    plain.fit(first)
    plain.save(str(tmp_path / "state"))
    again = StreamClusterer(spark, **options).load(str(tmp_path / "state"))
    assert plain.fit_predict(second).orderBy("idx").collect() == again.fit_predict(second).orderBy("idx").collect()
    assert again.state.version == 2

    def scores(place, restart):
        model = StreamClusterer(spark, **options)
        for name, part in (("a", first), ("b", second.unionByName(bad))):
            part.coalesce(1).write.parquet(f"{place}/in/{name}")
            stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in")
            runner.run(stream, model, f"{place}/out", f"{place}/cp").awaitTermination()
            if restart:  # a new process, whose last batch was learned but not committed
                model = StreamClusterer(spark, **options)
                commit = f"{place}/cp/commits/{0 if name == 'a' else 1}"
                for f in (commit, f"{place}/cp/commits/.{commit[-1]}.crc"):
                    if os.path.exists(f):
                        os.remove(f)
                runner.run(stream, model, f"{place}/out", f"{place}/cp").awaitTermination()
                assert model.state.version == (1 if name == "a" else 2)
        return sorted(tuple(r) for r in spark.read.parquet(f"{place}/out").select("idx", "label", F.coalesce("score", F.lit(-1.0))).collect())

    want = scores(str(tmp_path / "x"), False)
    assert scores(str(tmp_path / "y"), True) == want
    assert [r for r in want if r[0] >= 5000] == [(5000, -1, -1.0), (5001, -1, -1.0), (5002, -1, -1.0)]


def test_sources_and_checks(spark, tmp_path):
    (tmp_path / "d.csv").write_text("timestamp,f0,f1,label\n1,0.5,2,0\n2,,3,-1\n")
    pts = sources.read_csv(spark, str(tmp_path / "d.csv"))
    assert pts.count() == 2 and sources.valid(pts, 2).count() == 1
    with pytest.raises(ValueError):
        sources.from_arrays(spark, np.zeros((2, 2)), np.zeros(3))
    with pytest.raises(Exception, match="another dimension"):
        sources.checked(sources.from_arrays(spark, np.zeros((2, 2)), np.zeros(2)), 3).collect()
    short = sources.blocks(sources.from_arrays(spark, np.zeros((7, 1)), np.arange(7)), 3)
    assert sorted(r["count"] for r in short.groupBy("block").count().collect()) == [1, 3, 3]


def test_ties_are_ordered_by_id_and_own_observer_is_left_out(spark):
    grid = sources.from_arrays(spark, np.array([[x, y] for x in range(3) for y in range(3)], float), np.arange(9))
    near = neighbours.nearest(grid, sampling.first_observers(grid, 9), 2).where("idx = 4").orderBy("rk").collect()
    assert [r["oid"] for r in near] == [1, 3]


def test_components_and_min_size(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "oid bigint")
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "src bigint, dst bigint")
    parts = graph.components(nodes, edges)
    assert {r["oid"]: r["component"] for r in parts.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    assert {r["oid"]: r["label"] for r in graph.clusters(parts, 3).collect()} == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1, 6: -1}


def test_measures(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.4), (1, 1, 0.35), (1, 1, 0.8)], "y int, p int, s double")
    assert metrics.adjusted_rand_index(df, "y", "p").first()[0] == pytest.approx(1.0)
    assert metrics.roc_auc(df, F.col("y") == 1, "s").first()[0] == pytest.approx(0.75)
    assert metrics.three_sigma(df, "s").first()[0] == pytest.approx(np.mean([0.1, 0.4, 0.35, 0.8]) + 3 * np.std([0.1, 0.4, 0.35, 0.8]))


def test_votes_take_the_least_label_among_equals(spark):
    near = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "idx bigint, oid bigint")
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, -1)], "oid bigint, label int")
    assert {r["idx"]: r["label"] for r in scoring.votes(near, labels).collect()} == {1: 0, 2: -1}


def blobs(spark, n=120, shift=0.0, first=0):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(0 + shift, 0.1, (n // 2, 2)), rng.normal(5 + shift, 0.1, (n // 2, 2)), [[50.0, 50.0]]])
    order = rng.permutation(len(data))
    return sources.from_arrays(spark, data[order], np.arange(first, first + len(data), dtype=float), first), (order >= n // 2).astype(int), int(np.flatnonzero(order == n)[0]) + first


def test_model_finds_two_clusters_and_the_outlier(spark):
    pts, truth, odd = blobs(spark)
    model = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3)
    rows = {r["idx"]: r for r in model.fit_predict(pts).collect()}
    assert len(rows) == 121 and model.observer_count() == 60
    assert max(rows.values(), key=lambda r: r["score"])["idx"] == odd
    labels = [[rows[i]["label"] for i in range(121) if truth[i] == c and i != odd] for c in (0, 1)]
    assert len({*labels[0]}) == len({*labels[1]}) == 1 and labels[0][0] != labels[1][0]
    seen = model.get_observers(121.0)
    assert seen.count() == 60 and seen.where("observations < 0").isEmpty()
    assert model.get_clusters().count() >= 2


def test_colors_live_on_and_partitions_do_not_matter(spark):
    pts, _, _ = blobs(spark)
    later, truth, odd = blobs(spark, shift=0.05, first=1000)
    one = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3).fit(pts)
    two = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3).fit(pts.repartition(7))
    assert np.allclose(one.state.observations, two.state.observations)
    before = {r["idx"]: r["label"] for r in one.predict(later).collect()}
    after = {r["idx"]: r["label"] for r in one.fit_predict(later).collect()}
    assert [before[1000 + i] for i in range(121) if 1000 + i != odd] == [after[1000 + i] for i in range(121) if 1000 + i != odd]


def test_options(spark):
    pts, _, odd = blobs(spark)
    model = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3, outlier_handling=True, outlier_threshold=10.0, rel_outlier_score=False, perturb=1e-6, distance="manhattan")
    rows = {r["idx"]: r["label"] for r in model.fit_predict(pts).collect()}
    assert rows[odd] == -1
    waves = TemporalStreamClusterer(spark, k=40, T=1000, freq_bins=4, max_freq=0.5).fit(pts)
    assert waves.predict(pts).count() == 121 and np.abs(waves.state.waves).sum() > 0
    with pytest.raises(ValueError):
        Parameters(k=0)
    assert StreamClusterer(spark).predict(pts.limit(0)).count() == 0


def test_own_metric_and_input_buffer(spark):
    pts, _, odd = blobs(spark)
    own = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3, distance=lambda a, b: np.abs(a[:, None] - b[None]).sum(2), input_buffer=200)
    named = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3, distance="manhattan")
    assert [tuple(r)[:2] for r in own.fit_predict(pts).orderBy("idx").collect()] == [tuple(r)[:2] for r in named.fit_predict(pts).orderBy("idx").collect()]
    later, _, _ = blobs(spark, first=1000)
    assert own.fit_predict(later).count() == 121 and own.state.version == 1  # 121 of 200 rows wait
    last, _, _ = blobs(spark, first=2000)
    assert own.fit_predict(last).count() == 121 and own.state.version == 2 and own.state.rows == 363
    with pytest.raises(ValueError):
        Parameters(distance="none")


def test_streaming_equals_batches(spark, tmp_path):
    first, _, _ = blobs(spark)
    second, _, _ = blobs(spark, first=1000)
    first.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    model = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3)
    runner.run(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    second.coalesce(1).write.parquet(str(tmp_path / "in/b"))
    runner.run(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = StreamClusterer(spark, k=60, T=1000, chi_min=12, e=3)
    want = [tuple(r) for part in (first, second) for r in batch.fit_predict(part).orderBy("idx").collect()]
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("idx", "label", "score").orderBy("idx").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want]
