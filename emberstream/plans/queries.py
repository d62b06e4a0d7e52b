"""Queries of the engine over whole tables, and the SQL that DuckDB runs beside them.

Most queries share one model: the points of ``embeddings``, their first K observers by rank, and
the X nearest observers of each point. Results are rounded, ties are ordered by id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, decay, distance, evaluation, metrics
from ..operators import graph, neighbours, sampling, scoring
from ..operators.model import StreamClusterer, TemporalStreamClusterer
from ..sources import points as sources
from ..streaming import keyed, runner
from .model_sql import model_sql
from .scratch import materialize, scratch_root

K, X, CHI, ZETA, MIN_SIZE, HORIZON, IDLE, BLOCK, BUFFER = 100, 5, 3, 0.6, 2, 400.0, 0.3, 64, 10
BINS, MAX_FREQ, PHASES = 4, 0.1, 24


class _Plan:
    """The shared steps, each a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.points = sources.valid(sources.from_embeddings(spark, sf_dir))
        self.observers, self._near = sampling.first_observers(self.points, K), None
        self.now = self.points.agg(F.max("t").alias("now"))

    def near(self, observers: DataFrame | None = None) -> DataFrame:
        """Written once: counts, scores and votes read the same neighbours."""
        if observers is not None:
            return materialize(neighbours.nearest(self.points, observers, X), "near")
        if self._near is None:
            self._near = materialize(neighbours.nearest(self.points, self.observers, X), "near")
        return self._near

    def faded(self) -> DataFrame:
        return scoring.faded_observations(self.near(), self.now, HORIZON)

    def averaged(self) -> DataFrame:
        return scoring.averaged(self.observers, self.faded(), self.now, HORIZON)

    def pairs(self) -> DataFrame:
        return neighbours.pair_distances(self.observers)

    def edges(self) -> DataFrame:
        pairs = self.pairs()
        return neighbours.edges(pairs, neighbours.cutoffs(pairs, CHI), ZETA)

    def components(self) -> DataFrame:
        return graph.components(self.observers, self.edges())

    def labels(self) -> DataFrame:
        return graph.clusters(self.components(), MIN_SIZE)

    def votes(self) -> DataFrame:
        return scoring.votes(self.near(), self.labels())

    def scored(self) -> DataFrame:
        near = self.near()
        return scoring.outlier_scores(near).join(scoring.votes(near, self.labels()), "idx")


def _distance(which, p=None):
    def query(spark, sf_dir):
        plan = _Plan(spark, sf_dir)
        f = distance.metric(which, p)
        model = F.broadcast(plan.observers.select("oid", F.col("features").alias("other")))
        return plan.points.crossJoin(model).select("idx", "oid", F.round(f(F.col("features"), F.col("other")), 6).alias("d"))

    return query


def observer_sample(spark, sf_dir):
    return _Plan(spark, sf_dir).observers.select("oid", "time_added", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def sampled_rows(spark, sf_dir):
    return sampling.sampled(_Plan(spark, sf_dir).points, 0.25).select("idx", "t")


def sampled_membership(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    chosen = plan.observers.select(F.col("oid").alias("idx")).distinct()
    return plan.points.join(F.broadcast(chosen), "idx", "left_semi").select("idx", "t")


def unsampled_rows(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    return plan.points.join(F.broadcast(plan.observers.select(F.col("oid").alias("idx"))), "idx", "left_anti").select("idx", "t")


def knn_top5(spark, sf_dir):
    return _Plan(spark, sf_dir).near().select("idx", "oid", "rk", F.round("d", 6).alias("d"))


def observation_counts(spark, sf_dir):
    return scoring.observations(_Plan(spark, sf_dir).near())


def faded_observations(spark, sf_dir):
    return _Plan(spark, sf_dir).faded().select("oid", F.round("observations", 6).alias("observations"), "touched")


def av_observations(spark, sf_dir):
    return _Plan(spark, sf_dir).averaged().select("oid", F.round("observations", 6).alias("observations"), F.round("av_observations", 6).alias("av_observations"))


def active_observers(spark, sf_dir):
    return scoring.active(_Plan(spark, sf_dir).averaged(), IDLE)


def replaced_observers(spark, sf_dir):
    return sampling.replaceable(_Plan(spark, sf_dir).averaged().withColumn("av_observations", F.round("av_observations", 9)), 10).select("oid")


def outlier_score_median(spark, sf_dir):
    return scoring.outlier_scores(_Plan(spark, sf_dir).near()).select("idx", F.round("score", 6).alias("score"))


def outlier_score_relative(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    return scoring.relative_scores(plan.near(), neighbours.cutoffs(plan.pairs(), CHI)).select("idx", F.round("score", 6).alias("score"))


def chi_cutoff(spark, sf_dir):
    return neighbours.cutoffs(_Plan(spark, sf_dir).pairs(), CHI).select("oid", F.round("h", 6).alias("h"))


def zeta_edges(spark, sf_dir):
    return _Plan(spark, sf_dir).edges().select("src", "dst", F.round("d", 6).alias("d"))


def components(spark, sf_dir):
    return _Plan(spark, sf_dir).components()


def min_cluster_size(spark, sf_dir):
    return _Plan(spark, sf_dir).labels()


def vote_label(spark, sf_dir):
    return _Plan(spark, sf_dir).votes()


def color_observations(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    return scoring.color_observations(plan.near(), plan.votes(), plan.now, HORIZON).select("oid", "color", F.round("weight", 6).alias("weight"))


def color_distribution(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    shares = scoring.color_distribution(scoring.color_observations(plan.near(), plan.votes(), plan.now, HORIZON))
    return shares.select("oid", "color", F.round("share", 6).alias("share"))


def cluster_listing(spark, sf_dir):
    labels = _Plan(spark, sf_dir).labels()
    return labels.groupBy("label").agg(F.count("*").alias("observers"), F.min("oid").alias("first"), F.max("oid").alias("last"))


def handled_labels(spark, sf_dir):
    rows = scoring.handle_outliers(_Plan(spark, sf_dir).scored(), 1.3, True)
    return rows.select("idx", "label", F.round("score", 6).alias("score"))


def outlier_overwrite_3sigma(spark, sf_dir):
    rows = metrics.overwrite_outliers(_Plan(spark, sf_dir).scored())
    return rows.select("idx", "label", F.round("score", 6).alias("score"))


def label_dense_code(spark, sf_dir):
    return metrics.dense_code(_Plan(spark, sf_dir).votes()).select("idx", "label", "code")


def distinct_labels(spark, sf_dir):
    return _Plan(spark, sf_dir).votes().select("label").distinct()


def inlier_counts(spark, sf_dir):
    votes = _Plan(spark, sf_dir).votes()
    return votes.agg(F.count_if(F.col("label") > -1).alias("inliers"), F.count_if(F.col("label") == -1).alias("outliers"))


def ari(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    both = plan.points.select("idx", F.col("label").alias("truth")).join(plan.votes(), "idx")
    return metrics.adjusted_rand_index(both, "truth", "label").select(F.round("ari", 9).alias("ari"))


def roc_auc(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    both = plan.points.select("idx", "label").join(scoring.outlier_scores(plan.near()), "idx")
    return metrics.roc_auc(both, F.col("label") == 0).select(F.round("auc", 9).alias("auc"))


def block_ids(spark, sf_dir):
    rows = sources.blocks(sources.from_events(spark, sf_dir), BLOCK)
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def buffer_batches(spark, sf_dir):
    rows = runner.buffered(_Plan(spark, sf_dir).points, BUFFER)
    return rows.groupBy("buffer").agg(F.count("*").alias("n"), F.max("t").alias("t"))


def block_union(spark, sf_dir):
    pts = _Plan(spark, sf_dir).points
    low, high = pts.where(F.col("idx") % 2 == 0), pts.where(F.col("idx") % 2 == 1)
    return low.select("idx", "t").unionByName(high.select("idx", "t"))


def event_points(spark, sf_dir):
    rows = sources.from_events(spark, sf_dir)
    return rows.select("idx", F.round("t", 3).alias("t"), F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[1], 6).alias("f1"))


def lineitem_points(spark, sf_dir):
    rows = sources.valid(sources.from_lineitem(spark, sf_dir), 4)
    return rows.select("idx", "t", *[F.round(F.col("features")[i], 8).alias(f"f{i}") for i in range(4)])


def perturbed_ties(spark, sf_dir):
    return _Plan(spark, sf_dir).points.select("idx", F.round(distance.perturbation(F.col("idx"), 1e-3, 5), 12).alias("eps"))


def codec_round_trip(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") * -3 + 1000).alias("n"), "value")
    rows = rows.withColumn("b", codec.encode_int(F.col("n"), 4))
    return rows.select("event_id", F.lower(F.hex("b")).alias("bytes"), codec.decode_int(F.col("b"), 4).alias("n"), codec.decode_double(codec.encode_double(F.col("value"))).alias("value"))


def fading_factors(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    return plan.points.crossJoin(F.broadcast(plan.now)).select("idx", F.round(decay.weight(F.col("now"), F.col("t"), HORIZON), 9).alias("weight"), F.round(decay.age(F.col("now"), F.col("t"), HORIZON), 9).alias("age"))


def temporal_fourier_sums(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    sums = scoring.fourier_sums(plan.near(), plan.now, HORIZON, BINS, MAX_FREQ)
    return sums.select("oid", "bin", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def temporal_patterns(spark, sf_dir):
    """When in a period each observer is hit, from its Fourier sums."""
    plan = _Plan(spark, sf_dir)
    rows = scoring.patterns(scoring.fourier_sums(plan.near(), plan.now, HORIZON, BINS, MAX_FREQ), BINS, MAX_FREQ, PHASES)
    return rows.select("oid", "step", F.round("phase", 6).alias("phase"), F.round("density", 6).alias("density"))


def temporal_peaks(spark, sf_dir):
    """The time of each observer's highest density."""
    plan = _Plan(spark, sf_dir)
    rows = scoring.peaks(scoring.patterns(scoring.fourier_sums(plan.near(), plan.now, HORIZON, BINS, MAX_FREQ), BINS, MAX_FREQ, PHASES))
    return rows.select("oid", F.round("phase", 6).alias("phase"), F.round("density", 6).alias("density"))


def model_temporal_predict(spark, sf_dir):
    """A temporal model of one half of the points scores all of them, unchanged: fit, then predict at other phases."""
    pts = sources.valid(sources.from_embeddings(spark, sf_dir))
    model = TemporalStreamClusterer(spark, k=K, T=HORIZON, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE, idle_observers=IDLE, freq_bins=BINS, max_freq=MAX_FREQ)
    return model.fit(pts.where("idx % 2 = 0")).predict(pts).select("idx", "label", F.round("score", 6).alias("score"))


def fit_predict_flagship(spark, sf_dir):
    """Observers, faded counts, the idle cut, nearest active observers, score, label, 3 sigma."""
    plan = _Plan(spark, sf_dir)
    awake = plan.observers.join(F.broadcast(scoring.active(plan.averaged(), IDLE)), "oid", "left_semi")
    near = plan.near(awake)
    rows = scoring.outlier_scores(near).join(scoring.votes(near, plan.labels()), "idx")
    return metrics.overwrite_outliers(rows).select("idx", "label", F.round("score", 6).alias("score"))


def get_observers(spark, sf_dir):
    plan = _Plan(spark, sf_dir)
    rows = plan.averaged().join(plan.labels(), "oid")
    return rows.select("oid", "label", F.round("observations", 6).alias("observations"), F.round("av_observations", 6).alias("av_observations"))


def observer_count(spark, sf_dir):
    return _Plan(spark, sf_dir).observers.agg(F.count("*").alias("n"))


def _model(cls):
    def query(spark, sf_dir):
        pts = sources.valid(sources.from_embeddings(spark, sf_dir))
        model = cls(spark, k=K, T=HORIZON, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE, idle_observers=IDLE, freq_bins=BINS, max_freq=MAX_FREQ)
        return model.fit_predict(pts).select("idx", "label", F.round("score", 6).alias("score"))

    return query


def predict_only(spark, sf_dir):
    """A model of one half of the points scores all of them, unchanged."""
    pts = sources.valid(sources.from_lineitem(spark, sf_dir), 4)
    model = StreamClusterer(spark, k=K, T=HORIZON, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE).fit(pts.where("idx % 2 = 0"))
    # prices are multiples of 1e-7, so that a sixth digit would be rounded at halves
    return model.predict(pts).select("idx", "label", F.round("score", 7).alias("score"))


def model_observers(spark, sf_dir):
    """The read-out of a model that was fitted on events."""
    pts = sources.valid(sources.from_events(spark, sf_dir))
    model = StreamClusterer(spark, k=K, T=86400.0, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE).fit(pts)
    return model.get_observers(model._now).select("oid", "label", F.round("observations", 6).alias("observations"))


def streaming_fit_predict(spark, sf_dir):
    """Embeddings as a stream of files through one model; all scores of all micro-batches."""
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a pattern may name a file or a folder
    pts = sources.valid(sources.from_columns(stream, F.col("vec_id"), F.col("vec_id"), F.col("embedding")))
    place = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    model = StreamClusterer(spark, k=K, T=HORIZON, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE)
    runner.run(pts, model, f"{place}/scores", f"{place}/checkpoint").awaitTermination()
    return spark.read.schema("idx bigint, label int, score double, batch int").parquet(f"{place}/scores").select("idx", "label", F.round("score", 6).alias("score"))


def _events_csv(spark, sf_dir):
    """The events as a file of the demonstration's form: (timestamp, f0, f1, label) with a header."""
    rows = sources.from_events(spark, sf_dir)
    place = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    kind = F.pmod(F.col("idx"), F.lit(3)).cast("int") - 1
    rows.select(F.col("t").alias("timestamp"), F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[1], 6).alias("f1"), kind.alias("label")).write.option("header", True).csv(place)
    return sources.read_csv(spark, place)


def csv_points(spark, sf_dir):
    """Points of a CSV, numbered in the order of time."""
    return _events_csv(spark, sf_dir).select("idx", F.round("t", 3).alias("t"), F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), "label")


def csv_fit_predict(spark, sf_dir):
    """The demonstration: read a CSV, then fit and predict it block by block, oldest first."""
    pts = materialize(sources.valid(_events_csv(spark, sf_dir), 2), "csv_points")
    size = -(-pts.count() // 4)
    model, out = StreamClusterer(spark, k=K, T=86400.0, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE), None
    for block in range(4):
        scored = model.fit_predict(pts.where(F.floor(F.col("idx") / F.lit(size)) == block))
        out = scored if out is None else out.unionByName(scored)
    return out.select("idx", "label", F.round("score", 6).alias("score"))


def _by_blocks(spark, sf_dir, **more):
    """A model that has seen the events in four blocks, oldest first, and the scores of all."""
    pts = materialize(sources.numbered(sources.valid(sources.from_events(spark, sf_dir)).drop("idx"), ["t", "features"]), "event_blocks")
    size = -(-pts.count() // 4)
    model, out = StreamClusterer(spark, k=K, T=86400.0, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE, **more), None
    for block in range(4):
        scored = model.fit_predict(pts.where(F.floor(F.col("idx") / F.lit(size)) == block))
        out = scored if out is None else out.unionByName(scored)
    return model, out


def model_colors(spark, sf_dir):
    """The color maps of a model after four blocks: weights faded to now, and shares."""
    model, _ = _by_blocks(spark, sf_dir)
    return model.get_colors(model.state.now).select("oid", "color", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


def model_color_votes(spark, sf_dir):
    """Labels by the color maps of the nearest observers, over four blocks."""
    _, out = _by_blocks(spark, sf_dir)
    return out.select("idx", "label", F.round("score", 6).alias("score"))


def model_random_sampling(spark, sf_dir):
    """Observers drawn by a seeded digest and a time-biased reservoir, over four blocks."""
    _, out = _by_blocks(spark, sf_dir, random_sampling=True, seed=5)
    return out.select("idx", "label", F.round("score", 6).alias("score"))


def reservoir_sample(spark, sf_dir):
    """A time-biased sample of the items, merged from those of the even and the odd ones."""
    pts = sources.valid(sources.from_lineitem(spark, sf_dir), 4)
    halves = [sampling.reservoir(pts.where(F.col("idx") % 2 == r), K, HORIZON, 7) for r in (0, 1)]
    return sampling.merged(*halves, K).select("idx", "t", F.round("priority", 6).alias("priority"))


def windowed_measures(spark, sf_dir):
    """Measures of each closed day of a stream of scored events; every third event is taken for an outlier."""
    pts = materialize(sources.numbered(sources.valid(sources.from_events(spark, sf_dir)).drop("idx"), ["t", "features"]), "event_blocks")
    model = StreamClusterer(spark, k=K, T=86400.0, x=X, chi_min=CHI, zeta=ZETA, e=MIN_SIZE)
    scored = model.fit_predict(pts).join(pts.select("idx", "t"), "idx")
    place = f"{scratch_root(spark)}/measures-{uuid.uuid4().hex}"
    scored.select(F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("ts"), F.pmod("idx", F.lit(3)).alias("truth"), "label", "score").write.parquet(f"{place}/in")
    stream = spark.readStream.schema("ts timestamp, truth bigint, label int, score double").option("maxFilesPerTrigger", 1_000_000).parquet(f"{place}/in")
    runner.evaluate(stream, "ts", "1 day", "1 hour", f"{place}/out", f"{place}/checkpoint").awaitTermination()
    counts = spark.read.schema("start timestamp, truth bigint, label int, score double, n bigint").parquet(f"{place}/out")
    rows = evaluation.measures(counts, F.col("truth") == 0)
    return rows.select(F.unix_seconds("start").alias("start"), "n", *[F.round(c, 6).alias(c) for c in ("ari", "auc", "threshold")])


KEYS = 4


def _keyed(spark, sf_dir):
    """Events as a stream in three steps, a model for each of four keys, the query started anew for
    each step; a buffer holds three eighths of a key's rows, so that groups end within steps and some rows wait at the end. Returns where
    the scores and the checkpoint are."""
    pts, many = _keyed_points(spark, sf_dir)
    steps = [pts.where(F.floor(F.col("n") * 3 / F.lit(max(1, many))) == part).drop("n") for part in range(3)]
    return _fed(spark, steps, lambda stream: keyed.score_by_key(stream, "key", input_buffer=max(1, many * 3 // (8 * KEYS)), **_OF_KEYS))


_OF_KEYS = {"k": K, "T": 86400.0, "x": X, "chi_min": CHI, "zeta": ZETA, "e": MIN_SIZE}


def _keyed_points(spark, sf_dir):
    """Events with a key and their number in the order of time; and how many there are."""
    pts = sources.valid(sources.from_events(spark, sf_dir)).withColumnRenamed("idx", "id")
    pts = materialize(sources.numbered(pts, ["t", "id"], "n").select(F.col("id").alias("idx"), "t", "features", F.pmod("id", F.lit(KEYS)).alias("key"), "n"), "keyed_points")
    return pts, pts.count()


def _fed(spark, steps, scorer):
    """The steps as a stream of files, its query started anew for each; the scores, and where the checkpoint is."""
    place, provider = f"{scratch_root(spark)}/keyed-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part, rows in enumerate(steps):
            rows.write.parquet(f"{place}/in/{part}")
            stream = spark.readStream.schema("idx bigint, t double, features array<double>, key bigint").option("recursiveFileLookup", "true").parquet(f"{place}/in")
            scores = scorer(stream)
            scores.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/scores").awaitTermination()
    finally:
        spark.conf.set(provider, old)
    return spark.read.schema(scores.schema).parquet(f"{place}/scores"), f"{place}/checkpoint"


def keyed_fit_predict(spark, sf_dir):
    """Scores of a model for each key."""
    scores, _ = _keyed(spark, sf_dir)
    return scores.select("key", "idx", "label", F.round("score", 6).alias("score"))


def keyed_buffer(spark, sf_dir):
    """The groups that were learned, and the rows that still wait (group -1), read from the state."""
    scores, checkpoint = _keyed(spark, sf_dir)
    rows = scores.select("key", "grp", "idx").unionByName(keyed.waiting(spark, checkpoint).select("key", F.lit(-1).cast("bigint").alias("grp"), "idx"))
    return rows.groupBy("key", "grp").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def keyed_observers(spark, sf_dir):
    """Every key's model, read from the state store."""
    _, checkpoint = _keyed(spark, sf_dir)
    rows = keyed.observers(spark, checkpoint, 86400.0)
    return rows.select("key", "oid", "label", F.round("observations", 6).alias("observations"), F.round("av_observations", 6).alias("av_observations"))


def _ordered(spark, sf_dir):
    """The same out of order: rows come up to a fortieth of all rows too early or too late, every
    fiftieth half of all rows too late, each step shuffled; the watermark is two days behind."""
    pts, many = _keyed_points(spark, sf_dir)
    moved = F.col("n") * 4000 + (F.pmod(F.col("idx") * 7919, F.lit(101)) - 50) * (2 * many) + F.when(F.col("idx") % 50 == 0, 2000 * many).otherwise(0)
    part = F.least(F.lit(2), F.floor(F.greatest(F.lit(0), moved) * 3 / F.lit(4000 * max(1, many))))
    pts = pts.withColumn("part", part)
    steps = [pts.where(F.col("part") == p).drop("n", "part").repartition(4, "idx").sortWithinPartitions(F.md5(F.col("idx").cast("string"))) for p in range(3)]
    return _fed(spark, steps, lambda stream: keyed.score_in_order(stream, "key", "2 days", input_buffer=max(1, many * 3 // (8 * KEYS)), **_OF_KEYS))


def ordered_fit_predict(spark, sf_dir):
    """Scores of a model for each key, which learns a shuffled stream in the order of event time."""
    scores, _ = _ordered(spark, sf_dir)
    return scores.where(~F.col("late")).select("key", "idx", "label", F.round("score", 6).alias("score"))


def ordered_standing(spark, sf_dir):
    """What became of each row of a shuffled stream: the number of its group, -1 if it waits in the
    buffer, -2 if the watermark has not passed it, -3 if it came too late."""
    scores, checkpoint = _ordered(spark, sf_dir)
    rows = scores.select("key", "idx", F.when(F.col("late"), F.lit(-3)).otherwise(F.col("grp")).cast("bigint").alias("grp"))
    for number, held in ((-1, keyed.waiting(spark, checkpoint)), (-2, keyed.early(spark, checkpoint))):
        rows = rows.unionByName(held.select("key", "idx", F.lit(number).cast("bigint").alias("grp")))
    return rows


LARGE = 2000


def large_model_nearest(spark, sf_dir):
    """The nearest of 2,000 observers of each event: the bounds of pivots leave few distances to be taken."""
    pts = sources.valid(sources.from_events(spark, sf_dir))
    near = neighbours.nearest(pts, sampling.first_observers(pts, LARGE), X)
    # distances are multiples of 1e-9: a tenth of that keeps a sixth digit from being rounded at halves
    return near.select("idx", "oid", F.round(F.col("d") + 1e-10, 6).alias("d"), "rk")


_PTS = "pts AS (SELECT vec_id AS idx, CAST(vec_id AS DOUBLE) AS t, CAST(embedding AS DOUBLE[]) AS f, label AS truth FROM embeddings)"
_OBS = f"obs AS (SELECT idx AS oid, t AS time_added, f FROM pts ORDER BY (idx * 7919 + 13) % 1000003, idx LIMIT {K})"
_NOW = "now AS (SELECT max(t) AS now FROM pts)"
_NEAR = f"""near AS (SELECT idx, t, oid, d, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, oid) AS rk
  FROM (SELECT p.idx, p.t, o.oid, round(list_distance(p.f, o.f), 9) AS d FROM pts p JOIN obs o ON p.idx <> o.oid)) WHERE rk <= {X})"""
_FADED = f"faded AS (SELECT oid, sum(exp(-(now - t) / CAST({HORIZON} AS DOUBLE))) AS observations, max(t) AS touched FROM near, now GROUP BY oid)"
_AV = f"""av AS (SELECT o.oid, coalesce(observations, 0) AS observations,
  coalesce(observations, 0) / nullif(1 - exp(-(now - time_added) / CAST({HORIZON} AS DOUBLE)), 0) AS av_observations
  FROM obs o LEFT JOIN faded USING (oid), now)"""
_ACTIVE = f"""act AS (SELECT oid FROM (SELECT oid, row_number() OVER (ORDER BY round(av_observations, 9) DESC NULLS FIRST, oid) AS rk, count(*) OVER () AS n FROM av)
  WHERE rk <= ceil(CAST(1 - {IDLE} AS DOUBLE) * n))"""
_PAIRS = "pairs AS (SELECT a.oid AS a, b.oid AS b, round(list_distance(a.f, b.f), 9) AS d FROM obs a JOIN obs b ON a.oid <> b.oid)"
_H = f"h AS (SELECT a AS oid, d AS h FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rk FROM pairs) WHERE rk = {CHI})"
_EDGES = f"""cut AS (SELECT oid, round(CAST({ZETA} AS DOUBLE) * h + CAST(1 - {ZETA} AS DOUBLE) * avg(h) OVER (), 9) AS c FROM h),
edges AS (SELECT a AS src, b AS dst, d FROM pairs JOIN cut x ON x.oid = a JOIN cut y ON y.oid = b WHERE a < b AND d < x.c AND d < y.c)"""
_COMP = """reach AS (SELECT oid AS node, oid AS got FROM obs UNION
  SELECT r.node, CASE WHEN r.got = e.src THEN e.dst ELSE e.src END FROM reach r JOIN edges e ON r.got IN (e.src, e.dst)),
comp AS (SELECT node AS oid, min(got) AS component FROM reach GROUP BY node)"""
_LABELS = f"""named AS (SELECT component, CAST(row_number() OVER (ORDER BY component) - 1 AS INTEGER) AS label FROM comp GROUP BY component HAVING count(*) >= {MIN_SIZE}),
labels AS (SELECT oid, coalesce(label, -1) AS label FROM comp LEFT JOIN named USING (component))"""
_VOTES = """cast_votes AS (SELECT idx, label, count(*) AS n FROM near JOIN labels USING (oid) WHERE label >= 0 GROUP BY idx, label),
best AS (SELECT idx, label FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n DESC, label) AS rk FROM cast_votes) WHERE rk = 1),
votes AS (SELECT idx, coalesce(label, -1) AS label FROM (SELECT DISTINCT idx FROM near) LEFT JOIN best USING (idx))"""
_SCORES = "scores AS (SELECT idx, median(d) AS score FROM near GROUP BY idx)"
_GRAPH = (_PAIRS, _H, _EDGES, _COMP, _LABELS)


def _sql(*parts: str) -> str:
    *tables, last = parts
    return "WITH RECURSIVE " + ",\n".join([_PTS, _OBS, _NOW, *tables]) + "\n" + last


def _distance_sql(d: str) -> str:
    return _sql(f"SELECT idx, oid, round({d}, 6) AS d FROM pts p, obs o")


_GAPS = "list_transform(range(1, len(p.f) + 1), lambda i: {})"
_COLORS = f"colors AS (SELECT oid, label AS color, sum(exp(-(now - t) / CAST({HORIZON} AS DOUBLE))) AS weight FROM near JOIN votes USING (idx), now GROUP BY oid, label)"
_OVERWRITE = "SELECT idx, CASE WHEN score > (SELECT avg(score) + 3 * stddev_pop(score) FROM scores) THEN -1 ELSE label END AS label, round(score, 6) AS score FROM scores JOIN votes USING (idx)"
_EMBEDDED = "SELECT vec_id AS idx, CAST(vec_id AS DOUBLE) AS t, CAST(embedding AS DOUBLE[]) AS f FROM embeddings"
_SECONDS = "epoch_us(ts) / CAST(1000000 AS DOUBLE)"
_EVENTS = f"SELECT event_id AS idx, {_SECONDS} AS t, [value / 100, {_SECONDS} % 86400 / 86400] AS f FROM events WHERE value IS NOT NULL AND ts IS NOT NULL"
_ITEMS = "SELECT l_orderkey * 8 + l_linenumber AS idx, epoch_us(l_shipdate) / CAST(1000000 AS DOUBLE) / 86400 AS t, [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 10] AS f FROM lineitem"
_CSV = f"""SELECT row_number() OVER (ORDER BY t, f0, f1, label) - 1 AS idx, t, [f0, f1] AS f FROM (
  SELECT {_SECONDS} AS t, round(value / 100, 6) AS f0, round({_SECONDS} % 86400 / 86400, 6) AS f1, event_id % 3 - 1 AS label FROM events)"""
_QUARTERS = [f"idx // CAST(ceil((SELECT count(*) FROM pts) / CAST(4 AS DOUBLE)) AS BIGINT) = {b}" for b in range(4)]
_RANKED = f"SELECT row_number() OVER (ORDER BY t, f) - 1 AS idx, t, f FROM ({_EVENTS})"
_CHANCE = "(CAST('0x' || left(md5('{}:' || CAST(idx AS VARCHAR)), 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE)"
_BASE = f"CAST({MAX_FREQ} AS DOUBLE) / CAST({BINS - 1} AS DOUBLE)"
_PATTERN = (
    f"""waves AS (SELECT oid, CAST(bin AS INTEGER) AS bin, sum(exp(-(now - t) / CAST({HORIZON} AS DOUBLE)) * cos({_BASE} * bin * t)) AS re, sum(exp(-(now - t) / CAST({HORIZON} AS DOUBLE)) * sin({_BASE} * bin * t)) AS im
  FROM near, now, range({BINS}) AS b(bin) GROUP BY oid, bin)""",
    f"grid AS (SELECT CAST(step AS INTEGER) AS step, step * 2 * pi() / ({_BASE}) / {PHASES} AS phase FROM range({PHASES}) AS g(step))",
    f"""pattern AS (SELECT oid, step, phase, sum(CASE bin WHEN 0 THEN re ELSE 2 * (re * cos({_BASE} * bin * phase) + im * sin({_BASE} * bin * phase)) END) / sum(CASE bin WHEN 0 THEN re ELSE 0 END) AS density
  FROM waves, grid GROUP BY oid, step, phase)""",
)
_ANSWER = "SELECT idx, label, round(score, 6) AS score FROM answer"


def _model_sql(points: str, last: str = _ANSWER, horizon: float = HORIZON, **more) -> str:
    return model_sql(points, last, k=K, horizon=horizon, x=X, chi=CHI, zeta=ZETA, size=MIN_SIZE, idle=IDLE, **more)


_DAYS = 2 * 86_400_000
_TIMED = f"""SELECT *, ms < max(mark) OVER (ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late, max(mark) OVER () AS passed FROM (
  SELECT *, ms - {_DAYS} AS mark, least(2, greatest(0, n * 4000 + (idx * 7919 % 101 - 50) * 2 * many + CASE WHEN idx % 50 = 0 THEN 2000 * many ELSE 0 END) * 3 // (4000 * many)) AS part FROM (
    SELECT *, CAST(floor(round(t * 1000000) / 1000) AS BIGINT) AS ms, row_number() OVER (ORDER BY t, idx) - 1 AS n, count(*) OVER () AS many FROM ({_EVENTS})))"""
_DUE = f"SELECT idx, t, f FROM ({_TIMED}) WHERE late IS NOT TRUE AND ms < passed"


def _keyed_sql(last: str, due: str = _EVENTS) -> str:
    """The model's SQL for each key, over the groups of its buffer that are full with the rows ``due``."""
    size = f"(SELECT greatest(1, count(*) * 3 // {8 * KEYS}) FROM ({_EVENTS}))"
    parts = []
    for key in range(KEYS):
        own = f"SELECT idx, t, f, row_number() OVER (ORDER BY t, idx) - 1 AS rn FROM ({due}) WHERE idx % {KEYS} = {key}"
        blocks = [f"rn // {size} = {b} AND (rn // {size} + 1) * {size} <= (SELECT count(*) FROM pts)" for b in range(2)]
        parts.append(f"SELECT CAST({key} AS BIGINT) AS key, * FROM ({_model_sql(own, last, 86400.0, blocks=blocks)})")
    return " UNION ALL ".join(parts)


_MEASURES = """SELECT CAST(w.start AS BIGINT) AS start, w.n, round(ari, 6) AS ari, round(auc, 6) AS auc, round(threshold, 6) AS threshold FROM (
  SELECT start, count(*) AS n, avg(score) + 3 * stddev_pop(score) AS threshold FROM closed GROUP BY start) w
JOIN (SELECT start, coalesce((s - a * b / p) / nullif((a + b) / 2 - a * b / p, 0), 1) AS ari FROM (
    SELECT start, sum(m * (m - 1) / 2) AS s, sum(m) * (sum(m) - 1) / 2 AS p FROM (SELECT start, truth, label, CAST(count(*) AS DOUBLE) AS m FROM closed GROUP BY ALL) GROUP BY start)
  JOIN (SELECT start, sum(m * (m - 1) / 2) AS a FROM (SELECT start, truth, CAST(count(*) AS DOUBLE) AS m FROM closed GROUP BY ALL) GROUP BY start) USING (start)
  JOIN (SELECT start, sum(m * (m - 1) / 2) AS b FROM (SELECT start, label, CAST(count(*) AS DOUBLE) AS m FROM closed GROUP BY ALL) GROUP BY start) USING (start)) USING (start)
JOIN (SELECT start, (sum(rk) FILTER (truth = 0) - pos * (pos + 1) / 2) / nullif(pos * (n - pos), 0) AS auc FROM (
    SELECT start, truth, rank() OVER (PARTITION BY start ORDER BY score) + (count(*) OVER (PARTITION BY start, score) - 1) / CAST(2 AS DOUBLE) AS rk,
      CAST(count(*) FILTER (truth = 0) OVER (PARTITION BY start) AS DOUBLE) AS pos, count(*) OVER (PARTITION BY start) AS n FROM closed) GROUP BY start, pos, n) USING (start)"""
_CLOSED = f"""WITH answered AS (SELECT * FROM ({{answer}})), ranked AS ({_RANKED}), seen AS (SELECT t, idx % 3 AS truth, label, score FROM answered JOIN ranked USING (idx)),
closed AS (SELECT floor(t / 86400) * 86400 AS start, truth, label, score FROM seen WHERE floor(t / 86400) * 86400 + 86400 <= (SELECT max(t) - 3600 FROM seen))
"""


_TABLE: dict = {
    "dist_euclidean": (_distance("euclidean"), _distance_sql("list_distance(p.f, o.f)")),
    "dist_manhattan": (_distance("manhattan"), _distance_sql(f"list_sum({_GAPS.format('abs(p.f[i] - o.f[i])')})")),
    "dist_chebyshev": (_distance("chebyshev"), _distance_sql(f"list_max({_GAPS.format('abs(p.f[i] - o.f[i])')})")),
    "dist_minkowski3": (_distance("minkowski", 3), _distance_sql(f"pow(list_sum({_GAPS.format('pow(abs(p.f[i] - o.f[i]), 3)')}), CAST(1 AS DOUBLE) / 3)")),
    "observer_sample": (observer_sample, _sql("SELECT oid, time_added, round(list_sum(f), 6) AS total FROM obs")),
    "sampled_rows": (sampled_rows, _sql("SELECT idx, t FROM pts WHERE (idx * 7919 + 13) % 1000003 < 250000")),
    "sampled_membership": (sampled_membership, _sql("SELECT idx, t FROM pts WHERE idx IN (SELECT oid FROM obs)")),
    "unsampled_rows": (unsampled_rows, _sql("SELECT idx, t FROM pts WHERE idx NOT IN (SELECT oid FROM obs)")),
    "knn_top5": (knn_top5, _sql(_NEAR, "SELECT idx, oid, CAST(rk AS INTEGER) AS rk, round(d, 6) AS d FROM near")),
    "observation_counts": (observation_counts, _sql(_NEAR, "SELECT oid, count(*) AS n FROM near GROUP BY oid")),
    "faded_observations": (faded_observations, _sql(_NEAR, _FADED, "SELECT oid, round(observations, 6) AS observations, touched FROM faded")),
    "av_observations": (av_observations, _sql(_NEAR, _FADED, _AV, "SELECT oid, round(observations, 6) AS observations, round(av_observations, 6) AS av_observations FROM av")),
    "active_observers": (active_observers, _sql(_NEAR, _FADED, _AV, _ACTIVE, "SELECT oid FROM act")),
    "replaced_observers": (replaced_observers, _sql(_NEAR, _FADED, _AV, "SELECT oid FROM av ORDER BY round(av_observations, 9) ASC NULLS LAST, oid LIMIT 10")),
    "outlier_score_median": (outlier_score_median, _sql(_NEAR, _SCORES, "SELECT idx, round(score, 6) AS score FROM scores")),
    "outlier_score_relative": (outlier_score_relative, _sql(_NEAR, _PAIRS, _H, "SELECT idx, round(median(d / nullif(h, 0)), 6) AS score FROM near JOIN h USING (oid) GROUP BY idx")),
    "chi_cutoff": (chi_cutoff, _sql(_PAIRS, _H, "SELECT oid, round(h, 6) AS h FROM h")),
    "zeta_edges": (zeta_edges, _sql(_PAIRS, _H, _EDGES, "SELECT src, dst, round(d, 6) AS d FROM edges")),
    "components": (components, _sql(_PAIRS, _H, _EDGES, _COMP, "SELECT oid, component FROM comp")),
    "min_cluster_size": (min_cluster_size, _sql(*_GRAPH, "SELECT oid, label FROM labels")),
    "vote_label": (vote_label, _sql(_NEAR, *_GRAPH, _VOTES, "SELECT idx, label FROM votes")),
    "color_observations": (color_observations, _sql(_NEAR, *_GRAPH, _VOTES, _COLORS, "SELECT oid, color, round(weight, 6) AS weight FROM colors")),
    "color_distribution": (color_distribution, _sql(_NEAR, *_GRAPH, _VOTES, _COLORS, "SELECT oid, color, round(weight / sum(weight) OVER (PARTITION BY oid), 6) AS share FROM colors")),
    "cluster_listing": (cluster_listing, _sql(*_GRAPH, "SELECT label, count(*) AS observers, min(oid) AS first, max(oid) AS last FROM labels GROUP BY label")),
    "handled_labels": (handled_labels, _sql(_NEAR, *_GRAPH, _VOTES, _SCORES, "SELECT idx, CASE WHEN score > CAST(1.3 AS DOUBLE) THEN -1 ELSE label END AS label, round(score, 6) AS score FROM scores JOIN votes USING (idx)")),
    "outlier_overwrite_3sigma": (outlier_overwrite_3sigma, _sql(_NEAR, *_GRAPH, _VOTES, _SCORES, _OVERWRITE)),
    "label_dense_code": (label_dense_code, _sql(_NEAR, *_GRAPH, _VOTES, "SELECT idx, label, CAST(dense_rank() OVER (ORDER BY label) - 2 AS INTEGER) AS code FROM votes")),
    "distinct_labels": (distinct_labels, _sql(_NEAR, *_GRAPH, _VOTES, "SELECT DISTINCT label FROM votes")),
    "inlier_counts": (inlier_counts, _sql(_NEAR, *_GRAPH, _VOTES, "SELECT count(*) FILTER (label > -1) AS inliers, count(*) FILTER (label = -1) AS outliers FROM votes")),
    "ari": (ari, _sql(_NEAR, *_GRAPH, _VOTES, """cells AS (SELECT truth AS y, label AS p, CAST(count(*) AS DOUBLE) AS n FROM pts JOIN votes USING (idx) GROUP BY ALL),
s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS total FROM cells),
a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM cells GROUP BY y)),
b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM cells GROUP BY p)),
e AS (SELECT *, a * b / (total * (total - 1) / 2) AS e FROM s, a, b)""", "SELECT round((s - e) / ((a + b) / 2 - e), 9) AS ari FROM e")),
    "roc_auc": (roc_auc, _sql(_NEAR, _SCORES, """r AS (SELECT truth = 0 AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS rk FROM scores JOIN pts USING (idx)),
g AS (SELECT sum(rk) FILTER (pos) AS r, CAST(count(*) FILTER (pos) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM r)""", "SELECT round((r - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM g")),
    "block_ids": (block_ids, f"SELECT event_id // {BLOCK} AS block, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL"),
    "buffer_batches": (buffer_batches, _sql(f"SELECT idx // {BUFFER} AS buffer, count(*) AS n, max(t) AS t FROM pts GROUP BY ALL")),
    "block_union": (block_union, _sql("SELECT idx, t FROM pts")),
    "event_points": (event_points, "SELECT event_id AS idx, round(epoch_us(ts) / CAST(1000000 AS DOUBLE), 3) AS t, round(value / 100, 6) AS f0, round((epoch_us(ts) / CAST(1000000 AS DOUBLE)) % 86400 / 86400, 6) AS f1 FROM events"),
    "lineitem_points": (lineitem_points, "SELECT l_orderkey * 8 + l_linenumber AS idx, epoch_us(l_shipdate) / CAST(1000000 AS DOUBLE) / 86400 AS t, round(l_quantity / 50, 8) AS f0, round(l_extendedprice / 100000, 8) AS f1, round(l_discount * 10, 8) AS f2, round(l_tax * 10, 8) AS f3 FROM lineitem"),
    "perturbed_ties": (perturbed_ties, _sql("SELECT idx, round(CAST(0.001 AS DOUBLE) * ((idx * 7919 + 5) % 1000003) / CAST(1000003 AS DOUBLE), 12) AS eps FROM pts")),
    "codec_round_trip": (codec_round_trip, "SELECT event_id, right(lpad(lower(hex(event_id * -3 + 1000)), 16, CASE WHEN event_id * -3 + 1000 < 0 THEN 'f' ELSE '0' END), 8) AS bytes, event_id * -3 + 1000 AS n, value FROM events"),
    "fading_factors": (fading_factors, _sql(f"SELECT idx, round(exp(-(now - t) / CAST({HORIZON} AS DOUBLE)), 9) AS weight, round(nullif(1 - exp(-(now - t) / CAST({HORIZON} AS DOUBLE)), 0), 9) AS age FROM pts, now")),
    "temporal_fourier_sums": (temporal_fourier_sums, _sql(_NEAR, f"""x AS (SELECT oid, CAST(bin AS INTEGER) AS bin, exp(-(now - t) / CAST({HORIZON} AS DOUBLE)) AS w, CAST({MAX_FREQ} AS DOUBLE) * bin / CAST({BINS - 1} AS DOUBLE) * t AS ph FROM near, now, range({BINS}) AS b(bin))""", "SELECT oid, bin, round(sum(w * cos(ph)), 6) AS re, round(sum(w * sin(ph)), 6) AS im FROM x GROUP BY oid, bin")),
    "temporal_patterns": (temporal_patterns, _sql(_NEAR, *_PATTERN, "SELECT oid, step, round(phase, 6) AS phase, round(density, 6) AS density FROM pattern")),
    "temporal_peaks": (temporal_peaks, _sql(_NEAR, *_PATTERN, "SELECT oid, round(phase, 6) AS phase, round(density, 6) AS density FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY round(density, 9) DESC, step) AS rk FROM pattern) WHERE rk = 1")),
    "model_temporal_predict": (model_temporal_predict, _model_sql(_EMBEDDED, blocks=["idx % 2 = 0"], predict="true", waves=(BINS, MAX_FREQ))),
    "fit_predict_flagship": (fit_predict_flagship, _sql(_NEAR, _FADED, _AV, _ACTIVE, *_GRAPH, _NEAR.replace("near AS", "awake AS", 1).replace("JOIN obs o", "JOIN (SELECT * FROM obs WHERE oid IN (SELECT oid FROM act)) o"), _VOTES.replace("near", "awake"), _SCORES.replace("near", "awake"), _OVERWRITE)),
    "get_observers": (get_observers, _sql(_NEAR, _FADED, _AV, *_GRAPH, "SELECT oid, label, round(observations, 6) AS observations, round(av_observations, 6) AS av_observations FROM av JOIN labels USING (oid)")),
    "observer_count": (observer_count, _sql("SELECT count(*) AS n FROM obs")),
    "model_fit_predict": (_model(StreamClusterer), _model_sql(_EMBEDDED)),
    "model_temporal_fit_predict": (_model(TemporalStreamClusterer), _model_sql(_EMBEDDED, waves=(BINS, MAX_FREQ))),
    "model_predict_only": (predict_only, _model_sql(_ITEMS, "SELECT idx, label, round(score, 7) AS score FROM answer", blocks=["idx % 2 = 0"], predict="true")),
    "model_get_observers": (model_observers, _model_sql(_EVENTS, "SELECT oid, label, round(n, 6) AS observations FROM model", 86400.0)),
    "streaming_fit_predict": (streaming_fit_predict, _model_sql(_EMBEDDED)),
    "csv_points": (csv_points, """SELECT row_number() OVER (ORDER BY t, f0, f1, label) - 1 AS idx, round(t, 3) AS t, f0, f1, label FROM (
  SELECT epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t, round(value / 100, 6) AS f0, round((epoch_us(ts) / CAST(1000000 AS DOUBLE)) % 86400 / 86400, 6) AS f1, CAST(event_id % 3 - 1 AS INTEGER) AS label FROM events)"""),
    "model_colors": (model_colors, _model_sql(_RANKED, "SELECT oid, CAST(color AS INTEGER) AS color, round(weight * exp(-((SELECT max(touched) FROM model) - ct) / CAST(86400 AS DOUBLE)), 6) AS weight, round(share, 6) AS share FROM maps", 86400.0, blocks=_QUARTERS)),
    "model_color_votes": (model_color_votes, _model_sql(_RANKED, horizon=86400.0, blocks=_QUARTERS)),
    "model_random_sampling": (model_random_sampling, _model_sql(_RANKED, horizon=86400.0, blocks=_QUARTERS, chance=5)),
    "reservoir_sample": (reservoir_sample, f"SELECT idx, t, round(p, 6) AS priority FROM (SELECT idx, t, ln(-ln({_CHANCE.format(7)})) - t / CAST({HORIZON} AS DOUBLE) AS p FROM ({_ITEMS})) ORDER BY p, idx LIMIT {K}"),
    "keyed_fit_predict": (keyed_fit_predict, _keyed_sql(_ANSWER)),
    "keyed_buffer": (keyed_buffer, f"""WITH e AS ({_EVENTS}), r AS (SELECT idx % {KEYS} AS key, idx, row_number() OVER (PARTITION BY idx % {KEYS} ORDER BY t, idx) - 1 AS rn, count(*) OVER (PARTITION BY idx % {KEYS}) AS m, (SELECT greatest(1, count(*) * 3 // {8 * KEYS}) FROM e) AS size FROM e)
SELECT key, CASE WHEN (rn // size + 1) * size <= m THEN rn // size ELSE -1 END AS grp, count(*) AS n, min(idx) AS first, max(idx) AS last FROM r GROUP BY ALL"""),
    "keyed_observers": (keyed_observers, _keyed_sql("SELECT oid, label, round(n, 6) AS observations, round(n / nullif(1 - exp(-(touched - added) / CAST(86400 AS DOUBLE)), 0), 6) AS av_observations FROM model")),
    "ordered_fit_predict": (ordered_fit_predict, _keyed_sql(_ANSWER, _DUE)),
    "ordered_standing": (ordered_standing, f"""WITH e AS MATERIALIZED ({_TIMED}), size AS (SELECT greatest(1, count(*) * 3 // {8 * KEYS}) AS size FROM e),
d AS (SELECT idx, idx % {KEYS} AS key, row_number() OVER (PARTITION BY idx % {KEYS} ORDER BY t, idx) - 1 AS rn, count(*) OVER (PARTITION BY idx % {KEYS}) AS m FROM e WHERE late IS NOT TRUE AND ms < passed)
SELECT key, idx, CASE WHEN (rn // size + 1) * size <= m THEN rn // size ELSE -1 END AS grp FROM d, size
UNION ALL SELECT idx % {KEYS}, idx, CASE WHEN late THEN -3 ELSE -2 END FROM e WHERE late OR ms >= passed"""),
    "large_model_nearest": (large_model_nearest, f"""WITH pts AS ({_EVENTS}), obs AS (SELECT idx AS oid, f[1] AS a, f[2] AS b FROM pts ORDER BY (idx % 1000003 * 7919 + 13) % 1000003, idx LIMIT {LARGE}),
gap AS (SELECT idx, oid, round(sqrt((f[1] - a) * (f[1] - a) + (f[2] - b) * (f[2] - b)), 9) AS d FROM pts JOIN obs ON idx <> oid)
SELECT idx, oid, round(d + CAST(1e-10 AS DOUBLE), 6) AS d, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d, oid) AS rk FROM gap) WHERE rk <= {X}"""),
    "windowed_measures": (windowed_measures, _CLOSED.format(answer=_model_sql(_RANKED, horizon=86400.0)) + _MEASURES),
    "csv_fit_predict": (csv_fit_predict, _model_sql(_CSV, horizon=86400.0, blocks=_QUARTERS)),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _TABLE.items() if sql}
