"""The clustering model: a bounded set of observers that fades, and scoring by it.

State is at most ``k`` observers and small tables over them, which ``save`` writes to a folder and
``load`` reads again; a batch is sampled, counted, clustered and scored by ``steps`` inside Spark's
tasks, which get that bounded state. Formulas that the reference only declares are this engine's
own; see the README.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from . import steps
from .sampling import MODULUS, chance, priority, rank_of
from .scoring import patterns
from .steps import MOST_OBSERVERS, Parameters, State, distances

__all__ = ["MOST_OBSERVERS", "Parameters", "State", "StreamClusterer", "TemporalStreamClusterer", "distances"]

_WAITING = "idx bigint, t double, features array<double>"


class StreamClusterer:
    """fit, predict and fit_predict over DataFrames of points (idx, t, features)."""

    temporal = False

    def __init__(self, spark: SparkSession, **parameters):
        self.spark, self.params, self.state = spark, Parameters(**parameters), None
        self._waiting, self._waiting_rows = [], 0

    # --- what a batch does: sample, fit, update, predict

    def fit(self, points: DataFrame) -> StreamClusterer:
        """Sample new observers, count hits, rebuild the graph.

        With ``input_buffer`` = n a model that exists waits until n rows have come together; rows
        are always scored by the newest model.
        """
        if self.params.input_buffer > 1 and self.state is not None:
            kept = materialize(points.select("idx", "t", "features"), "buffer")
            self._waiting.append(kept)
            self._waiting_rows += kept.count()
            if self._waiting_rows < self.params.input_buffer:
                return self
            points = self._gathered()
            self._waiting, self._waiting_rows = [], 0
        self._sample(points)
        self._count(points)
        self.state = steps.update(self.state, self.params)
        self.state.version += 1
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        """(idx, label, score) by the model as it is."""
        s, p = self.state, self.params
        if s is None or not len(s.oid):
            return points.select("idx", F.lit(-1).alias("label"), F.lit(None).cast("double").alias("score"))
        shared = self.spark.sparkContext.broadcast((s, p.plain(), steps.active(s, p, s.now), self.temporal))
        named = p.named

        def run(batches):
            state, params, act, temporal = shared.value
            for batch in batches:
                if len(batch):
                    label, score = steps.score(batch, state, params, act, temporal, named)
                    yield pd.DataFrame({"idx": batch["idx"], "label": label.astype(np.int32), "score": score})

        return points.select("idx", "t", "features").mapInPandas(run, "idx bigint, label int, score double")

    def fit_predict(self, points: DataFrame) -> DataFrame:
        """A batch is scored by the model that already knows it."""
        return self.fit(points).predict(points)

    # --- state that outlives the driver

    def save(self, path: str) -> None:
        """The state as one row of Parquet, and beside it the rows that wait in the input buffer."""
        data = b"" if self.state is None else self.state.packed()
        self.spark.createDataFrame([(bytearray(data),)], "state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
        waiting = self._gathered() if self._waiting else self.spark.createDataFrame([], _WAITING)
        waiting.write.mode("overwrite").parquet(f"{path}/waiting")

    def load(self, path: str) -> StreamClusterer:
        """What was saved there, instead of the own state and waiting rows."""
        data = bytes(self.spark.read.schema("state binary").parquet(f"{path}/state").first()["state"])
        self.state = State.unpacked(data) if data else None
        waiting = self.spark.read.schema(_WAITING).parquet(f"{path}/waiting")
        self._waiting_rows = waiting.count()
        self._waiting = [materialize(waiting, "buffer")] if self._waiting_rows else []  # the folder may go
        return self

    def _gathered(self) -> DataFrame:
        points = self._waiting[0]
        for more in self._waiting[1:]:
            points = points.unionByName(more)
        return points

    # --- read-outs

    def observer_count(self) -> int:
        return 0 if self.state is None else len(self.state.oid)

    def get_observers(self, time: float) -> DataFrame:
        """(oid, features, label, observations, av_observations) as of ``time``."""
        s, fade = self.state or State.new(), self.params.fade
        faded = s.observations * fade ** (time - s.touched)
        age = 1 - fade ** (time - s.added)
        av = [float(f / a) if a > 0 else None for f, a in zip(faded, age, strict=True)]
        rows = list(zip(s.oid.tolist(), s.data.tolist(), s.label.tolist(), faded.tolist(), av, strict=True))
        return self.spark.createDataFrame(rows, "oid bigint, features array<double>, label int, observations double, av_observations double")

    def get_clusters(self) -> DataFrame:
        """(color, observers, share): each cluster's observers and share of all counts."""
        s = self.state or State.new()
        whole = max(float(s.observations.sum()), 1e-300)
        rows = [(int(c), s.oid[s.label == c].tolist(), float(s.observations[s.label == c].sum() / whole)) for c in np.unique(s.label)]
        return self.spark.createDataFrame(rows, "color int, observers array<bigint>, share double")

    def get_colors(self, time: float) -> DataFrame:
        """(oid, color, weight, share): every observer's color map as of ``time``, and its distribution."""
        s = self.state or State.new()
        faded = s.weight * self.params.fade ** (time - s.colored)
        rows = list(zip(s.owner.tolist(), s.color.tolist(), faded.tolist(), steps.distribution(s).tolist(), strict=True))
        return self.spark.createDataFrame(rows, "oid bigint, color int, weight double, share double")

    # --- steps

    @property
    def _now(self) -> float:
        return self.state.now

    def _sample(self, points: DataFrame) -> None:
        """Rows come in with probability k / T for each unit of time a row stands for; the first
        batch fills the model. Of rows that share an index one can be an observer. At most k rows
        reach the driver. With ``random_sampling`` a row's chance is a seeded hash of its index and
        the filling batch is the time-biased reservoir; neither depends on partitions."""
        p, first = self.params, self.state is None
        if not p.random_sampling:
            ranked = points.withColumn("r", rank_of(F.col("idx"), p.seed) / F.lit(float(MODULUS)))
        elif first:
            ranked = points.withColumn("r", priority(F.col("idx"), F.col("t"), p.T, p.seed))
        else:
            ranked = points.withColumn("r", chance(F.col("idx"), p.seed))
        rate = min(1.0, p.k / p.T)
        rows = (ranked if first else ranked.where(F.col("r") < rate)).orderBy("r", "idx", "t", "features").limit(p.k).toPandas()
        if first:
            self.state = State.new(len(rows["features"].iloc[0]) if len(rows) else 0, p.freq_bins)
        self.state = steps.admit(self.state, p, rows)

    def _count(self, points: DataFrame) -> None:
        """Faded hits of each observer, summed per partition and then over partitions."""
        s, p = self.state, self.params
        if not len(s.oid):
            return
        edge = points.agg(F.max("t").alias("now"), F.count("*").alias("n")).first()
        if not edge["n"]:
            return
        now = max(float(edge["now"]), s.now)
        shared = self.spark.sparkContext.broadcast((s, p.plain(), steps.active(s, p, now), self.temporal))
        named, bins = p.named, p.freq_bins

        def run(batches):
            state, params, act, temporal = shared.value
            k = len(state.oid)
            counted, waves = np.zeros(k), np.zeros((k, bins), complex)
            for batch in batches:
                if len(batch):
                    c, w = steps.hits(batch, state, params, act, temporal, named, now)
                    counted, waves = counted + c, waves + w
            yield pd.DataFrame({"o": np.arange(k), "hits": counted, "re": list(waves.real), "im": list(waves.imag)})

        parts = points.select("idx", "t", "features").mapInPandas(run, "o int, hits double, re array<double>, im array<double>")
        each = [F.sum(F.col(x)[i]).alias(f"{x}{i}") for x in ("re", "im") for i in range(bins)]
        rows = parts.groupBy("o").agg(F.sum("hits").alias("hits"), *each).orderBy("o").toPandas()
        waves = rows[[f"re{i}" for i in range(bins)]].to_numpy() + 1j * rows[[f"im{i}" for i in range(bins)]].to_numpy()
        self.state = steps.absorb(s, p, rows["hits"].to_numpy(), waves, now, int(edge["n"]))


class TemporalStreamClusterer(StreamClusterer):
    """Observers also know when they are hit: faded Fourier sums at ``freq_bins`` frequencies up to
    ``max_freq``. A point prefers observers whose pattern has a high density at its phase."""

    temporal = True

    def get_patterns(self, phases: int) -> DataFrame:
        """(oid, step, phase, density): when in a period each observer is hit, see ``scoring.patterns``."""
        s, p = self.state or State.new(), self.params
        rows = [(o, b, float(w.real), float(w.imag)) for o, waves in zip(s.oid.tolist(), s.waves, strict=True) for b, w in enumerate(waves)]
        return patterns(self.spark.createDataFrame(rows, "oid bigint, bin int, re double, im double"), p.freq_bins, p.max_freq, phases)
