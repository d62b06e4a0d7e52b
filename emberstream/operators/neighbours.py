"""Nearest observers of points, cutoffs of observers, and edges between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Metric, euclidean
from .steps import MOST_OBSERVERS, PIVOTED, Pivots, distances, places


def of_model(table: DataFrame) -> DataFrame:
    """A table with a row for each observer of one model, to be broadcast: it fails, and sends
    nothing, when it has more rows than a model may have."""
    few = table.limit(MOST_OBSERVERS + 1)  # one partition, whose rows are numbered from 0
    message = F.lit(f"a model has at most {MOST_OBSERVERS} observers")
    return F.broadcast(few.where(F.assert_true(F.monotonically_increasing_id() < MOST_OBSERVERS, message).isNull()))


def nearest(points: DataFrame, observers: DataFrame, x: int, metric: Metric = euclidean, exclude_self: bool = True, eps: str | None = None) -> DataFrame:
    """(idx, t, oid, d, rk): the ``x`` nearest observers of each point.

    Observers are a model of bounded capacity, gathered into one row and broadcast; each point sorts its own distances in an
    array, so there is no shuffle. Ties are ordered by ``eps`` (if given) and the observer's id.
    """
    if metric is euclidean and eps is None:
        return _nearest_by_matrix(points, observers, x, exclude_self)
    few = observers.limit(MOST_OBSERVERS + 1).agg(F.collect_list(F.struct("oid", "features", *([eps] if eps else []))).alias("model"))
    model = few.where(F.assert_true(F.size("model") <= MOST_OBSERVERS, F.lit(f"a model has at most {MOST_OBSERVERS} observers")).isNull())
    own = points.select("idx", "t", "features").crossJoin(F.broadcast(model))
    others = F.filter("model", lambda o: o["oid"] != F.col("idx")) if exclude_self else F.col("model")
    measured = F.transform(others, lambda o: F.struct(*[F.round(metric(F.col("features"), o["features"]), 9).alias("key")] + ([o[eps].alias("eps")] if eps else []) + [o["oid"].alias("oid")]))
    top = F.slice(F.array_sort(measured), 1, x)
    return own.select("idx", "t", F.posexplode(top).alias("rk", "n")).select("idx", "t", F.col("n.oid").alias("oid"), F.col("n.key").alias("d"), (F.col("rk") + 1).alias("rk"))


def _nearest_by_matrix(points: DataFrame, observers: DataFrame, x: int, exclude_self: bool) -> DataFrame:
    """The same for the Euclidean metric: a matrix of distances for each Arrow batch and, of large
    models, only those parts of it that the bounds of pivots leave."""
    shared = points.sparkSession.sparkContext.broadcast(_held(observers))

    def run(batches):
        oid, features = shared.value
        pivots = Pivots.of(features, ("euclidean",)) if len(oid) >= PIVOTED else None
        for batch in batches:
            if not len(batch) or not len(oid):
                continue
            if pivots is not None:
                near, order, _ = pivots.nearest(np.stack(batch["features"].to_numpy()).astype(float), x, _own(batch, oid, exclude_self))
                row, rank = np.nonzero(np.isfinite(near))
                yield pd.DataFrame({"idx": batch["idx"].to_numpy()[row], "t": batch["t"].to_numpy()[row], "oid": oid[order[row, rank]], "d": np.round(near[row, rank], 9), "rk": (rank + 1).astype(np.int32)})
                continue
            d = np.round(distances(np.stack(batch["features"].to_numpy()).astype(float), features, "euclidean"), 9)
            if exclude_self:
                d[batch["idx"].to_numpy()[:, None] == oid[None]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :x]  # observers lie in the order of their ids
            near = np.take_along_axis(d, order, 1)
            row, rank = np.nonzero(np.isfinite(near))
            yield pd.DataFrame({"idx": batch["idx"].to_numpy()[row], "t": batch["t"].to_numpy()[row], "oid": oid[order[row, rank]], "d": near[row, rank], "rk": (rank + 1).astype(np.int32)})

    return points.select("idx", "t", "features").mapInPandas(run, "idx bigint, t double, oid bigint, d double, rk int")


def _held(observers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a model's observers, in order, and their features."""
    held = observers.select("oid", "features").orderBy("oid").limit(MOST_OBSERVERS + 1).toPandas()
    if len(held) > MOST_OBSERVERS:
        raise ValueError(f"a model has at most {MOST_OBSERVERS} observers")
    return held["oid"].to_numpy(np.int64), np.stack(held["features"].to_numpy()).astype(float) if len(held) else np.zeros((0, 0))


def _own(batch: pd.DataFrame, oid: np.ndarray, exclude_self: bool) -> np.ndarray:
    return places(oid, batch["idx"].to_numpy()) if exclude_self else np.full(len(batch), -1)


def pruning(points: DataFrame, observers: DataFrame, x: int, exclude_self: bool = True) -> DataFrame:
    """(pairs, taken): how many pairs of a point and an observer there are, and how many distances,
    those to the pivots too, are taken to find the nearest by Euclidean distance."""
    shared = points.sparkSession.sparkContext.broadcast(_held(observers))

    def run(batches):
        oid, features = shared.value
        pivots = Pivots.of(features, ("euclidean",)) if len(oid) else None
        for batch in batches:
            if len(batch) and pivots is not None:
                taken = pivots.nearest(np.stack(batch["features"].to_numpy()).astype(float), x, _own(batch, oid, exclude_self))[2]
                yield pd.DataFrame({"pairs": [len(batch) * len(oid)], "taken": [taken]})

    parts = points.select("idx", "features").mapInPandas(run, "pairs bigint, taken bigint")
    return parts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("taken"), F.lit(0)).alias("taken"))


def pair_distances(observers: DataFrame, metric: Metric = euclidean) -> DataFrame:
    """(a, b, d) for ordered pairs of different observers of one bounded model."""
    a, b = observers.select(F.col("oid").alias("a"), F.col("features").alias("fa")), observers.select(F.col("oid").alias("b"), F.col("features").alias("fb"))
    return a.join(of_model(b), F.col("a") != F.col("b")).select("a", "b", F.round(metric(F.col("fa"), F.col("fb")), 9).alias("d"))


def cutoffs(pairs: DataFrame, chi: int) -> DataFrame:
    """(oid, h): the distance to the chi-th nearest other observer."""
    by = Window.partitionBy("a").orderBy("d", "b")
    return pairs.withColumn("rk", F.row_number().over(by)).where(F.col("rk") == chi).select(F.col("a").alias("oid"), F.col("d").alias("h"))


def edges(pairs: DataFrame, h: DataFrame, zeta: float) -> DataFrame:
    """(src, dst, d), src < dst: both local-global cutoffs lie above the distance."""
    mean = h.agg(F.avg("h").alias("m"))
    mixed = h.crossJoin(F.broadcast(mean)).select("oid", F.round(F.lit(zeta) * F.col("h") + F.lit(1 - zeta) * F.col("m"), 9).alias("cut"))
    a, b = mixed.select(F.col("oid").alias("a"), F.col("cut").alias("ca")), mixed.select(F.col("oid").alias("b"), F.col("cut").alias("cb"))
    return pairs.where("a < b").join(a, "a").join(b, "b").where((F.col("d") < F.col("ca")) & (F.col("d") < F.col("cb"))).select(F.col("a").alias("src"), F.col("b").alias("dst"), "d")
