"""Counts of observers, outlier scores and labels of points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decay
from .neighbours import of_model


def observations(near: DataFrame) -> DataFrame:
    """(oid, n): how often each observer was among the nearest."""
    return near.groupBy("oid").agg(F.count("*").alias("n"))


def faded_observations(near: DataFrame, now: DataFrame, horizon: float) -> DataFrame:
    """(oid, observations, touched): counts that fade with age, at the time ``now`` (one row)."""
    hits = near.crossJoin(F.broadcast(now))
    return hits.groupBy("oid").agg(F.sum(decay.weight(F.col("now"), F.col("t"), horizon)).alias("observations"), F.max("t").alias("touched"))


def averaged(observers: DataFrame, faded: DataFrame, now: DataFrame, horizon: float) -> DataFrame:
    """(oid, observations, av_observations): faded counts at ``now`` over age; null at age 0."""
    at = observers.join(faded, "oid", "left").crossJoin(F.broadcast(now))
    count = F.coalesce("observations", F.lit(0.0))
    return at.select("oid", count.alias("observations"), (count / decay.age(F.col("now"), F.col("time_added"), horizon)).alias("av_observations"))


def active(counts: DataFrame, idle: float) -> DataFrame:
    """(oid): all but the share ``idle`` with the lowest averaged counts; new ones are active."""
    by = Window.orderBy(F.round("av_observations", 9).desc_nulls_first(), "oid")  # a model's observers: bounded
    ranked = counts.withColumn("rk", F.row_number().over(by)).crossJoin(F.broadcast(counts.agg(F.count("*").alias("n"))))
    return ranked.where(F.col("rk") <= F.ceil(F.lit(1 - idle) * F.col("n"))).select("oid")


def outlier_scores(near: DataFrame) -> DataFrame:
    """(idx, score): the median distance to the nearest observers."""
    return near.groupBy("idx").agg(F.median("d").alias("score"))


def relative_scores(near: DataFrame, h: DataFrame) -> DataFrame:
    """(idx, score): the median of distance over the observer's cutoff."""
    return near.join(of_model(h), "oid").groupBy("idx").agg(F.median(F.col("d") / F.nullif(F.col("h"), F.lit(0.0))).alias("score"))


def votes(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, label): the label that most of the nearest observers have, the least among equals;
    -1 where none has one."""
    cast = near.join(of_model(labels), "oid").where("label >= 0").groupBy("idx", "label").agg(F.count("*").alias("n"))
    best = cast.groupBy("idx").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("label"))).alias("b")).select("idx", F.col("b.label").alias("label"))
    return near.select("idx").distinct().join(best, "idx", "left").select("idx", F.coalesce("label", F.lit(-1)).alias("label"))


def handle_outliers(scored: DataFrame, threshold: float, handling: bool) -> DataFrame:
    """With ``handling``, labels of rows whose score is above the threshold become -1."""
    return scored.withColumn("label", F.when(F.lit(handling) & (F.col("score") > threshold), -1).otherwise(F.col("label")))


def color_observations(near: DataFrame, point_labels: DataFrame, now: DataFrame, horizon: float) -> DataFrame:
    """(oid, color, weight): faded counts of the labels of the points that hit an observer."""
    hits = near.join(point_labels.withColumnRenamed("label", "color"), "idx").crossJoin(F.broadcast(now))
    return hits.groupBy("oid", "color").agg(F.sum(decay.weight(F.col("now"), F.col("t"), horizon)).alias("weight"))


def color_distribution(colors: DataFrame) -> DataFrame:
    """(oid, color, share): weights over the observer's sum."""
    whole = colors.groupBy("oid").agg(F.sum("weight").alias("whole"))
    return colors.join(whole, "oid").select("oid", "color", (F.col("weight") / F.nullif(F.col("whole"), F.lit(0.0))).alias("share"))


def fourier_sums(near: DataFrame, now: DataFrame, horizon: float, bins: int, max_freq: float) -> DataFrame:
    """(oid, bin, re, im): faded sums of cos and sin of each hit's phase, for a grid of frequencies
    from 0 to ``max_freq``: what the temporal-pattern model knows of an observer."""
    hits = near.crossJoin(F.broadcast(now)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    phase = F.lit(float(max_freq)) * F.col("bin") / F.lit(float(max(1, bins - 1))) * F.col("t")
    w = decay.weight(F.col("now"), F.col("t"), horizon)
    return hits.groupBy("oid", "bin").agg(F.sum(w * F.cos(phase)).alias("re"), F.sum(w * F.sin(phase)).alias("im"))


def patterns(sums: DataFrame, bins: int, max_freq: float, phases: int) -> DataFrame:
    """(oid, step, phase, density): the Fourier sums of each observer turned back into how dense its
    hits are over one period, on a grid of ``phases`` times. A steady observer has density 1
    throughout. The period is that of the lowest frequency above 0."""
    if bins < 2 or max_freq <= 0:
        raise ValueError("a pattern needs a frequency above 0")
    base = float(max_freq) / (bins - 1)
    whole = sums.groupBy("oid").agg(F.max(F.when(F.col("bin") == 0, F.col("re"))).alias("whole"), F.collect_list(F.when(F.col("bin") > 0, F.struct("bin", "re", "im"))).alias("waves"))
    grid = whole.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(phases - 1)))).withColumn("phase", F.col("step") * F.lit(2 * math.pi / base / phases))
    turn = lambda w: F.lit(base) * w["bin"] * F.col("phase")
    swing = F.aggregate("waves", F.lit(0.0), lambda s, w: s + w["re"] * F.cos(turn(w)) + w["im"] * F.sin(turn(w)))
    return grid.select("oid", "step", "phase", ((F.col("whole") + 2 * swing) / F.nullif(F.col("whole"), F.lit(0.0))).alias("density"))


def peaks(pattern: DataFrame) -> DataFrame:
    """(oid, phase, density): the time within the period at which each observer is hit most, the
    earliest among equals."""
    best = F.max_by(F.struct("phase", "density"), F.struct(F.round("density", 9), -F.col("step"))).alias("best")
    return pattern.groupBy("oid").agg(best).select("oid", "best.phase", "best.density")
