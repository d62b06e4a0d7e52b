"""Choosing observers: repeatable sampling, a time-biased reservoir, and the capacity of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime above any model's size; ranks of rows are remainders by it.
MODULUS, STEP = 1_000_003, 7919
#: Hexadecimal digits of a digest that make a chance: 52 bits, which a double holds exactly.
DIGITS = 13


def rank_of(idx: Column, seed: int = 13) -> Column:
    """A repeatable pseudo-random number of a row, by integer arithmetic."""
    return F.pmod(F.pmod(idx, F.lit(MODULUS)) * F.lit(STEP) + F.lit(seed), F.lit(MODULUS))


def chance(idx: Column, seed: int = 0) -> Column:
    """A number above 0 and below 1 for each index: a seeded digest of it, whatever partition it is in."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), idx.cast("string")))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def priority(idx: Column, t: Column, horizon: float, seed: int = 0) -> Column:
    """The key of a reservoir in which a row weighs exp(t / horizon), so that newer rows are likelier.

    A row with weight w and chance u has the key -ln(u) / w (Efraimidis and Spirakis, 2006); its
    logarithm, ln(-ln(u)) - t / horizon, orders rows alike. It does not depend on the present time,
    so keys that were taken earlier stay comparable and reservoirs can be merged.
    """
    return F.log(-F.log(chance(idx, seed))) - t / F.lit(float(horizon))


def reservoir(points: DataFrame, k: int, horizon: float, seed: int = 0) -> DataFrame:
    """The ``k`` rows of least key, with their ``priority``: a sample without replacement. Each
    partition hands on its own k rows at most, and what is drawn does not depend on partitions."""
    keyed = points.withColumn("priority", priority(F.col("idx"), F.col("t"), horizon, seed))
    return keyed.orderBy("priority", "idx").limit(k)


def merged(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The reservoir of two streams' rows, from their reservoirs (of the same horizon and seed)."""
    return a.unionByName(b).orderBy("priority", "idx").limit(k)


def first_observers(points: DataFrame, k: int, seed: int = 13) -> DataFrame:
    """The ``k`` rows of lowest rank, as observers (oid, time_added, features)."""
    return points.orderBy(rank_of(F.col("idx"), seed), "idx").limit(k).select(F.col("idx").alias("oid"), F.col("t").alias("time_added"), "features")


def sampled(points: DataFrame, rate: float, seed: int = 13, random: bool = False) -> DataFrame:
    """Rows chosen with probability ``rate``, by rank or (``random``) by a seeded digest of their index."""
    chosen = chance(F.col("idx"), seed) < rate if random else rank_of(F.col("idx"), seed) < int(rate * MODULUS)
    return points.where(chosen)


def replaceable(observers: DataFrame, n: int) -> DataFrame:
    """The ``n`` observers that go first: lowest faded count over age; new ones go last."""
    return observers.orderBy(F.col("av_observations").asc_nulls_last(), "oid").limit(n)
