"""Thresholds and measures of clusterings and scores, as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def three_sigma(scores: DataFrame, score: str = "score", sigmas: float = 3.0) -> DataFrame:
    """One row (threshold): mean + sigmas * population standard deviation."""
    return scores.agg((F.avg(score) + F.lit(float(sigmas)) * F.stddev_pop(score)).alias("threshold"))


def overwrite_outliers(scores: DataFrame, label: str = "label", score: str = "score", sigmas: float = 3.0) -> DataFrame:
    """Labels of rows above the threshold become -1. The threshold is one row and is broadcast."""
    limit = three_sigma(scores, score, sigmas)
    return scores.crossJoin(F.broadcast(limit)).withColumn(label, F.when(F.col(score) > F.col("threshold"), -1).otherwise(F.col(label))).drop("threshold")


def dense_code(df: DataFrame, label: str = "label", out: str = "code") -> DataFrame:
    """Sorted distinct labels as 0, 1, ..., minus one. Only the distinct labels are ranked."""
    codes = df.select(label).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 2).cast("int"))
    return df.join(codes, label)


def _pairs(n: Column) -> Column:
    return n * (n - 1) / F.lit(2.0)


def adjusted_rand_index(df: DataFrame, truth: str, label: str) -> DataFrame:
    """One row (ari). The contingency table is aggregated once and summed three ways."""
    cells = df.groupBy(F.col(truth).alias("y"), F.col(label).alias("p")).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    rows = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    cols = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    one = both.crossJoin(rows).crossJoin(cols)  # single rows
    expected = F.col("a") * F.col("b") / F.nullif(_pairs(F.col("total")), F.lit(0.0))
    most = (F.col("a") + F.col("b")) / 2
    return one.select(F.coalesce((F.col("s") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def roc_auc(df: DataFrame, truth: Column, score: str = "score") -> DataFrame:
    """One row (auc), by ranks with ties averaged.

    Rows are first counted by score; distinct scores are range-partitioned by splitters that Spark
    samples, summed inside their partition and added to the sums of the partitions before it, so
    that no task holds more than its share, however the scores lie.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(truth, 1.0).otherwise(0.0)).alias("pos"), F.count("*").cast("double").alias("n"))
    placed = materialize(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "scores")
    sums = placed.groupBy("part").agg(F.sum("n").alias("in_part"))
    below = sums.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("below"))  # a row for each partition
    inside = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(F.broadcast(below), "part").withColumn("upto", F.col("below") + F.sum("n").over(inside))
    rank = F.col("upto") - (F.col("n") - 1) / 2
    sums = ranked.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))).alias("auc"))
