"""Measures of a stream that keep up with it: mergeable counts for each event-time window.

``cells`` counts rows by (window, truth, label, score); counts of parts of a stream add up
(``merged``), and every measure is read from them: the adjusted Rand index from their sums by truth
and label, ROC AUC from those by score, mean + 3 sigma from their moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

KEYS = ["start", "truth", "label", "score"]
_PAIRS = lambda n: n * (n - 1) / F.lit(2.0)


def cells(scored: DataFrame, ts: str, width: str, digits: int = 6) -> DataFrame:
    """(start, truth, label, score, n) from rows (``ts``, truth, label, score), batch or stream; scores
    are rounded to ``digits``. Rows without a score count with a null one."""
    rows = scored.withColumn("score", F.round("score", digits))
    counted = rows.groupBy(F.window(ts, width).alias("w"), "truth", "label", "score").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "truth", "label", "score", "n")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells of two streams together."""
    return a.unionByName(b).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def adjusted_rand(counts: DataFrame) -> DataFrame:
    """(start, ari) of truth and label in each window; 1 where both are constant."""
    table = counts.groupBy("start", "truth", "label").agg(F.sum("n").cast("double").alias("n"))
    both = table.groupBy("start").agg(F.sum(_PAIRS(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    sides = [table.groupBy("start", by).agg(F.sum("n").alias("n")).groupBy("start").agg(F.sum(_PAIRS(F.col("n"))).alias(name)) for by, name in (("truth", "a"), ("label", "b"))]
    one = both.join(sides[0], "start").join(sides[1], "start")
    expected = F.col("a") * F.col("b") / F.nullif(_PAIRS(F.col("total")), F.lit(0.0))
    return one.select("start", F.coalesce((F.col("s") - expected) / F.nullif((F.col("a") + F.col("b")) / 2 - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def threshold(counts: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(start, threshold): mean + ``sigmas`` standard deviations of the scores of each window."""
    n, x = F.col("n"), F.col("score")
    moments = counts.where("score is not null").groupBy("start").agg(F.sum(n).alias("n"), F.sum(n * x).alias("s"), F.sum(n * x * x).alias("q"))
    mean = F.col("s") / F.col("n")
    return moments.select("start", (mean + F.lit(float(sigmas)) * F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))).alias("threshold"))


def auc(counts: DataFrame, positive: Column) -> DataFrame:
    """(start, auc) of the scores of each window against ``positive``, a condition on the truth; null
    where it has one class only.

    Scores are range-partitioned within their windows, summed inside a partition and added to the
    sums of the partitions before it, so that a window of very many scores is no single task.
    """
    by = counts.where("score is not null").groupBy("start", "score").agg(F.sum(F.when(positive, F.col("n")).otherwise(0)).cast("double").alias("pos"), F.sum("n").cast("double").alias("n"))
    placed = materialize(by.repartitionByRange("start", "score").withColumn("part", F.spark_partition_id()), "window_scores")
    sums = placed.groupBy("start", "part").agg(F.sum("n").alias("m"))  # a row for each partition and its windows
    below = sums.select("start", "part", (F.sum("m").over(Window.partitionBy("start").orderBy("part")) - F.col("m")).alias("below"))
    inside = Window.partitionBy("start", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("below") + F.sum("n").over(inside) - (F.col("n") - 1) / 2
    whole = placed.join(below, ["start", "part"]).withColumn("rank", rank).groupBy("start").agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return whole.select("start", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))).alias("auc"))


def measures(counts: DataFrame, positive: Column) -> DataFrame:
    """(start, n, ari, auc, threshold) of each window."""
    sizes = counts.groupBy("start").agg(F.sum("n").alias("n"))
    return sizes.join(adjusted_rand(counts), "start").join(auc(counts, positive), "start", "left").join(threshold(counts), "start", "left")
