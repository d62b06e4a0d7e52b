"""Sources of points (idx, t, features) and checks of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: What a CSV of the demonstration holds.
CSV_SCHEMA = "timestamp double, f0 double, f1 double, label int"


def from_columns(df: DataFrame, idx: Column, t: Column, features: Column | list[Column], **more: Column) -> DataFrame:
    """Points from any frame; everything is cast to double."""
    vector = features if isinstance(features, Column) else F.array(*features)
    return df.select(idx.cast("bigint").alias("idx"), t.cast("double").alias("t"), vector.cast("array<double>").alias("features"), *[c.alias(n) for n, c in more.items()])


def seconds(ts: Column) -> Column:
    """A timestamp (with or without zone) as seconds since 1970."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The demonstration's CSV: (timestamp, f0, f1, label) as points with a label.

    Rows are numbered in the order of time, then of their values; equal rows have numbers of their own.
    """
    df = numbered(spark.read.schema(CSV_SCHEMA).option("header", True).csv(path), ["timestamp", "f0", "f1", "label"])
    return from_columns(df, F.col("idx"), F.col("timestamp"), [F.col("f0"), F.col("f1")], label=F.col("label"))


def numbered(df: DataFrame, by: list[str], out: str = "idx") -> DataFrame:
    """Rows with their number in the order of ``by``, from 0.

    Rows are range-partitioned, sorted and written; a number is the place in its partition plus
    the rows of the partitions before it, of which there are as many as a shuffle has partitions.
    """
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    rows = materialize(rows, "numbered")
    sums = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return rows.join(F.broadcast(before), "_part").withColumn(out, number).drop("_part", "_place", "_before")


def from_arrays(spark: SparkSession, data: np.ndarray, times: np.ndarray, first_index: int = 0) -> DataFrame:
    """Points from a matrix and a vector in memory; their lengths must agree."""
    data, times = np.asarray(data, float), np.asarray(times, float)
    if data.ndim != 2 or times.ndim != 1 or len(data) != len(times):
        raise ValueError("data must be a matrix with one row for each time")
    frame = pd.DataFrame({"idx": np.arange(first_index, first_index + len(data)), "t": times, "features": data.tolist()})
    return spark.createDataFrame(frame, "idx bigint, t double, features array<double>")


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return from_columns(df, F.col("vec_id"), F.col("vec_id"), F.col("embedding"), label=F.col("label"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers of each item, brought to like ranges; time is the day of shipping."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    idx = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return from_columns(df, idx, seconds(F.col("l_shipdate")) / 86400, [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100_000, F.col("l_discount") * 10, F.col("l_tax") * 10])


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and hour of the day of each event; time in seconds."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = seconds(F.col("ts"))
    return from_columns(df, F.col("event_id"), t, [F.col("value") / 100, F.pmod(t, F.lit(86400.0)) / 86400])


def is_valid(dimension: int | None = None) -> Column:
    """Whether a point has a time and finite numbers only, ``dimension`` of them; never null."""
    ok = F.col("t").isNotNull() & F.col("features").isNotNull() & F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok if dimension is None else ok & (F.size("features") == dimension), F.lit(False))


def valid(points: DataFrame, dimension: int | None = None) -> DataFrame:
    """Drops rows with nulls, non-finite numbers or another dimension."""
    return points.where(is_valid(dimension))


def checked(points: DataFrame, dimension: int) -> DataFrame:
    """Fails at run time on a row that ``valid`` would drop."""
    good = F.col("t").isNotNull() & (F.size("features") == dimension) & ~F.exists("features", lambda x: x.isNull() | F.isnan(x))
    return points.where(F.assert_true(F.coalesce(good, F.lit(False)), F.lit("a point has a null, or another dimension")).isNull())


def blocks(points: DataFrame, size: int, out: str = "block", idx: str = "idx") -> DataFrame:
    """Count-based tumbling blocks by row number; the last may be short."""
    return points.withColumn(out, F.floor(F.col(idx) / F.lit(size)).cast("bigint"))
