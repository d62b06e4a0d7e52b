"""Column helpers, joins of hot keys and distributed connected components; scratch tables are those
of the engine, below the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import clean, delete, materialize, new_path, scratch_root

__all__ = ["bounded_batches", "clean", "column", "connected_components", "crc_fold", "delete", "empty", "fresh", "materialize", "new_path", "scratch_root", "shuffle_width", "sliced_join"]


def column(name: str):
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, the natural number of slices for a hot group."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the bytes of an Arrow batch, unless the session already does: batches are bounded by
    rows otherwise, and rows hold whole texts. Affects memory only, never results."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def crc_fold(id_column, folds: int):
    """``crc32(id as text) mod folds``: a fixed split that any engine can repeat."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


#: Slices of a key's rows, so that a key of very many does not meet them in one task.
SALTS = 8


def sliced_join(rows: DataFrame, of_key: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with the one row that ``of_key`` has for a key, dealt by key and a slice of ``by``."""
    sliced = of_key.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_slice", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(sliced, [key, "_slice"]).drop("_slice")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b): component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is one
    aggregation, combined before its shuffle, and one join on the node and a slice of its
    neighbours. Each round is written to the shared folder. The rounds grow as the logarithm of the
    nodes squared at most; 60 are far beyond any table, more raise an error and drop nothing.
    """

    def written(table: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        table = table.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash"))
        return materialize(table, "edges"), seen.get

    work, state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds if state["n"] else 0):
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sliced_join(both, low, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        joined = sliced_join(large, large.groupBy("a").agg(F.min("b").alias("m")), "a", "b")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after, now = written(small)
        delete(work)
        work = after
        if now == state:
            break
        state = now
    else:
        if state["n"]:
            raise RuntimeError("components have not settled")
    pairs = work.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = work.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return materialize(pairs.unionByName(roots), "components")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
