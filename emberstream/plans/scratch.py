"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; a folder of this machine only where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="emberstream-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/emberstream-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it again.

    This cuts the lineage, lets several consumers share one computation, and gives the planner
    true sizes: a small table is broadcast by Spark's own checked threshold, a large one is not.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` returned."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder, wherever Spark can write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Remove everything that this application has written to the scratch folder."""
    remove(spark, scratch_root(spark))
