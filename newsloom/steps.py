"""Steps of a job that are written to the folder which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    On one machine, where a session has none, a temporary folder serves, and the session is left as it is. On a cluster
    such a folder would be another one on each machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    return _local[context.applicationId]


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/newsloom/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_own(spark)}/{what}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession) -> None:
    """Deletes this application's steps. Results that have not been computed yet read them, so this comes last."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
