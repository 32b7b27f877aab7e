"""Tables between steps: written once to a folder that all executors see, so that a lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set a local session gets one of its own; on a cluster that is an error,
    as each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path for one table. Those of an application lie in one folder, which clear() removes."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as Parquet and read it back: a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application's cut() wrote; results that still have to be read from there must be saved before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
