"""Term frequencies of a stream of texts, kept in Spark's state store and written as they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.functions.text import stems


def counts(texts: DataFrame) -> DataFrame:
    """(term, freq) of a stream of texts so far; map tasks count before the shuffle, and the state holds a number a term."""
    return texts.where(F.col("text") != "").select(F.explode(stems(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def start(texts: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Count and write what changes. Each batch has a folder of its own, so one that comes again after a restart replaces itself."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts(texts).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq) as of the last batch; frequencies only grow."""
    return spark.read.schema("term string, freq long, batch int").parquet(path).groupBy("term").agg(F.max("freq").alias("freq"))
