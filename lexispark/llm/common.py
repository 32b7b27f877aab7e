"""What the operators share: reading a table, names that no input column has, and what a worker remembers."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.storage import cut, new_path

__all__ = ["bucketed", "buckets_for", "cut", "forget_others", "one_row_an_id", "release", "remembers", "ship", "table", "unused"]

#: What a Python worker remembers between tasks, by operator: how to forget it.
_memories: dict[str, Callable[[], None]] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by its own sys.path."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *(p for p in paths if p)])


def unused(columns: list[str], name: str) -> str:
    """``name``, or with so many underscores that no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def one_row_an_id(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with one row for each key: of several, that of the longest text. Only ids are counted, and only rows of ids that repeat
    are sorted."""
    again = cut(docs.groupBy(key).count().where("count > 1").select(key), "repeated")
    if again.isEmpty():
        return docs
    place, order = unused(docs.columns, "_place"), Window.partitionBy(key).orderBy(F.length(text).desc(), F.col(text).desc())
    one = docs.join(again, key, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return docs.join(again, key, "left_anti").unionByName(one.select(docs.columns)).select(docs.columns)


def bucketed(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """A table of df, which is dealt to n partitions by the key already, with the same n buckets: joins on the key leave it where it is, if n is not
    below the session's shuffle partitions. Its folder is the shared one."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).sortBy(key).option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that nothing refers to any more, as its periodic collection would."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets_for(total: int, per_bucket: int) -> int:
    """How many buckets keep each at about per_bucket of total."""
    return max(1, -(-int(total or 0) // per_bucket))


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """A worker that serves one operator after another must not hold the words of all of them; see forget_others."""
    _memories[owner] = forget


def forget_others(owner: str) -> None:
    """At the start of an operator's task: free what the worker remembers for other operators."""
    for name, forget in _memories.items():
        if name != owner:
            forget()
