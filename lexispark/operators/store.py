"""A corpus in Parquet folders by key hash, of which a change rewrites only those that it touches, and batches that count exactly once.

A change stages the touched folders whole, then notes them as pending, then puts them in place by a dynamic partition overwrite, and
clears the note. Whoever writes next first puts in place what is still noted, so a crash at any point leaves the old state or the new one, never
a part. A batch has a name: its time is noted before anything else and its end after everything, so one that comes again is either done, and
changes nothing, or gets the same time and the same rows as before. One writer at a time; readers see folders change one by one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.operators import ingest

BUCKET = "_bucket"
ABOUT = "key string, buckets int, schema string"
Change = Callable[[DataFrame], DataFrame]


def _noted(spark: SparkSession, path: str, schema: str) -> list[Row]:
    """The rows of a small table of notes; none if it is not there."""
    try:
        return spark.read.schema(schema).json(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _note(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Store:
    """buckets: as many as keep one of them a fair piece of work; a bucket is files of its own, sorted by key."""

    spark: SparkSession
    path: str
    key: str
    buckets: int

    @staticmethod
    def create(docs: DataFrame, path: str, key: str = "url", buckets: int = 64) -> Store:
        spark = docs.sparkSession
        store = Store(spark, path.rstrip("/"), key, buckets)
        store._write(store._with_bucket(docs), f"{store.path}/rows")
        store._describe(docs.schema)
        return store

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        about = _noted(spark, f"{path.rstrip('/')}/about", ABOUT)
        if not about:
            raise ValueError(f"no store at {path}")
        return Store(spark, path.rstrip("/"), about[0]["key"], about[0]["buckets"])

    def _describe(self, schema: T.StructType) -> None:
        _note(self.spark, f"{self.path}/about", [(self.key, self.buckets, schema.json())], ABOUT)

    def _schema(self) -> T.StructType:
        """As noted, so that no file is opened to know it; columns that came later are null in older files."""
        return T.StructType.fromJson(json.loads(_noted(self.spark, f"{self.path}/about", ABOUT)[0]["schema"]))

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, path: str) -> None:
        """By ranges of bucket and key, so that a large bucket is several files. Other buckets stay as they are."""
        ranged = rows.repartitionByRange(BUCKET, self.key).sortWithinPartitions(BUCKET, self.key)
        ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(f"{self.path}/rows")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (key): folders without any are not read."""
        return self._touched(self._buckets_of(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _buckets_of(self, keys: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r[BUCKET] for r in self._with_bucket(keys.select(self.key)).select(BUCKET).distinct().collect())

    def _touched(self, buckets: list[int]) -> DataFrame:
        """Rows of some folders; others are not even listed."""
        schema = self._schema()
        try:
            named = ",".join(map(str, buckets))
            return self.spark.read.schema(schema).parquet(f"{self.path}/rows/{BUCKET}={{{named}}}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def recover(self) -> None:
        """Put in place what a writer that is gone had staged and noted."""
        pending = _noted(self.spark, f"{self.path}/pending", "staged string")
        for r in pending:
            self._write(self._with_bucket(self.spark.read.schema(self._schema()).parquet(f"{self.path}/{r['staged']}")), f"{self.path}/rows")
        if pending:
            _note(self.spark, f"{self.path}/pending", [], "staged string")

    def _stage(self, keys: DataFrame, change: Change, name: str) -> list[int]:
        buckets = self._buckets_of(keys)
        if buckets:
            changed, schema = change(self._touched(buckets)), self._schema()
            new = [f for f in changed.schema if f.name not in schema.names]
            if new:
                self._describe(T.StructType([*schema, *new]))
            typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in [*schema, *new]]
            changed.select(*typed).write.mode("overwrite").parquet(f"{self.path}/staged/{name}")
        return buckets

    def _put(self, name: str) -> None:
        _note(self.spark, f"{self.path}/pending", [(f"staged/{name}",)], "staged string")
        self.recover()

    def change(self, keys: DataFrame, change: Change, name: str = "change") -> list[int]:
        """Rows of the folders that hold ``keys`` become what ``change`` makes of them; it must keep all of them in their folders, as it does if it
        only changes, adds and removes rows of these keys. Returns the folders that were rewritten."""
        self.recover()
        buckets = self._stage(keys, change, name)
        if buckets:
            self._put(name)
        return buckets

    def upsert(self, new: DataFrame, order: list[str] | None = None) -> list[int]:
        return self.change(new, lambda old: ingest.upsert(old, new, self.key, order))

    def touch(self, seen: DataFrame, now: int) -> list[int]:
        return self.change(seen, lambda old: ingest.touch(old, seen, now, self.key))

    def insert_if_absent(self, new: DataFrame, order: list[str] | None = None) -> list[int]:
        return self.change(new, lambda old: ingest.insert_if_absent(old, new, self.key, order))

    def apply_batch(self, stream: str, batch: int, keys: DataFrame, change: Callable[[DataFrame, int], DataFrame], now: Callable[[], int]) -> list[int]:
        """A change that counts once, however often its batch comes. change: (rows of touched folders, time of the batch)."""
        log = f"{self.path}/log/{stream}/{batch}"
        self.recover()
        if _noted(self.spark, f"{log}/done", "at long"):
            return []
        begun = _noted(self.spark, f"{log}/begun", "at long")
        at = begun[0]["at"] if begun else now()
        if not begun:
            _note(self.spark, f"{log}/begun", [(at,)], "at long")
        # Pending until it is done: if the note of the end is lost, the same rows are put in place again.
        buckets = self._stage(keys, lambda old: change(old, at), f"{stream}-{batch}")
        if buckets:
            self._put(f"{stream}-{batch}")
        _note(self.spark, f"{log}/done", [(at,)], "at long")
        return buckets
