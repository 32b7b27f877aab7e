"""A positional inverted index as three Parquet tables: docs, postings, dictionary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.text import postings_of, stems
from lexispark.storage import cut


def corpus(rows: DataFrame, url: Column, title: Column, text: Column, doc_id: Column | None = None, limit: int = 0) -> DataFrame:
    """(doc_id, url, title, text) of rows that have a text. Without an id, ranks by url serve: an order over the whole table."""
    out = rows.where(text.isNotNull()).select(*([doc_id.alias("doc_id")] if doc_id is not None else []), url.alias("url"), title.alias("title"), text.alias("text"))
    if doc_id is None:
        out = number_documents(out)
    return out.orderBy("doc_id").limit(limit) if limit else out


def number_documents(docs: DataFrame, by: str = "url") -> DataFrame:
    """doc_id 0, 1, 2 ... in order of a unique column. Only one count for each range partition meets in one place.

    The ranges are written once: computed twice, they could be cut at other places and numbers would collide.
    """
    ranged = cut(docs.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    counts = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    numbered = ranged.withColumn("_n", inside).join(F.broadcast(starts), "_part")
    return numbered.select((F.col("_start") + F.col("_n") - 1).cast("long").alias("doc_id"), *docs.columns)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): one row for each token."""
    return docs.select("doc_id", F.posexplode(stems(F.col("text"))).alias("pos", "term"))


def postings(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, positions, tf). A document's postings come from its one row, so nothing is shuffled.

    terms: only these, as a query that scans texts needs.
    """
    wanted = None if terms is None else frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, ends, places = [], [], [0], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for term, at in postings_of(text, wanted).items():
                    names.append(term)
                    ids.append(doc_id)
                    places += at
                    ends.append(len(places))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), lists], ["term", "doc_id", "positions"])

    found = docs.select("doc_id", "text").mapInArrow(run, "term string, doc_id long, positions array<int>")
    return found.withColumn("tf", F.size("positions"))


def dictionary(posts: DataFrame) -> DataFrame:
    """(term, doc_count, freq, first_doc, last_doc): documents and occurrences of each term, and the ids between which they lie."""
    return posts.groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("tf").cast("long").alias("freq"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    #: Texts of an index that is not stored.
    texts: DataFrame | None = None

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of some terms; sorted files let Parquet skip row groups of other terms."""
        if self.texts is not None:
            return postings(self.texts, terms)
        return self.postings.where(F.col("term").isin(sorted(terms)))

    def ids(self, terms: list[str]) -> DataFrame:
        """(term, doc_id) of some terms; of a stored index, positions are not read."""
        return self.lookup(terms).select("term", "doc_id")

    def within(self, first: int, end: int) -> Index:
        """The part of documents from one id to before another. Postings of a term are sorted by document, so row groups of others are skipped."""
        inside = F.col("doc_id").between(first, end - 1)
        return Index(self.docs.where(inside), self.postings.where(inside), self.dictionary, None if self.texts is None else self.texts.where(inside))


def build(docs: DataFrame) -> Index:
    """An index that is computed when it is read."""
    posts = postings(docs)
    return Index(docs.select("doc_id", "url", "title"), posts, dictionary(posts), docs.select("doc_id", "text"))


def write(index: Index, path: str, mode: str = "overwrite") -> None:
    """Postings are ranged by term and then document: a frequent term takes several files, a rare one shares a row group.

    They are written as they come first, since ranges are found by a sample of what they cut: every text is read and stemmed once.
    """
    index.docs.write.mode(mode).parquet(f"{path}/docs")
    posts = cut(index.postings, "postings")
    dictionary(posts).sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/dictionary")
    posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).parquet(f"{path}/postings")


def load(spark: SparkSession, path: str) -> Index:
    """A stored index. Searches read from it the postings of their terms only."""
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "dictionary")))
