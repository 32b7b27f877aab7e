"""A training corpus from raw documents: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes all that its predecessor kept, which run() writes as Parquet to the shared folder and reads again.

Defined results: a null or empty text, or one without a letter, has no language and goes; a null source is a source of its own; a
very long text is read whole by every stage; of repeated rows, of rows of one doc_id, of copies and of near duplicates one stays, the
one of the smallest doc_id, and rows without a doc_id only where no row with one is like them; an empty table gives no
rows; further columns of documents reach packing whatever their names, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from lexispark.llm.common import cut, one_row_an_id, ship, table, unused

#: SQL cannot express the classifier, the alignment or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near enough to a language's centroids."""
    ship(spark)
    model, p = language_id.fit(docs), unused(docs.columns, "_found")
    return docs.withColumn(p, language_id.predict(F.col("text"), model)).where(F.col(p)["accepted"]).drop(p)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that too many documents of their source hold."""
    cleaned = line_dedup.drop_boilerplate(docs, min_line_pages=line_dedup.LINE_PAGES, counts=None)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates. Rows of one doc_id are one document."""
    ship(spark)
    k = unused(docs.columns, "_key")
    # A row without an id is known by its text, by a number above all ids.
    by_text = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), by_text))
    one = one_row_an_id(keyed, k)
    classes = ngram_join.near_duplicates(one, key=k)
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(k))
    return one.join(gone, k, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, decontaminate.prepare(table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    import public_tokenizers as P

    ship(spark)
    return packing.pack_documents(docs, P.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
