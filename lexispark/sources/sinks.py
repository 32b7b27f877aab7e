"""Where rows go: snapshots of the corpus, article files and result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import web


def write_snapshot(docs: DataFrame, path: str) -> None:
    """Partitioned by source, sorted by url, so that both are pruned when read."""
    docs.sortWithinPartitions("url").write.mode("errorifexists").partitionBy("source").parquet(path)


def articles(rows: DataFrame, least_words: int = 500) -> DataFrame:
    """(name, body, metadata) of articles of (title, url, category, text) with enough words; one for each name in lower case."""
    n = web.word_count(F.col("text"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("URL: "), "url"), F.lit("Source: Wikipedia"), F.concat(F.lit("Category: "), "category"), F.lit(""), "text"
    )
    meta = F.to_json(F.struct("title", "url", "category", n.alias("word_count")))
    kept = rows.where(n >= least_words).select(web.safe_title(F.col("title")).alias("name"), head.alias("body"), meta.alias("metadata"))
    return kept.withColumn("_k", F.lower("name")).dropDuplicates(["_k"]).drop("_k")


def write_results(page: DataFrame, path: str) -> None:
    """Result lines as text, in order of query and rank."""
    keys = [c for c in ("query_id", "rank") if c in page.columns]
    page.orderBy(*keys).select("line").coalesce(1).write.text(path)
