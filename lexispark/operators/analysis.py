"""Corpus statistics, term frequencies and rank curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import stems


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, freq) over all texts that are not empty."""
    words = docs.where(F.col("text") != "").select(F.explode(stems(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def corpus_stats(docs: DataFrame, raw: Column, text: Column) -> DataFrame:
    """Documents, and characters of raw and parsed texts, in all and on average."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.length(raw)).alias("raw_chars"),
        F.avg(F.length(raw)).alias("avg_raw_chars"),
        F.sum(F.length(text)).alias("text_chars"),
        F.avg(F.length(text)).alias("avg_text_chars"),
    )


def token_stats(counts: DataFrame) -> DataFrame:
    """Tokens and their average length, from term counts."""
    return counts.agg(F.sum("freq").alias("n_tokens"), (F.sum(F.col("freq") * F.length("term")) / F.sum("freq")).alias("avg_token_length"))


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    """Terms and their average length in bytes."""
    return dictionary.agg(F.count(F.lit(1)).alias("n_terms"), F.avg(F.octet_length("term")).alias("avg_term_length"))


def top_terms(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.col("freq").desc(), "term").limit(k)


def zipf(counts: DataFrame) -> DataFrame:
    """(rank, term, freq, zipf): frequencies by rank, ties by term, and the line of the highest frequency over the rank.

    Ranks come in two levels, as terms of one frequency are numbered apart from each other; a table of frequencies is far
    smaller than a vocabulary.
    """
    sizes = counts.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("freq", above.alias("above"), F.max("freq").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    # Terms that occur once are the largest group; their order within first letters and its sums spread it.
    part = counts.withColumn("head", F.substring("term", 1, 3))
    heads = part.groupBy("freq", "head").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("freq").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("freq", "head", earlier.alias("earlier"))
    place = F.row_number().over(Window.partitionBy("freq", "head").orderBy("term"))
    ranked = part.withColumn("place", place).join(heads, ["freq", "head"]).join(starts, "freq")
    rank = F.col("above") + F.col("earlier") + F.col("place")
    return ranked.select(rank.cast("long").alias("rank"), "term", "freq", (F.col("top") / rank).alias("zipf"))


def by_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))


def tokenizer_report(docs: DataFrame, words: Column) -> DataFrame:
    """Tokens, their average length and distinct ones of a sample."""
    return docs.select(F.explode(words).alias("w")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.avg(F.length("w")).alias("avg_token_length"), F.countDistinct("w").alias("n_unique")
    )


def first_words(docs: DataFrame, words: Column, k: int = 20) -> DataFrame:
    """(doc_id, pos, w): the first tokens of a sample, in order."""
    return docs.select("doc_id", F.posexplode(words).alias("pos", "w")).orderBy("doc_id", "pos").limit(k)


def length_difference(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(difference): average length of a token less average length of a term. Two rows of one number each meet."""
    both = token_stats(counts).select("avg_token_length").join(dictionary_stats(dictionary).select("avg_term_length"), how="cross")
    return both.select((F.col("avg_token_length") - F.col("avg_term_length")).alias("difference"))
