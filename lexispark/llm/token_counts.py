"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Only the length of each document leaves the tokenizing task; documents are summed by length before the shuffle, and
suffix sums run in two levels (blocks of lengths, then lengths inside a block), so no task sees the whole histogram.

Defined results: a null text has 0 tokens, as has an empty one; repeated rows count each; an empty table gives no rows;
further columns are ignored. Whole texts are encoded, never prefixes; long runs of white space, on which the encoder's pattern is slow or fails,
are encoded as the one piece that the pattern makes of them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths in one block of the two-level suffix sum.
BLOCK = 1024
_encoders: dict = {}
#: A run of white space (as the pattern has it) that is taken out of a text before encoding, as the pattern takes its square in time.
_LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{64,}")


def encoder(path: str, pattern: str):
    """One tiktoken encoding for each file in a Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_ids(encoding, text: str) -> int:
    """How many ids encode_ordinary gives, for texts of any length.

    The pattern makes one piece of a run of white space, less its last character where another character follows: that one belongs
    to what comes next.
    """
    total, at = 0, 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:] if at else text))


def encoded_length(text: Column, path: str, pattern: str) -> Column:
    """Number of ids of the whole text; special-token strings in it are ordinary text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = encoder(path, pattern)
        for texts in batches:
            yield pd.Series([count_ids(encoding, t) if t else 0 for t in texts], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, length: Column) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length."""
    return docs.select(length.alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, what a context limit of L answers.

    docs_at_least, tokens_at_least: documents of L or more tokens and their tokens. docs_total, tokens_total: of all.
    truncated_total: tokens left when every document is cut to L. share_at_most: part of the documents of at most L
    tokens, from which quantiles follow.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each block of lengths: as many as the longest document has blocks, whatever the number of documents.
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt")).select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("bd").over(every).alias("docs_total"),
        F.sum("bt").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    return h.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("share_at_most"),
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any limits, also those that no document has as its length."""
    spark = sums.sparkSession
    at = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # Each limit meets each length that occurs: the limits are the caller's list, and lengths are far fewer than documents.
    below = sums.join(F.broadcast(at), F.col("n_tokens") < F.col("context_limit"), "right")
    sums_below = below.groupBy("context_limit").agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("nd"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("nt")
    )
    total = sums.agg(F.coalesce(F.max("docs_total"), F.lit(0)).alias("docs"))
    return sums_below.join(F.broadcast(total), how="cross").select(
        "context_limit", (F.col("docs") - F.col("nd")).alias("docs_at_limit"), (F.col("nt") + F.col("context_limit") * (F.col("docs") - F.col("nd"))).alias("truncated_total")
    )


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """(probability, n_tokens): the smallest length that at least this part of the documents do not exceed."""
    exprs = [F.min(F.when(F.col("share_at_most") >= F.lit(float(p)), F.col("n_tokens"))).alias(f"q{i}") for i, p in enumerate(probabilities)]
    row = sums.agg(*exprs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.col(f"q{i}").alias("n_tokens")) for i, p in enumerate(probabilities)])))
