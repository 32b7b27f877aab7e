"""The tokenizer as a table function of SQL: ``SELECT doc_id, t.* FROM docs, LATERAL terms(text) t``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import stem_text, tokenize_text


class Tokens:
    """(pos, token) of a text, lower-cased; none of a null."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(tokenize_text(text))


class Terms:
    """(pos, term) of a text, stemmed; none of a null."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate(stem_text(text))


def register(spark: SparkSession) -> None:
    """tokens(text) and terms(text). Rows cross to Python in Arrow batches; Arrow table functions proper cannot be joined laterally."""
    spark.udtf.register("tokens", F.udtf(Tokens, returnType="pos int, token string", useArrow=True))
    spark.udtf.register("terms", F.udtf(Terms, returnType="pos int, term string", useArrow=True))
