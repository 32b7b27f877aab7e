"""Tokens, stems and positions of texts as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.porter import sql_steps, stem

_RUN = re.compile("[0-9A-Za-z]+")


def tokenize_text(text: str | None) -> list[str]:
    return [w.lower() for w in _RUN.findall(text or "")]


def stem_text(text: str | None) -> list[str]:
    return [stem(w) for w in tokenize_text(text)]


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased after they are cut out: other letters separate, and never fold to ASCII."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))


def stem_native(words: str) -> Column:
    """Stems of an array column of words by JVM expressions alone; one transform a step keeps expressions small."""
    sql = words
    for step in sql_steps():
        sql = f"transform({sql}, w -> {step})"
    return F.expr(sql)


def stems(text: Column) -> Column:
    """array<string> of stems in order. A worker remembers the words that it has stemmed, so a text crosses to Python once and
    nothing is shuffled; repeated words cost a lookup."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([stem_text(t) for t in texts], dtype=object)

    return run(text)


def postings_of(text: str | None, wanted: frozenset[str] | None = None) -> dict[str, list[int]]:
    """Positions of each term of a text, or of the wanted ones."""
    at: dict[str, list[int]] = {}
    for i, s in enumerate(stem_text(text)):
        if wanted is None or s in wanted:
            at.setdefault(s, []).append(i)
    return at
