"""``python -m lexispark INDEX QUERIES OUT``: answer a text file of queries from a stored index; ``--dialect B``, ``--size N``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexispark.operators import index, search
from lexispark.sources import readers


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexispark")
    parser.add_argument("index")
    parser.add_argument("queries")
    parser.add_argument("out")
    parser.add_argument("--dialect", default="F", choices=["F", "B"])
    parser.add_argument("--size", type=int)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    search.report(index.load(spark, given.index), readers.numbered_lines(spark, given.queries), given.out, given.dialect, given.size)


if __name__ == "__main__":
    main()
