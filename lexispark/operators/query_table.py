"""Queries as rows: a table of queries is answered by one plan whose size does not depend on how many there are.

Each query is parsed in a task to a postfix program over its leaves (words, and phrases or windows). Leaves are joined with the bitmaps of
their documents, a row of 64 ids each; the words of a query meet its program, which runs on integers. Phrases and windows are found once
each for all queries that have them, by the positions of their terms; their documents are bitmaps like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators import bitmaps
from lexispark.operators.index import Index
from lexispark.operators.search import PAGE, described
from lexispark.plans import query as Q
from lexispark.storage import cut

#: Leaves of all queries together that are broadcast (about 50 bytes each); beyond, they are joined by a shuffle.
BROADCAST_LEAVES = 200_000
PARSED = "program array<int>, leaves array<struct<slot: int, leaf: string, terms: array<string>, distance: int>>, error string"
#: The leaf that stands for all documents; no term or phrase is named like it.
EVERYONE = ""


def parsed(queries: DataFrame, dialect: str = "F") -> DataFrame:
    """(query_id, program, leaves, error) of (query_id, query). A query that cannot be read has an error and no program."""

    def read(text: str | None) -> dict:
        try:
            node = Q.parse(text or "", dialect)
            program, leaves = Q.postfix(node)
            rows = [{"slot": k, "leaf": Q.leaf_name(x), "terms": list(x.terms) if isinstance(x, Q.Near) else [x.term], "distance": x.distance if isinstance(x, Q.Near) else 0} for k, x in enumerate(leaves)]
            if Q.matches_without_terms(node):
                program += [len(rows), Q.AND]
                rows.append({"slot": len(rows), "leaf": EVERYONE, "terms": [], "distance": 0})
            return {"program": program, "leaves": rows, "error": None}
        except Exception as e:  # noqa: BLE001  recorded for its query, as others go on
            return {"program": [], "leaves": [], "error": str(e)}

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([read(t) for t in texts], columns=["program", "leaves", "error"])

    return queries.select("query_id", run(F.col("query")).alias("p")).select("query_id", "p.*")


def near_hit(parts: Column, distance: Column) -> Column:
    """Whether positions of terms in order (an array of ascending arrays, two at least) stand side by side, or in order within the distance; as
    plans.query.near_column, for any number of terms."""
    n = F.size(parts)
    rest = F.transform(parts, lambda p, k: F.transform(p, lambda x: x - k))
    adjacent = F.size(F.aggregate(F.slice(rest, F.lit(2), n), F.get(rest, F.lit(0)), lambda a, p: F.array_intersect(a, p))) > 0
    events = F.array_sort(F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: F.struct(x.alias("at"), (-k).alias("term"))))))
    begin = F.struct(F.array_repeat(F.lit(None).cast("int"), n - 1).alias("starts"), F.lit(False).alias("hit"))

    def step(state: Column, e: Column) -> Column:
        k = -e["term"]
        start = F.when(k == 0, e["at"]).otherwise(F.get(state["starts"], k - 1))
        kept = F.transform(state["starts"], lambda v, i: F.when(i == k, F.greatest(v, start)).otherwise(v))
        done = (k == n - 1) & F.coalesce(e["at"] - start <= distance, F.lit(False))
        return F.struct(kept.alias("starts"), (state["hit"] | done).alias("hit"))

    ordered = F.aggregate(events, begin, step, lambda s: s["hit"])
    return F.when(distance == n, adjacent).when(distance < n - 1, F.lit(False)).otherwise(ordered)


def _phrases(index: Index, leaves: DataFrame) -> DataFrame:
    """(leaf, doc_id) of documents that hold phrases and windows (leaf, terms, distance), each leaf once."""
    parts = leaves.select("leaf", "distance", F.size("terms").alias("n"), F.posexplode("terms").alias("k", "term"))
    placed = index.postings.select("term", "doc_id", "positions").join(parts, "term")
    at = placed.groupBy("leaf", "doc_id").agg(F.collect_list(F.struct("k", "positions")).alias("at"), F.first("n").alias("n"), F.first("distance").alias("distance"))
    # Of rows that repeat a document, the largest list of a term counts.
    lists = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array_max(F.transform(F.filter("at", lambda e: e["k"] == k), lambda e: e["positions"])))
    whole = at.select("leaf", "doc_id", "distance", lists.alias("lists")).where(F.forall("lists", lambda p: p.isNotNull()))
    return whole.where(near_hit(F.col("lists"), F.col("distance"))).select("leaf", "doc_id")


def _run(program: Column, bits: Column) -> Column:
    """The value of a postfix program; bits: map of slot to word."""

    def step(stack: Column, op: Column) -> Column:
        n = F.size(stack)
        top, under = F.get(stack, n - 1), F.get(stack, n - 2)

        def put(dropped: int, value: Column) -> Column:
            return F.array_append(F.slice(stack, F.lit(1), F.greatest(n - dropped, F.lit(0))), value)

        two = F.when(op == Q.AND, top.bitwiseAND(under)).otherwise(top.bitwiseOR(under))
        one = F.when(op == Q.NOT, put(1, F.bitwise_not(top))).when(op == Q.NOTHING, put(0, F.lit(0).cast("long"))).otherwise(put(2, two))
        return F.when(op >= 0, put(0, F.coalesce(F.try_element_at(bits, op), F.lit(0).cast("long")))).otherwise(one)

    return F.aggregate(program, F.array().cast("array<bigint>"), step, lambda s: F.get(s, F.lit(0)))


def evaluate(index: Index, programs: DataFrame) -> DataFrame:
    """(query_id, word, bits): the documents of each query of a written table of ``parsed``."""
    leaves = programs.select("query_id", F.explode("leaves").alias("l")).select("query_id", "l.*")
    small = (programs.agg(F.sum(F.size("leaves"))).first()[0] or 0) <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda df: df)
    once = leaves.where(F.col("leaf") != EVERYONE).dropDuplicates(["leaf"])
    words = once.where(F.size("terms") == 1).select(F.col("leaf").alias("term"))
    plain = index.postings.select("term", "doc_id").join(hint(words), "term").select(F.col("term").alias("leaf"), "doc_id")
    everyone = index.docs.select(F.lit(EVERYONE).alias("leaf"), "doc_id")
    if leaves.where(F.col("leaf") == EVERYONE).isEmpty():
        everyone = everyone.limit(0)
    sets = bitmaps.bitmaps(plain.unionByName(_phrases(index, once.where(F.size("terms") > 1))).unionByName(everyone), "leaf")
    # Folded first: a frequent word of many queries is copied by 64 documents, not one by one.
    cells = sets.join(hint(leaves.select("query_id", "slot", "leaf")), "leaf").groupBy("query_id", "word").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("bits"))
    run = _run(F.col("program"), F.col("bits"))
    return cells.join(hint(programs.where("error is null").select("query_id", "program")), "query_id").select("query_id", "word", run.alias("bits")).where("bits <> 0")


def batch(index: Index, queries: DataFrame, dialect: str = "F", size: int | None = None) -> DataFrame:
    """(query_id, hits, rank, doc_id, title, url, line) of the first hits of each query of (query_id, query); as search.batch, for any number."""
    size = PAGE[dialect] if size is None else size
    sets = cut(evaluate(index, cut(parsed(queries, dialect), "programs")), "hits")
    counts = bitmaps.size(sets, "query_id").withColumnRenamed("n", "hits")
    # A word holds one hit at least, so the first words of a query are enough for its page.
    early = F.row_number().over(Window.partitionBy("query_id").orderBy("word"))
    ids = bitmaps.members(sets.withColumn("_w", early).where(F.col("_w") <= size).drop("_w"), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    first = ids.withColumn("rank", place).where(F.col("rank") <= size)
    return described(first.join(counts, "query_id"), index, True).select("query_id", "hits", "rank", "doc_id", "title", "url", "line")
