"""Searches over an index: boolean ones by bitmaps, those with phrases and windows by one grouping of postings by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators import bitmaps
from lexispark.operators.index import Index
from lexispark.plans import query as Q

#: Hits on a page, by dialect.
PAGE = {"F": 10, "B": 50}


def _by_document(index: Index, terms: list[str], placed: set[str], all_documents: bool) -> tuple[DataFrame, dict[str, Column]]:
    """One row for each document with a column a term, null where it has none of it: the positions of the ``placed`` terms, whether it
    is there of others, of which positions are not read. Of rows that repeat a document, the largest list of a term counts."""
    plain = [t for t in terms if t not in placed]
    rows = index.lookup(sorted(placed)).select("doc_id", "term", "positions")
    if plain:
        rows = rows.unionByName(index.ids(plain).withColumn("positions", F.lit(None).cast("array<int>")))
    entries = F.collect_list(F.when(F.col("positions").isNotNull(), F.struct("term", "positions"))).alias("at")
    found = rows.groupBy("doc_id").agg(entries, *(F.max(F.when(F.col("term") == t, True)).alias(f"has{k}") for k, t in enumerate(plain)))

    def of(term: str) -> Column:
        return F.array_max(F.transform(F.filter("at", lambda e: e["term"] == term), lambda e: e["positions"]))

    found = found.select("doc_id", *(of(t).alias(f"at{k}") for k, t in enumerate(sorted(placed))), *(f"has{k}" for k in range(len(plain))))
    if all_documents:
        found = index.docs.select("doc_id").distinct().join(found, "doc_id", "left")
    return found, {t: F.col(f"at{k}") for k, t in enumerate(sorted(placed))} | {t: F.col(f"has{k}") for k, t in enumerate(plain)}


def _bits(index: Index, node: Q.Node) -> DataFrame:
    return bitmaps.evaluate(node, index.ids(sorted(Q.terms_of(node))), index.docs)


def _search(index: Index, node: Q.Node) -> DataFrame:
    placed = Q.placed_terms(node)
    if not placed:
        return bitmaps.members(_bits(index, node))
    everyone = Q.matches_without_terms(node)
    found, columns = _by_document(index, sorted(Q.terms_of(node)), placed, everyone)
    return found.where(Q.to_column(node, columns)).select("doc_id")


def search(index: Index, query: str, dialect: str = "F") -> DataFrame:
    """(doc_id) of all documents that match, each once. Without phrases and windows by bitmaps, and no positions are read."""
    return _search(index, Q.parse(query, dialect))


def hit_count(index: Index, query: str, dialect: str = "F") -> DataFrame:
    node = Q.parse(query, dialect)
    if not Q.placed_terms(node):
        return bitmaps.size(_bits(index, node)).select(F.col("n").alias("hits"))
    return _search(index, node).agg(F.count(F.lit(1)).alias("hits"))


#: Ids that the first range of a page spans at least.
LEAST_RANGE = 4096


def first_ids(index: Index, query: str, dialect: str, n: int) -> list[int]:
    """The n smallest ids that match, in order. Ranges of ids are searched one after another, each twice as wide as the one before, until enough
    are found; the first one is as wide as the most frequent term makes likely to suffice."""
    node = Q.parse(query, dialect)
    terms = sorted(Q.terms_of(node))
    if Q.matches_without_terms(node):
        bounds = index.docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).first()
    else:
        known = index.dictionary.where(F.col("term").isin(terms))
        bounds = known.agg(F.min("first_doc").alias("a"), F.max("last_doc").alias("z"), F.max("doc_count").alias("n")).first()
    if n <= 0 or bounds["a"] is None:
        return []
    found: list[int] = []
    at, last = bounds["a"], bounds["z"]
    width = max(LEAST_RANGE, 2 * n * (last - at + 1) // max(1, bounds["n"]))
    while at <= last and len(found) < n:
        part = _search(index.within(at, at + width), node)
        found += [r["doc_id"] for r in part.orderBy("doc_id").limit(n - len(found)).collect()]
        at, width = at + width, 2 * width
    return found


def page(index: Index, query: str, dialect: str = "F", size: int | None = None, offset: int = 0) -> DataFrame:
    """(rank, doc_id, title, url, line) of a page of hits in order of their ids; titles are looked up for these alone."""
    size = PAGE[dialect] if size is None else size
    ids = first_ids(index, query, dialect, offset + size)[offset:]
    ranked = index.docs.sparkSession.createDataFrame([(i, offset + k) for k, i in enumerate(ids, 1)], "doc_id long, rank int")
    return described(F.broadcast(ranked), Index(index.docs.where(F.col("doc_id").isin(ids)), index.postings, index.dictionary)).select("rank", "doc_id", "title", "url", "line")


def described(hits: DataFrame, index: Index, default_title: bool = False) -> DataFrame:
    described = hits.join(index.docs, "doc_id")
    return described.withColumn("line", F.format_string("%s (%s)", title_or_default(F.col("title")) if default_title else F.col("title"), "url"))


def batch(index: Index, queries: dict[int, str], dialect: str = "F", size: int | None = None) -> DataFrame:
    """(query_id, hits, rank, doc_id, title, url, line): the first hits of several queries, over one grouping of all their postings.
    Lines say so where a document has no title."""
    size = PAGE[dialect] if size is None else size
    nodes = {i: Q.parse(q, dialect) for i, q in queries.items()}
    terms = sorted(set().union(*(Q.terms_of(n) for n in nodes.values())) if nodes else [])
    placed = set().union(*(Q.placed_terms(n) for n in nodes.values())) if nodes else set()
    found, positions = _by_document(index, terms, placed, any(Q.matches_without_terms(n) for n in nodes.values()))
    cells = [F.struct(F.lit(i).alias("query_id"), Q.to_column(n, positions).alias("hit")) for i, n in nodes.items()]
    hits = found.select("doc_id", F.explode(F.filter(F.array(*cells), lambda x: x["hit"])).alias("c")).select("doc_id", "c.query_id")
    # Ranks keep a page of each query before the shuffle; counts are partial sums.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    ranked = hits.withColumn("rank", place).where(F.col("rank") <= size)
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return described(ranked.join(F.broadcast(counts), "query_id"), index, True).select("query_id", "hits", "rank", "doc_id", "title", "url", "line")


def run_file(index: Index, lines: list[str], dialect: str = "F") -> tuple[DataFrame, dict[int, str]]:
    """A query file, blank lines skipped: the batch of those that can be read, and the errors of the others by number."""
    good, errors = {}, {}
    for i, line in enumerate((x.strip() for x in lines if x.strip()), 1):
        try:
            Q.parse(line, dialect)
            good[i] = line
        except Exception as e:  # noqa: BLE001  recorded for its query, as others go on
            errors[i] = str(e)
    return batch(index, good, dialect), errors


def title_or_default(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("No Title"))


def report(index: Index, lines: DataFrame, path: str, dialect: str = "F", size: int | None = None) -> None:
    """Answer a file of queries (line_no, value), of any number, and write the answers as text in its order: for each query its text, its
    number of hits or what is wrong with it, the first hits by rank, and an empty line."""
    from lexispark.operators import query_table
    from lexispark.storage import cut

    asked = cut(lines.where(F.trim("value") != "").select(F.col("line_no").alias("query_id"), F.trim("value").alias("query")), "queries")
    programs = query_table.parsed(asked, dialect)
    found = cut(query_table.batch(index, asked, dialect, size), "answers")
    hits = found.groupBy("query_id").agg(F.max("hits").alias("hits"))
    head = asked.join(programs.select("query_id", "error"), "query_id").join(hits, "query_id", "left")
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), "error")).otherwise(F.format_string("Found %d docs.", F.coalesce("hits", F.lit(0))))
    texts = F.array(F.struct(F.lit(-2).alias("k"), F.concat(F.lit("Query: "), "query").alias("line")), F.struct(F.lit(-1).alias("k"), said.alias("line")), F.struct(F.lit(1 << 30).alias("k"), F.lit("").alias("line")))
    rows = head.select("query_id", F.inline(texts)).union(found.select("query_id", F.col("rank").alias("k"), F.format_string("%d. %s", "rank", "line").alias("line")))
    rows.repartitionByRange("query_id", "k").sortWithinPartitions("query_id", "k").select("line").write.mode("overwrite").text(path)
