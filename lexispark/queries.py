"""Registered queries over the given tables, each with SQL that computes the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import codec, table, text, web
from lexispark.functions.porter import sql_steps
from lexispark import storage
from lexispark.operators import analysis, bitmaps, index, ingest, query_table, search
from lexispark.operators.store import Store
from lexispark.sources import readers
from lexispark.streaming import recrawl
from lexispark.streaming import term_counts as stream_counts

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NOW = 1_700_000_000
QUERIES = {1: '"of the"', 2: "of && the && !der", 3: "crispr || license", 4: '"le de" / 4'}
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Lets Python workers import the package when the driver found it by its own path.
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *(p for p in paths if p)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    url = F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string"))
    title = F.substring(F.substring_index("text", "\n", 1), 1, 60)
    return index.corpus(d, url, title, F.col("text"), F.col("doc_id"))


_written: dict[tuple, str] = {}


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The stored index of a folder's documents; an application writes it when it first asks, and anew when their files have changed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet").select("path", "length", "modificationTime")
    state = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first()  # contents are not read
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _written:
        path = storage.new_path(spark, "index")
        index.write(index.build(_docs(spark, sf_dir)), path)
        _written[key] = path
    return index.load(spark, _written[key])


def _stemmed_sql(words: str) -> str:
    """(w0, w): words (w) of a table and their stems."""
    stemmed = f"SELECT w AS w0, w FROM (SELECT DISTINCT w FROM {words})"
    for step in sql_steps(duckdb=True):
        stemmed = f"SELECT w0, {step} AS w FROM ({stemmed})"
    return stemmed


def _terms_sql() -> str:
    """(doc_id, pos, term) of all documents in SQL."""
    stemmed = _stemmed_sql("tok")
    return f"""WITH runs AS (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z]+') AS ws FROM documents WHERE text IS NOT NULL),
tok AS MATERIALIZED (SELECT doc_id, lower(unnest(ws)) AS w, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS pos FROM runs),
voc AS MATERIALIZED ({stemmed}), terms AS MATERIALIZED (SELECT doc_id, pos, voc.w AS term FROM tok JOIN voc ON tok.w = voc.w0) """


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM terms WHERE term = '{term}')"


def _all(*words: str) -> str:
    """Documents that have all of them; a join of terms for each would be planned badly once the query is part of another."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"doc_id IN (SELECT doc_id FROM terms WHERE term IN ({listed}) GROUP BY doc_id HAVING count(DISTINCT term) = {len(set(words))})"


def _near(words: list[str], distance: int | None = None) -> str:
    joins = "p t0"
    for k in range(1, len(words)):
        step = f"t{k}.pos = t{k - 1}.pos + 1" if distance is None else f"t{k}.pos > t{k - 1}.pos AND t{k}.pos <= t0.pos + {distance}"
        joins += f" JOIN p t{k} ON t{k}.doc_id = t0.doc_id AND {step}"
    tests = [f"t{k}.term = '{w}'" for k, w in enumerate(words)]
    listed = ", ".join(f"'{w}'" for w in words)
    return f"doc_id IN (WITH p AS MATERIALIZED (SELECT * FROM terms WHERE term IN ({listed})) SELECT t0.doc_id FROM {joins} WHERE {' AND '.join(tests)})"


def _search(query: str, dialect: str = "F") -> Query:
    return lambda spark, d: search.search(_index(spark, d), query, dialect)


#: name: (query, dialect, condition in SQL)
SEARCHES = {
    "bool_term": ("license", "F", lambda: _has("licens")),
    "bool_and": ("of && the", "F", lambda: _all("of", "the")),
    "bool_implicit_and": ("of the license", "F", lambda: _all("of", "the", "licens")),
    "bool_or": ("der || que", "F", lambda: f"{_has('der')} OR {_has('que')}"),
    "bool_not": ("!of", "F", lambda: f"NOT {_has('of')}"),
    "bool_grouped": ("(der || que) && !(of && license)", "F", lambda: f"({_has('der')} OR {_has('que')}) AND NOT {_all('of', 'licens')}"),
    "bool_unknown_term": ("crispr", "F", lambda: _has("crispr")),
    "phrase_exact": ('"of the"', "F", lambda: _near(["of", "the"])),
    "phrase_no_match": ('"is that the"', "F", lambda: _near(["is", "that", "the"])),
    "near_ordered": ('"of the" / 5', "F", lambda: _near(["of", "the"], 5)),
    "near_three_terms": ('"the and of" / 5', "F", lambda: _near(["the", "and", "of"], 5)),
    "near_equals_len_is_exact": ('"of the" / 2', "F", lambda: _near(["of", "the"])),
    "near_unsatisfiable": ('"the and of" / 1', "F", lambda: "false"),
    "near_repeated_term": ('"the the" / 3', "F", lambda: _near(["the", "the"], 3)),
    "mixed_phrase_bool": ('"of the" / 5 && !der', "F", lambda: f"{_near(['of', 'the'], 5)} AND NOT {_has('der')}"),
    "dialect_b_quoted_as_and": ('"of the" / 5', "B", lambda: _all("of", "the", "5")),
    "dialect_b_double_not": ("!!der || license", "B", lambda: f"{_has('der')} OR {_has('licens')}"),
    "empty_query": ("", "F", lambda: "false"),
}


def _as_text(positions: Column | str) -> Column:
    return F.array_join(F.transform(positions, lambda p: p.cast("string")), ",")


def token_positions(spark: SparkSession, d: str) -> DataFrame:
    return index.tokens(_docs(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """By the JVM form of the stemmer."""
    words = _docs(spark, d).select(F.explode(text.tokenize(F.col("text"))).alias("word")).distinct()
    return words.withColumn("ws", F.array("word")).select("word", text.stem_native("ws")[0].alias("term"))


def term_postings(spark: SparkSession, d: str) -> DataFrame:
    return index.build(_docs(spark, d)).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    return index.build(_docs(spark, d)).postings.select("term", "doc_id", _as_text("positions").alias("positions"))


def term_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).dictionary.select("term", "doc_count")


def doc_term_freq(spark: SparkSession, d: str) -> DataFrame:
    p = _index(spark, d).postings
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").cast("long").alias("n_tokens"), F.max("tf").cast("long").alias("max_tf"))


def search_page_top10(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_index(spark, d), '"of the" / 5').withColumn("rank", F.col("rank").cast("long"))


def search_page_top50(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_index(spark, d), "of && the", "B").withColumn("rank", F.col("rank").cast("long"))


def search_page_second(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_index(spark, d), "of && the", "F", offset=10).withColumn("rank", F.col("rank").cast("long"))


def search_hit_count(spark: SparkSession, d: str) -> DataFrame:
    return search.hit_count(_index(spark, d), "!der")


def batch_queries_topk(spark: SparkSession, d: str) -> DataFrame:
    got = search.batch(_index(spark, d), QUERIES)
    return got.select(F.col("query_id").cast("long").alias("query_id"), "hits", F.col("rank").cast("long").alias("rank"), "doc_id", "line")


def query_table_topk(spark: SparkSession, d: str) -> DataFrame:
    """Four queries of the first two words of every benchmark item: both, side by side, within five, and the second or not the first."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    items = _table(spark, d, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 2)
    a, b = F.col("w")[0], F.col("w")[1]
    forms = [F.concat(a, F.lit(" && "), b), F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('"')), F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('" / 5')), F.concat(F.lit("!"), a, F.lit(" || "), b)]
    queries = items.select("item_id", F.posexplode(F.array(*forms)).alias("k", "query")).select((F.col("item_id") * 4 + F.col("k")).cast("long").alias("query_id"), "query")
    got = query_table.batch(_index(spark, d), queries)
    return got.select("query_id", "hits", F.col("rank").cast("long").alias("rank"), "doc_id", "line")


def _set(spark: SparkSession, d: str, term: str) -> DataFrame:
    return bitmaps.bitmaps(_index(spark, d).ids([term]))


def set_union(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.members(bitmaps.combine(_set(spark, d, "der"), _set(spark, d, "que"), "union"))


def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.members(bitmaps.combine(_set(spark, d, "of"), _set(spark, d, "the"), "intersect"))


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    everyone = bitmaps.bitmaps(_docs(spark, d).select("doc_id"))
    return bitmaps.members(bitmaps.combine(everyone, _set(spark, d, "of"), "difference"))


def term_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Every term's documents, 64 ids a row."""
    return bitmaps.bitmaps(_index(spark, d).postings.select("term", "doc_id"), "term").select("term", "word", F.hex("bits").alias("bits"), F.bit_count("bits").alias("n_docs"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return analysis.corpus_stats(_table(spark, d, "pages"), F.col("html"), web.html_text(F.col("html"))).select("n_docs", "raw_chars", "text_chars", F.round("avg_raw_chars", 6).alias("avg_raw_chars"), F.round("avg_text_chars", 6).alias("avg_text_chars"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Term frequencies that the stored index has."""
    return _index(spark, d).dictionary.select("term", "freq")


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return analysis.token_stats(_counts(spark, d)).select("n_tokens", F.round("avg_token_length", 6).alias("avg_token_length"))


def unique_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return analysis.dictionary_stats(_index(spark, d).dictionary).select("n_terms", F.round("avg_term_length", 6).alias("avg_term_length"))


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.term_counts(_docs(spark, d))


def term_frequencies_top10(spark: SparkSession, d: str) -> DataFrame:
    return analysis.top_terms(_counts(spark, d))


def zipf_rank_curve(spark: SparkSession, d: str) -> DataFrame:
    return analysis.zipf(_counts(spark, d))


def docs_per_source(spark: SparkSession, d: str) -> DataFrame:
    return analysis.by_source(_table(spark, d, "documents"))


def tokenizer_report(spark: SparkSession, d: str) -> DataFrame:
    got = analysis.tokenizer_report(_docs(spark, d), text.tokenize(F.col("text")))
    return got.withColumn("avg_token_length", F.round("avg_token_length", 6))


def tokenizer_first_words(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 tokens of the corpus, for a look at the tokenizer; 20 documents with a token are enough for them."""
    docs = _docs(spark, d).where(F.col("text").rlike("[0-9A-Za-z]")).orderBy("doc_id").limit(20)
    return analysis.first_words(docs, text.tokenize(F.col("text")), 20).withColumn("pos", F.col("pos").cast("long"))


def average_length_difference(spark: SparkSession, d: str) -> DataFrame:
    got = analysis.length_difference(_counts(spark, d), _index(spark, d).dictionary)
    return got.select(F.round("difference", 6).alias("difference"))


def position_delta_encode(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings.select("term", "doc_id", _as_text(codec.delta_encode(F.col("positions"))).alias("deltas"))


def position_delta_decode(spark: SparkSession, d: str) -> DataFrame:
    coded = _index(spark, d).postings.select("term", "doc_id", codec.delta_encode(F.col("positions")).alias("deltas"))
    return codec.delta_decode(coded, ["term", "doc_id"], "deltas").select("term", "doc_id", F.col("k").cast("long").alias("k"), F.col("value").alias("pos"))


def varbyte_length(spark: SparkSession, d: str) -> DataFrame:
    deltas = codec.delta_encode(F.col("positions"))
    n = F.aggregate(F.transform(deltas, codec.varbyte_length), F.lit(0).cast("long"), lambda a, x: a + x)
    return _index(spark, d).postings.select("term", "doc_id", n.alias("n_bytes"), F.hex(codec.varbyte(deltas)).alias("bytes"))


def url_strip_query(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", web.strip_query(F.col("url")).alias("url"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", web.normalize_url(F.col("url")).alias("url"))


def url_allowed_domain(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", web.host(F.col("url")).alias("host"), web.is_allowed_domain(F.col("url"), ["example.com", " ", "Example.NET"]).alias("allowed"))


def url_html_filter(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, d, "pages").select("page_id", web.looks_like_html(u).alias("html"), web.is_document(u, "/en/[0-9]+$").alias("document"), web.may_follow(u, "/fr/", web.is_document(u, "/en/[0-9]+$")).alias("follow"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    return pages.select("page_id", F.posexplode(web.extract_links(F.col("html"), F.col("url"))).alias("pos", "link")).withColumn("pos", F.col("pos").cast("long"))


def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", web.html_title(F.col("html")).alias("title"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", web.html_text(F.col("html")).alias("text"))


def content_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


def _new_and_stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, d, "documents")
    i = F.col("doc_id")
    new = docs.select(i.alias("url"), F.sha2("text", 256).alias("raw_sha256"), "source")
    changed = F.when(i % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    labels = _table(spark, d, "labels").select("doc_id")
    stored = docs.join(labels, "doc_id").select(i.alias("url"), changed.alias("raw_sha256"), F.lit("old").alias("source"), (F.lit(NOW) - i * 10).cast("long").alias("fetched_at"), F.lit(0).cast("long").alias("checked_at"))
    # Keys that are stored and do not come again.
    gone = labels.select((-i - 1).alias("url"), F.sha2(F.lit("gone"), 256).alias("raw_sha256"), F.lit("old").alias("source"), F.lit(NOW).cast("long").alias("fetched_at"), F.lit(0).cast("long").alias("checked_at"))
    return new, stored.union(gone)


def freshness_classify(spark: SparkSession, d: str) -> DataFrame:
    new, stored = _new_and_stored(spark, d)
    return ingest.classify(new, stored, NOW, 2000).select("url", "outcome")


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    new, stored = _new_and_stored(spark, d)
    return ingest.outcomes(ingest.classify(new, stored, NOW, 2000))


def _twice(new: DataFrame) -> DataFrame:
    """Each row and one of the same key from another source, which sorts behind it."""
    return new.unionByName(new.withColumn("source", F.concat("source", F.lit("-again"))))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Of the rows of one key the last by source."""
    new, stored = _new_and_stored(spark, d)
    return ingest.upsert(stored, _twice(new), order=["source"]).select("url", "raw_sha256", "source", F.coalesce("fetched_at", F.lit(0)).alias("fetched_at"))


def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """As upsert_merge, through a store of folders by key hash."""
    new, stored = _new_and_stored(spark, d)
    store = Store.create(stored, storage.new_path(spark, "store"), buckets=16)
    store.upsert(new)
    return store.read().select("url", "raw_sha256", "source", F.coalesce("fetched_at", F.lit(0)).alias("fetched_at"))


def recrawl_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pages fetched anew in two batches, of which each comes twice, at a later time."""
    new, stored = _new_and_stored(spark, d)
    store = Store.create(stored, storage.new_path(spark, "store"), buckets=16)
    for batch, pages in enumerate((new.where(F.crc32(F.col("url").cast("string")) < 1 << 31), new.where(F.crc32(F.col("url").cast("string")) >= 1 << 31))):
        for late in (0, 500):
            recrawl.merge_into(store, "recrawl", lambda late=late: NOW + late, 2000)(pages, batch)
    return store.read().select("url", "raw_sha256", "source", "fetched_at", "checked_at")


def stream_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies by a stream over the files of documents."""
    at = storage.new_path(spark, "counts")
    texts = spark.readStream.schema(_table(spark, d, "documents").schema).option("recursiveFileLookup", "true").parquet(f"{d}/documents.parquet*")
    stream_counts.start(texts.select("text"), f"{at}/out", f"{at}/state").awaitTermination()
    return stream_counts.read(spark, f"{at}/out")


def sql_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms by the table function of SQL."""
    table.register(spark)
    name = f"documents_{uuid.uuid4().hex}"
    _docs(spark, d).createOrReplaceTempView(name)
    return spark.sql(f"SELECT doc_id, CAST(t.pos AS BIGINT) AS pos, t.term FROM {name}, LATERAL terms(text) t")


def touch_checked(spark: SparkSession, d: str) -> DataFrame:
    new, stored = _new_and_stored(spark, d)
    same = ingest.classify(new, stored, NOW, 2000).where("outcome = 'unchanged'")
    return ingest.touch(stored, same, NOW).select("url", "checked_at")


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Of the rows of one key the first by source."""
    new, stored = _new_and_stored(spark, d)
    return ingest.insert_if_absent(stored, _twice(new), order=["source"]).select("url", "source")


def first_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 documents by source and id."""
    return ingest.within_budget(_table(spark, d, "documents").select("source", "doc_id"), 300, ["source", "doc_id"])


def source_quota(spark: SparkSession, d: str) -> DataFrame:
    return ingest.within_quota(_table(spark, d, "documents").select("doc_id", "source"), 7, order="doc_id")


def word_count_filter(spark: SparkSession, d: str) -> DataFrame:
    n = web.word_count(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", n.alias("n_words")).where("n_words >= 500")


def safe_title(spark: SparkSession, d: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return _table(spark, d, "documents").select("doc_id", web.safe_title(title).alias("name"))


def ncbi_article_url(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "pmc").when(F.col("doc_id") % 3 == 1, "pubmed").otherwise(F.col("source"))
    return _table(spark, d, "documents").select("doc_id", web.ncbi_article_url(kind, F.col("doc_id").cast("string")).alias("url"))


def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    return index.number_documents(_table(spark, d, "pages").select("url"))


def tsv_fields(spark: SparkSession, d: str) -> DataFrame:
    """Written as lines and read again."""
    docs = _docs(spark, d).withColumn("key", F.col("doc_id").cast("string"))
    path = storage.new_path(spark, "lines")
    docs.select(F.concat_ws("\t", *readers.to_line("key", "title", "text")).alias("value")).write.text(path)
    return readers.tsv(spark, path).select(F.col("url").cast("long").alias("doc_id"), "title", F.sha2("text", 256).alias("text_sha"))


def text_with_json_by_stem(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    texts = _table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("text/Doc_"), i, F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    raws = _table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select(F.concat(F.lit("raw/Doc_"), i, F.lit(".json")).alias("path"), F.concat(F.lit("q"), F.coalesce(F.col("q").cast("string"), F.lit(""))).alias("content"))
    return ingest.text_files(texts, raws, NOW).select("url", "title", "raw_sha256", F.length("parsed_text").cast("long").alias("n_chars"))


def window_position_deltas(spark: SparkSession, d: str) -> DataFrame:
    t = index.tokens(_docs(spark, d)).select("doc_id", "term", F.col("pos").cast("long").alias("pos"))
    w = Window.partitionBy("doc_id", "term").orderBy("pos")
    return t.withColumn("delta", F.col("pos") - F.lag("pos", 1, 0).over(w))


_URL = "documents.source || ':' || documents.doc_id"
_TITLE = "substr(split_part(documents.text, chr(10), 1), 1, 60)"
_OLD = f"""WITH new AS (SELECT doc_id AS url, sha256(text) AS raw_sha256, source FROM documents),
stored AS (SELECT doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS raw_sha256, 'old' AS source,
           CAST({NOW} - doc_id * 10 AS BIGINT) AS fetched_at, CAST(0 AS BIGINT) AS checked_at FROM documents JOIN labels USING (doc_id)
           UNION ALL SELECT -doc_id - 1, sha256('gone'), 'old', CAST({NOW} AS BIGINT), CAST(0 AS BIGINT) FROM labels),
seen AS (SELECT n.url, CASE WHEN s.url IS NULL THEN 'new' WHEN s.fetched_at > 0 AND {NOW} - s.fetched_at < 2000 THEN 'fresh'
         WHEN s.raw_sha256 = n.raw_sha256 THEN 'unchanged' ELSE 'changed' END AS outcome FROM new n LEFT JOIN stored s USING (url)) """
_DECODED = r"""replace(replace(replace(replace(regexp_replace({0}, '&quot;', '"', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"""


def _page(where: str, size: int, offset: int = 0) -> str:
    return f"""SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id, {_TITLE} AS title, {_URL} AS url, {_TITLE} || ' (' || {_URL} || ')' AS line
FROM documents WHERE {where} QUALIFY rank > {offset} AND rank <= {offset + size}"""


def oracle_sql() -> dict[str, str]:
    t = _terms_sql()
    out = {name: f"{t} SELECT doc_id FROM documents WHERE {where()}" for name, (_, _, where) in SEARCHES.items()}
    batch = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS query_id, doc_id FROM documents WHERE {w}"
        for i, w in ((1, _near(["of", "the"])), (2, f"{_all('of', 'the')} AND NOT {_has('der')}"), (3, f"{_has('crispr')} OR {_has('licens')}"), (4, _near(["le", "de"], 4)))
    )
    freq = "counts AS (SELECT term, count(*) AS freq FROM terms GROUP BY term)"
    text_sql = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<noscript[^>]*>.*?</noscript>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'gs')"""
    page_text_sql = f"trim(regexp_replace(regexp_replace({_DECODED.format(text_sql)}, '\\[\\s*[0-9]+\\s*\\]', '', 'g'), '\\s+', ' ', 'g'))"
    delta = f"{t}, d AS (SELECT term, doc_id, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY term, doc_id ORDER BY pos) AS delta FROM terms)"
    coded = "CASE WHEN delta < 128 THEN printf('%02X', delta) WHEN delta < 16384 THEN printf('%02X%02X', delta % 128 + 128, delta // 128) ELSE printf('%02X%02X%02X', delta % 128 + 128, delta // 128 % 128 + 128, delta // 16384) END"
    out |= {
        "token_positions": f"{t} SELECT doc_id, pos, term FROM terms",
        "stem_vocabulary": f"{t} SELECT w0 AS word, w AS term FROM voc",
        "term_postings": f"{t} SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY term, doc_id",
        "postings_positions": f"{t} SELECT term, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM terms GROUP BY term, doc_id",
        "term_doc_freq": f"{t} SELECT term, count(DISTINCT doc_id) AS doc_count FROM terms GROUP BY term",
        "doc_term_freq": f"{t}, f AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL) SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS max_tf FROM f GROUP BY doc_id",
        "search_page_top10": t + _page(_near(["of", "the"], 5), 10),
        "search_page_top50": t + _page(_all("of", "the"), 50),
        "search_page_second": t + _page(_all("of", "the"), 10, 10),
        "search_hit_count": f"{t} SELECT count(*) AS hits FROM documents WHERE NOT {_has('der')}",
        "batch_queries_topk": f"""{t}, h AS ({batch}), r AS (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS hits,
row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM h)
SELECT query_id, hits, rank, r.doc_id, coalesce(nullif({_TITLE}, ''), 'No Title') || ' (' || {_URL} || ')' AS line FROM r JOIN documents USING (doc_id) WHERE rank <= 10""",
        "query_table_topk": f"""{t}, bw AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS ws FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT ws[1] AS w FROM bw UNION SELECT ws[2] FROM bw), av AS MATERIALIZED ({_stemmed_sql("asked")}),
q AS MATERIALIZED (SELECT item_id, v1.w AS a, v2.w AS b FROM bw JOIN av v1 ON v1.w0 = ws[1] JOIN av v2 ON v2.w0 = ws[2] WHERE len(ws) >= 2),
p AS MATERIALIZED (SELECT * FROM terms WHERE term IN (SELECT a FROM q UNION SELECT b FROM q)), d AS MATERIALIZED (SELECT DISTINCT term, doc_id FROM p),
h AS (SELECT 4 * item_id AS query_id, x.doc_id FROM q JOIN d x ON x.term = a JOIN d y ON y.term = b AND y.doc_id = x.doc_id
UNION ALL SELECT DISTINCT 4 * item_id + 1, x.doc_id FROM q JOIN p x ON x.term = a JOIN p y ON y.term = b AND y.doc_id = x.doc_id AND y.pos = x.pos + 1
UNION ALL SELECT DISTINCT 4 * item_id + 2, x.doc_id FROM q JOIN p x ON x.term = a JOIN p y ON y.term = b AND y.doc_id = x.doc_id AND y.pos > x.pos AND y.pos <= x.pos + 5
UNION ALL SELECT 4 * item_id + 3, o.doc_id FROM q CROSS JOIN (SELECT doc_id FROM documents WHERE text IS NOT NULL) o LEFT JOIN d x ON x.term = a AND x.doc_id = o.doc_id LEFT JOIN d y ON y.term = b AND y.doc_id = o.doc_id WHERE x.term IS NULL OR y.term IS NOT NULL),
r AS (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM h)
SELECT query_id, hits, rank, r.doc_id, coalesce(nullif({_TITLE}, ''), 'No Title') || ' (' || {_URL} || ')' AS line FROM r JOIN documents USING (doc_id) WHERE rank <= 10""",
        "set_union": f"{t} SELECT doc_id FROM terms WHERE term = 'der' UNION SELECT doc_id FROM terms WHERE term = 'que'",
        "set_intersect": f"{t} SELECT doc_id FROM terms WHERE term = 'of' INTERSECT SELECT doc_id FROM terms WHERE term = 'the'",
        "set_difference": f"{t} SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM terms WHERE term = 'of'",
        "term_bitmaps": f"{t}, b AS (SELECT term, doc_id // 64 AS word, bit_or(CAST(1 AS UBIGINT) << CAST(doc_id % 64 AS UBIGINT)) AS bits FROM terms GROUP BY ALL) SELECT term, word, printf('%X', bits) AS bits, CAST(bit_count(bits) AS INTEGER) AS n_docs FROM b",
        "corpus_stats": f"WITH p AS (SELECT html, {page_text_sql} AS text FROM pages) SELECT count(*) AS n_docs, CAST(sum(length(html)) AS BIGINT) AS raw_chars, CAST(sum(length(text)) AS BIGINT) AS text_chars, round(avg(length(html)), 6) AS avg_raw_chars, round(avg(length(text)), 6) AS avg_text_chars FROM p",
        "token_stats": f"{t} SELECT count(*) AS n_tokens, round(avg(length(term)), 6) AS avg_token_length FROM terms",
        "unique_term_stats": f"{t} SELECT count(DISTINCT term) AS n_terms, round(avg(strlen(term)), 6) AS avg_term_length FROM (SELECT DISTINCT term FROM terms)",
        "term_counts": f"{t}, {freq} SELECT * FROM counts",
        "term_frequencies_top10": f"{t}, {freq} SELECT * FROM counts ORDER BY freq DESC, term LIMIT 10",
        "zipf_rank_curve": f"{t}, {freq} SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq, (SELECT max(freq) FROM counts) / rank AS zipf FROM counts",
        "docs_per_source": "SELECT source, count(*) AS n_docs FROM documents GROUP BY source",
        "tokenizer_report": f"{t} SELECT count(*) AS n_tokens, round(avg(length(w)), 6) AS avg_token_length, count(DISTINCT w) AS n_unique FROM tok",
        "position_delta_encode": f"{delta} SELECT term, doc_id, string_agg(CAST(delta AS VARCHAR), ',' ORDER BY pos) AS deltas FROM d GROUP BY term, doc_id",
        "position_delta_decode": f"{t} SELECT term, doc_id, row_number() OVER (PARTITION BY term, doc_id ORDER BY pos) - 1 AS k, pos FROM terms",
        "window_position_deltas": f"{delta} SELECT doc_id, term, pos, delta FROM d",
        "varbyte_length": f"{delta} SELECT term, doc_id, CAST(sum(CASE WHEN delta < 128 THEN 1 WHEN delta < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS n_bytes, string_agg({coded}, '' ORDER BY pos) AS bytes FROM d GROUP BY term, doc_id",
        "tokenizer_first_words": f"{t} SELECT doc_id, pos, w FROM tok ORDER BY doc_id, pos LIMIT 20",
        "average_length_difference": f"{t} SELECT round(avg(length(term)) - (SELECT avg(strlen(x)) FROM (SELECT DISTINCT term AS x FROM terms)), 6) AS difference FROM terms",
        "url_strip_query": "SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages",
        "url_normalize": r"SELECT page_id, lower(regexp_extract(url, '^[^/]*//[^/?#]*')) || regexp_extract(split_part(url, '#', 1), '^[^/]*//[^/?#]*(.*)$', 1) AS url FROM pages",
        "url_allowed_domain": "SELECT page_id, lower(regexp_extract(url, '//([^/:?#]*)', 1)) AS host, host = 'example.com' OR suffix(host, '.example.com') OR host = 'example.net' OR suffix(host, '.example.net') AS allowed FROM pages",
        "url_html_filter": f"SELECT page_id, NOT regexp_matches(lower(split_part(split_part(url, '#', 1), '?', 1)), '({'|'.join(x.replace('.', '[.]') for x in web.SKIPPED)})$') AS html, regexp_matches(url, '/en/[0-9]+$') OR regexp_matches(split_part(split_part(url, '#', 1), '?', 1), '/en/[0-9]+$') AS document, regexp_matches(url, '/fr/') OR document AS follow FROM pages",
        "page_links": r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*') AS site, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages)
SELECT page_id, CAST(generate_subscripts(hs, 1) - 1 AS BIGINT) AS pos, lower(site) || unnest(hs) AS link FROM h""",
        "page_title": f"""SELECT page_id, trim(regexp_replace({_DECODED.format("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")}, '\\s+', ' ', 'g')) AS title FROM pages""",
        "page_text": f"SELECT page_id, {page_text_sql} AS text FROM pages",
        "content_sha256": "SELECT page_id, sha256(html) AS sha FROM pages",
        "freshness_classify": f"{_OLD} SELECT url, outcome FROM seen",
        "outcome_counts": f"{_OLD} SELECT outcome, count(*) AS n FROM seen GROUP BY outcome",
        "upsert_merge": f"{_OLD} SELECT coalesce(n.url, s.url) AS url, coalesce(n.raw_sha256, s.raw_sha256) AS raw_sha256, coalesce(n.source || '-again', s.source) AS source, coalesce(s.fetched_at, 0) AS fetched_at FROM stored s FULL JOIN new n ON n.url = s.url",
        "store_upsert": f"{_OLD} SELECT coalesce(n.url, s.url) AS url, coalesce(n.raw_sha256, s.raw_sha256) AS raw_sha256, coalesce(n.source, s.source) AS source, coalesce(s.fetched_at, 0) AS fetched_at FROM stored s FULL JOIN new n ON n.url = s.url",
        "recrawl_batches": f"""{_OLD}, c AS (SELECT url, raw_sha256, source FROM new JOIN seen USING (url) WHERE outcome IN ('new', 'changed'))
SELECT coalesce(c.url, s.url) AS url, coalesce(c.raw_sha256, s.raw_sha256) AS raw_sha256, coalesce(c.source, s.source) AS source,
CASE WHEN c.url IS NOT NULL THEN {NOW} ELSE s.fetched_at END AS fetched_at,
CASE WHEN c.url IS NOT NULL OR s.url IN (SELECT url FROM seen WHERE outcome = 'unchanged') THEN {NOW} ELSE s.checked_at END AS checked_at FROM stored s FULL JOIN c ON c.url = s.url""",
        "stream_term_counts": f"{t}, {freq} SELECT * FROM counts",
        "sql_terms": f"{t} SELECT doc_id, pos, term FROM terms",
        "touch_checked": f"{_OLD} SELECT url, CAST(CASE WHEN outcome = 'unchanged' THEN {NOW} ELSE 0 END AS BIGINT) AS checked_at FROM stored LEFT JOIN (SELECT DISTINCT url, outcome FROM seen WHERE outcome = 'unchanged') USING (url)",
        "insert_if_absent": f"{_OLD} SELECT url, source FROM stored UNION ALL SELECT url, source FROM new WHERE url NOT IN (SELECT url FROM stored)",
        "first_within_budget": "SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 300",
        "source_quota": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7",
        "word_count_filter": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents WHERE n_words >= 500",
        "safe_title": r"SELECT doc_id, substr(replace(trim(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g')), ' ', '_'), 1, 100) AS name FROM documents",
        "ncbi_article_url": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || doc_id || '/' WHEN doc_id % 3 = 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' ELSE source || ':' || doc_id END AS url FROM documents",
        "document_numbers": "SELECT row_number() OVER (ORDER BY url) - 1 AS doc_id, url FROM pages",
        "tsv_fields": f"SELECT doc_id, translate({_TITLE}, chr(9), ' ') AS title, sha256(translate(text, chr(9) || chr(10), '  ')) AS text_sha FROM documents WHERE text IS NOT NULL",
        "text_with_json_by_stem": "WITH r AS (SELECT doc_id, 'q' || coalesce(CAST(max(quality) AS VARCHAR), '') AS q FROM labels GROUP BY doc_id) SELECT 'https://en.wikipedia.org/wiki/Doc_' || doc_id AS url, 'Doc ' || doc_id AS title, sha256(coalesce(q, text)) AS raw_sha256, length(text) AS n_chars FROM documents LEFT JOIN r USING (doc_id) WHERE text IS NOT NULL",
    }
    return out


def queries() -> dict[str, Query]:
    out = {name: _search(q, dialect) for name, (q, dialect, _) in SEARCHES.items()}
    plain = (
        token_positions, stem_vocabulary, term_postings, postings_positions, term_doc_freq, doc_term_freq, search_page_top10, search_page_top50, search_page_second,
        search_hit_count, batch_queries_topk, query_table_topk, set_union, set_intersect, set_difference, term_bitmaps, corpus_stats, token_stats, unique_term_stats, term_counts,
        term_frequencies_top10, zipf_rank_curve, docs_per_source, tokenizer_report, position_delta_encode, position_delta_decode, varbyte_length, url_strip_query,
        url_normalize, url_allowed_domain, url_html_filter, page_links, page_title, page_text, content_sha256, freshness_classify, outcome_counts, upsert_merge, store_upsert, recrawl_batches, stream_term_counts, sql_terms,
        touch_checked, insert_if_absent, first_within_budget, source_quota, word_count_filter, safe_title, ncbi_article_url, document_numbers, tsv_fields, tokenizer_first_words, average_length_difference, text_with_json_by_stem, window_position_deltas,
    )
    return out | {f.__name__: f for f in plain}
