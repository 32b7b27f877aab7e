"""How documents enter the corpus: change detection, upserts, quotas, migration and crawl rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import web
from lexispark.storage import new_path


def is_fresh(fetched_at: Column, now: int, fresh_seconds: int) -> Column:
    return F.coalesce(F.lit(fresh_seconds > 0) & (fetched_at > 0) & (F.lit(now) - fetched_at < fresh_seconds), F.lit(False))


def classify(new: DataFrame, stored: DataFrame, now: int, fresh_seconds: int, key: str = "url") -> DataFrame:
    """new with ``outcome``: fresh, unchanged, changed or new, by what is stored under the same key."""
    old = stored.select(key, F.col("raw_sha256").alias("_sha"), F.col("fetched_at").alias("_at"), F.lit(True).alias("_known"))
    outcome = (
        F.when(F.col("_known").isNull(), "new")
        .when(is_fresh(F.col("_at"), now, fresh_seconds), "fresh")
        .when(F.coalesce(F.col("_sha") == F.col("raw_sha256"), F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return new.join(old, key, "left").withColumn("outcome", outcome).drop("_sha", "_at", "_known")


def one_row_a_key(rows: DataFrame, key: str, order: list[str] | None, last: bool) -> DataFrame:
    """The last or first row of each key by the columns of ``order`` (fetched_at, if there is one, by default), ties by a hash of the
    rows, so that the choice is the same in every run."""
    by = ["fetched_at"] if order is None and "fetched_at" in rows.columns else order or []
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    rest = [c for c in others if c not in by]
    place = F.struct(*by, *([F.xxhash64(*rest)] if rest else []))
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key).agg(pick(F.struct(*others), place).alias("_row")).select(key, "_row.*").select(rows.columns)


def upsert(stored: DataFrame, new: DataFrame, key: str = "url", order: list[str] | None = None) -> DataFrame:
    """A new snapshot: new values win, fields that are not supplied keep theirs. Of new rows of one key the last one by ``order`` counts;
    both it and the join need the rows by key, so they share a shuffle."""
    columns = list(dict.fromkeys([*stored.columns, *new.columns]))
    s, n = stored.alias("s"), one_row_a_key(new, key, order, last=True).alias("n")

    def merged(c: str) -> Column:
        sides = [F.col(f"{a}.{c}") for a, d in (("n", new), ("s", stored)) if c in d.columns]
        return F.coalesce(*sides).alias(c)

    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full").select(*(merged(c) for c in columns))


def touch(stored: DataFrame, seen: DataFrame, now: int, key: str = "url") -> DataFrame:
    """checked_at of the seen keys becomes now."""
    marks = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return stored.join(marks, key, "left").withColumn("checked_at", F.when(F.col("_seen"), F.lit(now).cast("long")).otherwise(F.col("checked_at"))).drop("_seen")


def insert_if_absent(stored: DataFrame, new: DataFrame, key: str = "url", order: list[str] | None = None) -> DataFrame:
    """stored, and of each key that it lacks the first new row by ``order``."""
    first = one_row_a_key(new, key, order, last=False)
    return stored.unionByName(first.join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def within_quota(rows: DataFrame, quota: int, by: str = "source", order: str = "url") -> DataFrame:
    """The first rows of each source. The limit applies in map tasks too, so a large source is not gathered."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= quota).drop("_n")


def within_budget(rows: DataFrame, budget: int, order: list[str], block: int = 1000) -> DataFrame:
    """The first ``budget`` rows by the columns of ``order``, of which the last is a number: a running total over blocks of it, and places
    inside the block where the budget ends. No task sorts all rows."""
    *groups, number = order
    at = [*groups, "_block"]
    rows = rows.withColumn("_block", F.floor(F.col(number) / block))
    sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sizes.withColumn("_before", before).where(F.col("_before") < budget).drop("_n")
    place = F.row_number().over(Window.partitionBy(*at).orderBy(number))
    return rows.join(open_, at).withColumn("_place", place).where(F.col("_before") + F.col("_place") <= budget).drop("_block", "_before", "_place")


def apply_outcomes(stored: DataFrame, seen: DataFrame, now: int, key: str = "url") -> DataFrame:
    """A new snapshot: of rows with an outcome, new and changed ones are upserted and unchanged ones marked as checked."""
    touched = touch(stored, seen.where("outcome = 'unchanged'"), now, key)
    return upsert(touched, seen.where("outcome in ('new', 'changed')").drop("outcome"), key)


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def migrate(meta: DataFrame, raw: DataFrame, texts: DataFrame, now: int, raw_root: str = "raw", text_root: str = "text") -> DataFrame:
    """Metadata rows with their files. meta: (source, raw_path, url, id, fetched_at); raw and texts: (path, content).

    outcome is skipped without a path or URL, missing without a raw file, else upserted. The text is the parsed file's if there is
    one, else taken from the raw page.
    """
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    m = meta.withColumn("source", source)
    m = m.withColumn("url", web.url_from_meta(F.col("source"), F.col("url"), F.col("id")))
    m = m.withColumn("text_path", F.concat(F.lit(text_root), web.text_path(F.expr(f"substring(raw_path, {len(raw_root) + 1})"))))
    m = m.join(raw.select(F.col("path").alias("raw_path"), F.col("content").alias("raw_content")), "raw_path", "left")
    m = m.join(texts.select(F.col("path").alias("text_path"), F.trim("content").alias("_text")), "text_path", "left")
    outcome = F.when((F.coalesce("raw_path", F.lit("")) == "") | F.col("url").isNull(), "skipped").when(F.col("raw_content").isNull(), "missing").otherwise("upserted")
    fetched = F.coalesce("fetched_at", F.lit(now).cast("long"))
    return m.select(
        "url", "source", "raw_content", F.sha2("raw_content", 256).alias("raw_sha256"), F.coalesce("_text", web.html_text(F.col("raw_content"))).alias("parsed_text"),
        fetched.alias("fetched_at"), fetched.alias("checked_at"), F.lit(now).cast("long").alias("migrated_at"), "raw_path", "text_path", outcome.alias("outcome"),
    )


def text_files(texts: DataFrame, raws: DataFrame, now: int, site: str = "https://en.wikipedia.org/wiki/") -> DataFrame:
    """Documents of text files (path, content) with the JSON file (path, content) of the same stem, where there is one, as raw content.
    Title and URL come from the stem. Keys that are stored already are for insert_if_absent to leave out."""

    def stem(extension: str) -> Column:
        return F.regexp_extract("path", rf"([^/]*)\.{extension}$", 1)

    t = texts.where(F.endswith("path", F.lit(".txt"))).select(stem("txt").alias("_stem"), F.col("content").alias("parsed_text"))
    r = raws.where(F.endswith("path", F.lit(".json"))).select(stem("json").alias("_stem"), F.col("content").alias("_raw"))
    raw = F.coalesce("_raw", "parsed_text")
    at = F.lit(now).cast("long")
    return t.join(r, "_stem", "left").select(
        F.concat(F.lit(site), F.col("_stem")).alias("url"), F.translate("_stem", "_", " ").alias("title"), "parsed_text", raw.alias("raw_content"),
        F.sha2(raw, 256).alias("raw_sha256"), at.alias("fetched_at"), at.alias("checked_at"),
    )


def remember(urls: DataFrame, table: str, path: str, buckets: int) -> None:
    """Add to a table of URLs that is bucketed by them, one file a bucket and round."""
    urls.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").mode("append").option("path", path).saveAsTable(table)


def unasked(todo: DataFrame, asked: DataFrame) -> DataFrame:
    """URLs that are not in a bucketed table, which is joined where it lies."""
    return todo.join(asked.hint("merge"), "url", "left_anti")


def crawl(
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    stored: DataFrame,
    allowed: list[str],
    document: str,
    follow: str | None,
    now: int,
    max_pages: int = 0,
    max_docs: int = 0,
    fresh_seconds: int = 0,
    source: str | None = None,
) -> DataFrame:
    """Crawl from seeds (url) until no link is new: a round takes all new links of the last one, fetches them, and reads their links.

    fetch: (url) -> (url, html). A URL is asked for once, whether or not it answers. A document's key is its URL without the query;
    of several URLs of one key the last round counts, with fresh_seconds the first one, and the largest URL of a round.
    max_pages bounds the pages that answer, max_docs the new or changed documents and those in ``stored`` (of ``source``, if named)
    together; 0 is no bound, and the rest of a round goes in order of URLs. Returns (url, raw_content, raw_sha256, parsed_text, title, outcome); a page without a
    title has its URL for one. Each round is written to the shared folder, which ends its lineage.
    """
    spark = seeds.sparkSession
    root, u = new_path(spark, "crawl"), F.col("url")
    wanted = web.is_allowed_domain(u, allowed) & web.looks_like_html(u) & web.may_follow(u, follow, web.is_document(u, document))
    frontier = seeds.select(web.normalize_url(u).alias("url"))
    own = stored if source is None else stored.where(F.col("source") == source)
    pages_left, docs_left = max_pages, max_docs - (own.count() if max_docs else 0)
    # Keys that were asked for, by hash: later rounds come to them, and they are not moved again.
    asked = f"asked_{uuid.uuid4().hex}"
    n_asked = spark.sparkContext.defaultParallelism
    rounds: list[DataFrame] = []
    turn = 0
    while (not max_pages or pages_left > 0) and (not max_docs or docs_left > 0):
        todo = frontier.where(u.isNotNull() & wanted).distinct()
        if turn:
            todo = unasked(todo, spark.table(asked))
        if max_pages:
            todo = todo.orderBy("url").limit(pages_left)
        at, turn = f"{root}/{turn}", turn + 1
        # By URL, so that a site of many pages is fetched by many tasks.
        todo.repartition(n_asked, "url").write.parquet(f"{at}/asked")
        new_urls = spark.read.schema("url string").parquet(f"{at}/asked")
        remember(new_urls, asked, f"{root}/all", n_asked)
        fetch(new_urls.repartition(n_asked, "url")).write.parquet(f"{at}/pages")
        pages = spark.read.parquet(f"{at}/pages")
        n = pages.count()
        if not n:
            break
        pages_left -= n
        found = pages.where(web.is_document(u, document)).withColumn("_from", u).withColumn("url", web.strip_query(u))
        found = found.groupBy("url").agg(F.max_by("html", "_from").alias("html"))
        title = F.coalesce(F.nullif(web.html_title(F.col("html")), F.lit("")), u)
        new = found.select("url", F.col("html").alias("raw_content"), F.sha2("html", 256).alias("raw_sha256"), web.html_text(F.col("html")).alias("parsed_text"), title.alias("title"))
        seen = classify(new, stored, now, fresh_seconds).withColumn("_round", F.lit(turn))
        if max_docs:
            saved = F.col("outcome").isin("new", "changed")
            seen = seen.where(~saved).union(seen.where(saved).orderBy("url").limit(docs_left))
        seen.write.parquet(f"{at}/documents")
        rounds.append(spark.read.parquet(f"{at}/documents"))
        if max_docs:
            docs_left -= rounds[-1].where(F.col("outcome").isin("new", "changed")).count()
        frontier = pages.select(F.explode(web.extract_links(F.col("html"), u)).alias("url"))
    spark.sql(f"DROP TABLE IF EXISTS {asked}")
    if not rounds:
        empty = spark.createDataFrame([], "url string, raw_content string, raw_sha256 string, parsed_text string, title string")
        return classify(empty, stored, now, fresh_seconds)
    every = reduce(DataFrame.union, rounds)
    fields = F.struct(*(c for c in every.columns if c != "url"))
    pick = (F.min_by if fresh_seconds else F.max_by)(fields, "_round")
    return every.groupBy("url").agg(pick.alias("d")).select("url", "d.*").drop("_round")
