"""Searches of remote services as Spark data sources, in batches and as streams, and documents gathered from them under a budget.

``register(spark, get)`` makes ``spark.read.format("ncbi_search" | "plos_search" | "wikipedia_search")`` known; get: address -> body, or
None, called by the workers. Rows are (term_no, term, position, id, title). Options: ``terms`` (JSON list), ``page_size``, ``readers``
(how many tasks ask at once), ``pause_ms`` (between calls of all readers together), ``from_page`` and ``n_pages`` (a stretch of all
terms' pages in order), ``totals`` (JSON, as told by an earlier call), and the service's own: ``base``, ``db``, ``tool``, ``email``, ``api_key``.

The planner asks for one page a term, which tells the total; readers get the pages dealt in turn. A stream's offset is a number of
hits a term, so a restart goes on where the last batch ended, and new hits are a batch. A page that does not answer fails its task,
which Spark tries again, as leaving it out would lose ids unnoticed.
"""

from __future__ import annotations

import json
import time
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lexispark.functions import web
from lexispark.operators import ingest
from lexispark.sources import readers, sinks
from lexispark.storage import cut

Get = Callable[[str], str | None]
SCHEMA = "term_no int, term string, position long, id string, title string"


@dataclass(frozen=True)
class Service:
    """How a search is asked for and read. read: the hits of a page (id or None, title), and how many there are in all."""

    name: str
    size: int
    address: Callable[[dict[str, str], str, int, int], str]
    read: Callable[[dict], tuple[list[tuple[str | None, str | None]], int]]


# Addresses, parameters and fields of the services.
NCBI_BASE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
PLOS_BASE = "https://api.plos.org/search"
PLOS_ARTICLE = "https://journals.plos.org/plosone/article?id="
WIKIPEDIA_API = "https://en.wikipedia.org/w/api.php"


def _named(options: dict[str, str]) -> dict[str, str]:
    """Who asks; mail address and key are sent if there are any."""
    return {"tool": options.get("tool") or "lexispark"} | {k: options[k] for k in ("email", "api_key") if options.get(k)}


def _ncbi_address(options: dict[str, str], term: str, start: int, size: int) -> str:
    search = {"db": options["db"], "term": term, "retstart": str(start), "retmax": str(size), "retmode": "json"}
    return web.build_url(options.get("base", NCBI_BASE) + "/esearch.fcgi", search | _named(options))


def _ncbi_read(data: dict) -> tuple[list, int]:
    found = data.get("esearchresult", {})
    return [(x or None, None) for x in found.get("idlist", [])], int(found.get("count", 0) or 0)


def _plos_address(options: dict[str, str], term: str, start: int, size: int) -> str:
    return f"{options.get('base', PLOS_BASE)}?q=everything:{urllib.parse.quote(term)}&rows={size}&start={start}&wt=json"


def _plos_read(data: dict) -> tuple[list, int]:
    found = data.get("response", {})
    hits = [(d.get("id"), d.get("title_display")) for d in found.get("docs", [])]
    return hits, int(found.get("numFound", len(hits)))


def _wikipedia_address(options: dict[str, str], term: str, start: int, size: int) -> str:
    fields = {"action": "query", "list": "search", "srsearch": term, "srlimit": size, "sroffset": start, "srwhat": "text", "format": "json"}
    return web.build_url(options.get("base", WIKIPEDIA_API), fields)


def _wikipedia_read(data: dict) -> tuple[list, int]:
    """Titles with a colon are pages of other kinds."""
    hits = [h.get("title") or "" for h in data.get("query", {}).get("search", [])]
    return [(t, t) if t and ":" not in t else (None, None) for t in hits], int(data.get("query", {}).get("searchinfo", {}).get("totalhits", len(hits)))


NCBI = Service("ncbi_search", 200, _ncbi_address, _ncbi_read)
PLOS = Service("plos_search", 100, _plos_address, _plos_read)
WIKIPEDIA = Service("wikipedia_search", 500, _wikipedia_address, _wikipedia_read)


class Pages(InputPartition):
    """Pages that one task asks for: (number of the term, first hit, hits)."""

    def __init__(self, pages: list[tuple[int, int, int]]):
        self.pages = pages


class Asker:
    """What batches and streams share."""

    def __init__(self, service: Service, get: Get, options: dict[str, str]):
        self.service, self.get, self.options = service, get, {k.lower(): v for k, v in options.items()}
        self.terms: list[str] = json.loads(self.options.get("terms", "[]"))
        self.size = int(self.options.get("page_size") or service.size)
        self.n_readers = max(1, int(self.options.get("readers", 8)))
        self.pause = float(self.options.get("pause_ms", 0)) / 1000

    def page(self, term_no: int, start: int, size: int) -> tuple[list[tuple], int]:
        """Of a whole page the first ``size`` hits: a stream's batch ends where it was told to, though more may be there by now."""
        body = self.get(self.service.address(self.options, self.terms[term_no], start, self.size))
        if body is None:
            raise OSError(f"{self.service.name}: no answer for {self.terms[term_no]!r} from {start}")
        hits, total = self.service.read(json.loads(body))
        return [(term_no, self.terms[term_no], start + k, i, title) for k, (i, title) in enumerate(hits[:size]) if i], total

    def totals(self) -> list[int]:
        if self.options.get("totals"):
            return json.loads(self.options["totals"])
        return [self.page(k, 0, self.size)[1] for k in range(len(self.terms))]

    def dealt(self, pages: list[tuple[int, int, int]]) -> list[Pages]:
        return [Pages(pages[k :: self.n_readers]) for k in range(min(self.n_readers, len(pages)))]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for k, page in enumerate(partition.pages):
            if k and self.pause:
                time.sleep(self.pause * self.n_readers)
            yield from self.page(*page)[0]


class SearchReader(Asker, DataSourceReader):
    def partitions(self) -> list[Pages]:
        pages = [(k, start, self.size) for k, total in enumerate(self.totals()) for start in range(0, total, self.size)]
        first = int(self.options.get("from_page", 0))
        return self.dealt(pages[first : first + int(self.options["n_pages"])] if "n_pages" in self.options else pages[first:])


class SearchStream(Asker, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.terms, 0)

    def latestOffset(self) -> dict:  # noqa: N802
        return dict(zip(self.terms, self.totals(), strict=True))

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        pages = []
        for k, term in enumerate(self.terms):
            last = end.get(term, 0)
            pages += [(k, at, min(self.size, last - at)) for at in range(start.get(term, 0), last, self.size)]
        return self.dealt(pages)


def data_source(service: Service, get: Get) -> type[DataSource]:
    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return service.name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return SearchReader(service, get, dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
            return SearchStream(service, get, dict(self.options))

    return Search


def register(spark: SparkSession, get: Get = readers.http_text) -> None:
    for service in (NCBI, PLOS, WIKIPEDIA):
        spark.dataSource.register(data_source(service, get))


def search(spark: SparkSession, service: Service, get: Get, terms: list[str], **options: object) -> DataFrame:
    spark.dataSource.register(data_source(service, get))
    return spark.read.format(service.name).options(terms=json.dumps(terms), **{k: str(v) for k, v in options.items()}).load()


def gather(
    spark: SparkSession, service: Service, get: Get, terms: list[str], taken: DataFrame, save: Callable[[DataFrame], DataFrame], budget: int | None, by_saved: bool, **options: object
) -> DataFrame | None:
    """What ``save`` makes of hits (term_no, term, position, id, title) that are not taken (id), each id once, at its first place.

    Hits go to save in order of terms and positions until the budget is used: by hits, or with by_saved by the rows that save returns. Pages are
    asked for as the budget needs them, in a stretch that would be enough if every hit counted; what is missing then is asked for next.
    Each stretch is written to the shared folder. None if there is no hit.
    """
    asker = Asker(service, get, {"terms": json.dumps(terms), **{k: str(v) for k, v in options.items()}})
    totals = asker.totals()
    n_pages = sum(-(-t // asker.size) for t in totals)
    page, left, saved = 0, budget, []
    known, pool = taken.select("id").where("id is not null").distinct(), None
    while left is None or left > 0:
        if pool is None or pool.isEmpty():
            if page >= n_pages:
                break
            more = n_pages if left is None else -(-left // asker.size)
            found = search(spark, service, get, terms, totals=json.dumps(totals), from_page=page, n_pages=more, **options)
            page += more
            once = found.groupBy("id").agg(F.min(F.struct("term_no", "position", "term", "title")).alias("f")).select("id", "f.*")
            pool = cut(once.join(known, "id", "left_anti"), "hits")
            known = cut(known.union(pool.select("id")), "known")
            continue
        now = cut(pool if left is None else ingest.within_budget(pool, left, ["term_no", "position"]), "chosen")
        pool = cut(pool.join(now.select("id"), "id", "left_anti"), "hits")
        saved.append(cut(save(now), "saved"))
        if left is not None:
            left -= (saved[-1] if by_saved else now).count()
    return reduce(DataFrame.unionByName, saved) if saved else None


def polite(get: Get, pause_ms: int) -> Get:
    """get, and a pause after each call of a worker."""

    def slow(address: str) -> str | None:
        body = get(address)
        time.sleep(pause_ms / 1000)
        return body

    return slow if pause_ms else get


def _ids(stored: DataFrame, column: str) -> DataFrame:
    return stored.select(F.col(column).alias("id")) if column in stored.columns else stored.select(F.lit(None).cast("string").alias("id")).limit(0)


def _documents(rows: DataFrame, source: str, method: str, now: int, *more: Column) -> DataFrame:
    at = F.lit(now).cast("long")
    return rows.select(
        "url", F.lit(source).alias("source"), F.lit(method).alias("method"), "raw_content", "raw_sha256", "parsed_text", "title", at.alias("fetched_at"), at.alias("checked_at"), *more
    )


def ncbi(
    spark: SparkSession, source: str, db: str, terms: list[str], stored: DataFrame, get: Get, now: int, max_docs: int = 0, fresh_seconds: int = 0, pause_ms: int = 0, **options: object
) -> DataFrame | None:
    """Documents of searches, with outcome. max_docs bounds the ids of the source, stored ones included; 0 is no bound.

    Of ids that are new, those whose URL is stored and fresh are not fetched; others are new, changed or unchanged by their hash.
    """
    own = stored.where(F.col("source") == source)
    taken = cut(_ids(own, "ncbi_id").where("id is not null").distinct(), "taken")
    budget = None
    if max_docs:
        budget = 0 if own.count() >= max_docs else max_docs - taken.count()
    asked = {k: str(v) for k, v in options.items() if v}
    fetch = web.build_url(asked.get("base", NCBI_BASE) + "/efetch.fcgi", {"db": db, "retmode": "xml"} | _named(asked))

    def save(hits: DataFrame) -> DataFrame:
        found = hits.select(web.ncbi_article_url(F.lit(source), F.col("id")).alias("url"), F.col("id").alias("ncbi_id"), "term")
        fresh = stored.where(ingest.is_fresh(F.col("fetched_at"), now, fresh_seconds)).select("url")
        found = found.join(fresh, "url", "left_anti")
        pages = readers.page_rows(found, polite(get, pause_ms), F.concat(F.lit(fetch + "&id="), F.url_encode("ncbi_id")))
        rows = _documents(pages, source, "ncbi_eutils", now, F.lit(db).alias("ncbi_db"), F.col("ncbi_id"), F.col("term"))
        return ingest.classify(rows, stored, now, 0)

    return gather(spark, NCBI, get, terms, taken, save, budget, by_saved=False, db=db, pause_ms=pause_ms, **asked)


def plos(spark: SparkSession, source: str, query: str, stored: DataFrame, get: Get, now: int, max_docs: int = 1000, pause_ms: int = 0, **options: object) -> DataFrame | None:
    """New documents of a search, at most max_docs of them in this call. Stored ones are left as they are and not counted."""

    def save(hits: DataFrame) -> DataFrame:
        found = hits.select(F.concat(F.lit(PLOS_ARTICLE), F.col("id")).alias("url"), F.col("id").alias("doi"), F.col("title").alias("title_display"))
        pages = readers.page_rows(found, polite(get, pause_ms), F.col("url"), F.col("title_display"))
        return _documents(pages, source, "plos_api", now, F.col("doi")).withColumn("outcome", F.lit("new"))

    prefix = len(PLOS_ARTICLE) + 1
    taken = stored.where(F.startswith("url", F.lit(PLOS_ARTICLE))).select(F.substr("url", F.lit(prefix)).alias("id"))
    return gather(spark, PLOS, get, [query], taken, save, max_docs, by_saved=True, pause_ms=pause_ms, **options)


def wikipedia(spark: SparkSession, queries: list[str], names: DataFrame, get: Get, max_docs: int = 5000, least_words: int = 500, pause_ms: int = 0, **options: object) -> DataFrame | None:
    """(name, body, metadata) of articles, as sinks.articles makes them, at most max_docs. names (name): those that are there already,
    in any case; a hit whose name is taken is not fetched."""
    lower = cut(names.select(F.lower("name").alias("_name")).distinct(), "names")
    safe = F.lower(web.safe_title(F.col("id")))
    made: list[DataFrame] = []

    def save(hits: DataFrame) -> DataFrame:
        there = reduce(DataFrame.union, [lower, *(m.select(F.lower("name")) for m in made)])
        titles = hits.withColumn("_name", safe).join(there, "_name", "left_anti").select(F.col("id").alias("title"), F.col("term").alias("category"))
        texts = readers.wikipedia_articles(titles, polite(get, pause_ms), str(options.get("base", WIKIPEDIA_API)))
        made.append(cut(sinks.articles(texts.join(titles, "title"), least_words), "articles"))
        return made[-1]

    return gather(spark, WIKIPEDIA, get, queries, spark.createDataFrame([], "id string"), save, max_docs, by_saved=True, pause_ms=pause_ms, **options)
