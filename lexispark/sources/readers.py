"""Where rows come from: tables, lines, JSON, files, and pages by a function that fetches them."""

from __future__ import annotations

import gzip
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions import web

HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; lexispark)", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
META = "source string, raw_path string, url string, id string, fetched_at long"


def scan(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """A Parquet corpus with a parsed text; three fields are read."""
    rows = spark.read.parquet(path).where(F.col("parsed_text").isNotNull()).select("url", "title", "parsed_text")
    return rows.orderBy("url").limit(limit) if limit else rows


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, text) of lines with two tabs at least; the rest of a line is its text."""
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].alias("url"), parts[1].alias("title"), parts[2].alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, from 1; a file is one task's, as only its whole tells where a line is."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.posexplode(F.split("value", "\\r?\\n"))
    return whole.select(lines.alias("line_no", "value")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def to_line(url: str, title: str, text: str) -> list:
    """Columns for a TSV line: tabs and line ends become spaces."""
    return [F.translate(F.col(c), "\t\n", "  ").alias(c) for c in (url, title, text)]


def jsonl(spark: SparkSession, path: str, schema: str = META) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are skipped."""
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def files(spark: SparkSession, path: str | list[str], glob: str = "*", limit: int = 0) -> DataFrame:
    """(path, content) of whole files as text; bytes that are no UTF-8 are replaced. With a limit, the first ones by path: these are
    chosen by a scan of paths alone, and no other file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if limit:
        chosen = [r["path"] for r in found.load(path).select("path").orderBy("path").limit(limit).collect()]
        if not chosen:
            return spark.createDataFrame([], "path string, content string")
        return spark.read.format("binaryFile").load([_escaped(p) for p in chosen]).select("path", _decoded("content").alias("content"))
    return found.load(path).select("path", _decoded("content").alias("content"))


def _escaped(path: str) -> str:
    """A path that is no pattern, whatever it holds."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode("utf-8", "replace") for c in content], dtype=object)


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, doi, title, parsed_text, raw_content) of one JSON file each; a doi that is missing comes from the file's name."""
    rows = files(spark, path, "*.json")
    stem = F.regexp_extract("path", r"([^/]*)\.json$", 1)
    field = lambda name: F.get_json_object("content", f"$.{name}")
    rows = rows.withColumn("doi", F.coalesce(field("doi"), F.translate(stem, "_", "/")))
    return rows.select(
        F.concat(F.lit("https://www.biorxiv.org/content/"), F.col("doi")).alias("url"), "doi", F.coalesce(field("title"), F.col("doi")).alias("title"),
        F.coalesce(field("abstract"), F.lit("")).alias("parsed_text"), F.col("content").alias("raw_content"),
    )


def fetch_with(get: Callable[[str], str | None]) -> Callable[[DataFrame], DataFrame]:
    """(url) -> (url, html) by a function that workers call for each URL; what it gives nothing for is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(u, get(u)) for u in b["url"]]
            yield pd.DataFrame([g for g in got if g[1] is not None], columns=["url", "html"])

    return lambda urls: urls.select("url").mapInPandas(run, "url string, html string")


class Page(NamedTuple):
    status: int
    headers: dict[str, str]
    text: str


def decoded_body(body: bytes, headers: Mapping[str, str]) -> str:
    """Text of a body: unpacked if it came as gzip, by the charset of its header, else of a meta element near its start, else UTF-8."""
    low = {k.lower(): v for k, v in headers.items()}
    if "gzip" in low.get("content-encoding", "").lower():
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            pass  # said to be packed and is not
    named = _CHARSET.search(low.get("content-type", "")) or _CHARSET.search(body[:4096].decode("ascii", "ignore"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def http_get(url: str, timeout: float = 30, retries: int = 3, pause: float = 1.0, opener: Callable = urllib.request.urlopen) -> Page | None:
    """A page, after some tries with longer and longer pauses; none if all fail. 304 is an answer, without a text."""
    try:
        request = urllib.request.Request(url, headers=HEADERS)
    except ValueError:  # no address; one bad link must not end a crawl
        return None
    for attempt in range(1, retries + 1):
        try:
            with opener(request, timeout=timeout) as response:
                headers = dict(response.headers.items())
                return Page(getattr(response, "status", 200) or 200, headers, decoded_body(response.read(), headers))
        except urllib.error.HTTPError as e:
            if e.code == 304:
                return Page(304, dict(e.headers.items()) if e.headers else {}, "")
            if e.code < 500 and e.code not in (408, 425, 429):
                return None  # asking again cannot heal it
            time.sleep(pause * attempt)
        except OSError:
            time.sleep(pause * attempt)
    return None


def http_text(url: str, timeout: float = 30, retries: int = 3) -> str | None:
    """For fetch_with: the text of a page that answers with 200."""
    page = http_get(url, timeout, retries)
    return page.text if page is not None and page.status == 200 else None


def fetch_from_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """(url) -> (url, html) from a table of pages, for crawls without a network."""
    return lambda urls: urls.join(pages.select("url", "html"), "url")


def page_rows(found: DataFrame, get: Callable[[str], str | None], address: Column, title: Column | None = None) -> DataFrame:
    """found (url, ...) with raw_content, raw_sha256, parsed_text and title of what lies at each address. Rows without an answer go."""
    asked = found.withColumn("_address", address)
    pages = fetch_with(get)(asked.select(F.col("_address").alias("url")).distinct()).withColumnRenamed("url", "_address")
    own = [] if title is None else [title]
    return asked.join(pages, "_address").select(
        *found.columns, F.col("html").alias("raw_content"), F.sha2("html", 256).alias("raw_sha256"), web.html_text(F.col("html")).alias("parsed_text"),
        F.coalesce(*own, F.nullif(web.html_title(F.col("html")), F.lit("")), F.col("doi") if "doi" in found.columns else F.col("url")).alias("title"),
    )


def wikipedia_articles(titles: DataFrame, get: Callable[[str], str | None], api: str = "https://en.wikipedia.org/w/api.php", site: str = "https://en.wikipedia.org/wiki/") -> DataFrame:
    """(title, url, text): plain text of articles by (title); titles without a page or a text are left out."""
    fixed = web.build_url(api, {"action": "query", "prop": "extracts|info", "explaintext": 1, "exsectionformat": "plain", "inprop": "url", "format": "json"})
    asked = titles.select("title", F.concat(F.lit(fixed + "&titles="), F.url_encode("title")).alias("url"))
    pages = F.from_json(F.get_json_object("html", "$.query.pages"), "map<string, struct<extract:string, fullurl:string>>")
    got = asked.join(fetch_with(get)(asked), "url").select("title", F.explode(pages).alias("page_id", "p"))
    address = F.coalesce("p.fullurl", F.concat(F.lit(site), F.url_encode(F.translate("title", " ", "_"))))
    return got.where("page_id <> '-1' and coalesce(p.extract, '') <> ''").select("title", address.alias("url"), F.col("p.extract").alias("text"))


def read_config(path: str) -> dict:
    """A YAML or JSON mapping; anything else is empty. YAML needs its package, which is optional."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    return data if isinstance(data, dict) else {}
