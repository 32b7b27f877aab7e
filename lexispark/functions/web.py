"""URLs and HTML of crawled pages as columns."""

from __future__ import annotations

import html
import re
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions that are not followed, and patterns of what is cut out of a page or found in it.
SKIPPED = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip", ".rar", ".7z", ".tar", ".gz", ".mp3", ".mp4", ".avi", ".mov", ".css", ".js", ".ico")
WITHOUT_TEXT = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>")
BRACKETED_NUMBER = r"(?U)\[\s*\d+\s*\]"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HREF = r"""(?is)href\s*=\s*("[^"]+"|'[^']+'|[^\s"'<>]+)"""
NO_LINK = "^(#|javascript:|mailto:)"


def strip_query(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(url, "^[^?#]*", 0)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", group)


def normalize_url(url: Column) -> Column:
    """Trimmed, http or https only, scheme and host in lower case, a path of / at least, query kept, fragment dropped; else null."""
    u = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    query = _part(u, 4)
    path = _part(u, 3)
    out = F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.lower(_part(u, 1)).isin("http", "https"), out)


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.regexp_extract(F.lower(_part(url, 2)), r"([^@:]*)(?::[^@]*)?$", 1)


def is_allowed_domain(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(url)
    wanted = [d for d in (str(d).lower().strip() for d in domains) if d]
    out = F.lit(False)
    for d in wanted:
        out = out | (h == d) | F.endswith(h, F.lit("." + d))
    return (h != "") & out


def looks_like_html(url: Column) -> Column:
    pattern = "(" + "|".join(re.escape(x) for x in SKIPPED) + ")$"
    return ~F.lower(_part(url, 3)).rlike(pattern)


def is_document(url: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the URL or in it without its query."""
    return url.rlike(pattern) | strip_query(url).rlike(pattern)


def may_follow(url: Column, follow: str | None, document: Column) -> Column:
    return (url.rlike(follow) | document) if follow else F.lit(True)


def ncbi_article_url(source: Column, doc_id: Column) -> Column:
    return (
        F.when(source == "pmc", F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), doc_id, F.lit("/")))
        .when(source == "pubmed", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), doc_id, F.lit("/")))
        .otherwise(F.concat(source, F.lit(":"), doc_id))
    )


def url_from_meta(source: Column, url: Column, doc_id: Column) -> Column:
    """The URL without its query, else one made from the id, else null."""
    given, number = F.trim(url), F.trim(doc_id)
    return F.coalesce(F.when(given != "", strip_query(given)), F.when(number != "", ncbi_article_url(source, number)))


def build_url(base: str, params: dict[str, str]) -> str:
    return base + ("&" if "?" in base else "?") + urllib.parse.urlencode(params)


def safe_title(title: Column) -> Column:
    """A file name of a title: word characters, white space and hyphens only, spaces as underscores, 100 characters."""
    kept = F.regexp_replace(title, r"(?U)[^\w\s-]", "")
    return F.substring(F.translate(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""), " ", "_"), 1, 100)


def word_count(text: Column) -> Column:
    """Words by Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def text_path(path: Column) -> Column:
    """The parsed text's path beside a raw file's."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ".txt")


@F.pandas_udf(T.StringType())
def unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references of HTML 5, which the JVM has no function for."""
    for batch in texts:
        yield pd.Series([html.unescape(t) if t is not None and "&" in t else t for t in batch], dtype=object)


def _collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def html_text(page: Column) -> Column:
    """Text of a page: scripts, styles, noscript, comments and tags become spaces in this order, references are decoded, numbers in
    brackets dropped, white space collapsed."""
    for pattern in WITHOUT_TEXT:
        page = F.regexp_replace(page, pattern, " ")
    return _collapse(F.regexp_replace(unescape(page), BRACKETED_NUMBER, ""))


def html_title(page: Column) -> Column:
    """The first title, decoded and collapsed; null if there is none."""
    found = F.get(F.regexp_extract_all(page, F.lit(TITLE), F.lit(1)), F.lit(0))
    return _collapse(unescape(found))


def hrefs(page: Column) -> Column:
    """Targets of href attributes in order; blank ones, fragments, javascript: and mailto: are left out."""
    attribute = F.regexp_extract_all(page, F.lit(HREF), F.lit(1))
    clean = F.transform(attribute, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\"']|[\"']$", ""), r"(?U)^\s+|\s+$", ""))
    return F.filter(clean, lambda x: (x != "") & ~x.rlike(NO_LINK))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _absolute(found: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[urllib.parse.urljoin(b or "", h) for h in (hs if hs is not None else [])] for hs, b in zip(found, base, strict=True)], dtype=object)


def extract_links(page: Column, base: Column) -> Column:
    """Absolute, normalised links of a page, with repeats and in order."""
    return F.filter(F.transform(_absolute(hrefs(page), base), normalize_url), lambda u: u.isNotNull())
