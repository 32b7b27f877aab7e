"""Line dedup by site-relative frequency, with DataFrame functions only.

A line of a host is boilerplate if more than ``ratio`` of the host's pages, and ``min_line_pages`` pages at least, hold it. Counting shuffles one row for each
host, line fingerprint and map task. A host has at most (its mean number of lines a page) / ratio boilerplate lines,
so its list of them stays short; pages meet it in one join on the host, or in none where all lists are measured to be
small enough to broadcast.

Defined results: a null host is a host of its own; a null text stays null, an empty one stays empty; blank lines are never
dropped; repeated rows count as pages; a share equal to the ratio stays; by default a host of any size is treated alike, ``min_pages`` and
``min_line_pages`` are the caller's; lines are compared whole, by two 64-bit hashes; order of lines stays; an empty table gives no
rows; further columns pass through whatever their names, but for columns named like the counts, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut

#: On the given tables the site line is on 8.6 to 13.2 % of a source's pages, copied prose on less than 5 %.
RATIO = 0.06
#: The query and the pipeline take a line for a site's own if so many pages hold it, too: of few pages a copied text soon has any share.
LINE_PAGES = 5
#: Lists of all hosts together are broadcast up to this many fingerprints (about 16 bytes each).
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.concat(F.lit("\x01"), line)).alias("b"))


def line_frequencies(docs: DataFrame, host: str, text: str, least: int) -> DataFrame:
    """(host, key, n_pages, host_pages): pages that hold each line of ``least`` pages or more, and all pages of the host."""
    pages = docs.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    lines = docs.select(F.col(host).alias("_host"), F.explode(F.array_distinct(F.split(F.col(text), "\n", -1))).alias("_line"))
    lines = lines.where(F.trim("_line") != "").select("_host", _key(F.col("_line")).alias("_key"))
    counts = lines.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.where(F.col("n_pages") >= least).join(pages, counts["_host"].eqNullSafe(pages["_host"])).select(counts["_host"], "_key", "n_pages", "host_pages")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = 1, min_line_pages: int = 1) -> DataFrame:
    """(_host, _keys): the fingerprints of each host's boilerplate lines."""
    # No line on fewer pages can pass a host of min_pages; this leaves few rows for the join with the totals.
    least = max(min_line_pages, int(ratio * min_pages) + 1)
    f = line_frequencies(docs, host, text, least).where((F.col("host_pages") >= min_pages) & (F.col("n_pages") > F.col("host_pages") * ratio))
    return f.groupBy("_host").agg(F.array_sort(F.collect_list("_key")).alias("_keys"))


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = 1,
    broadcast_lines: int = BROADCAST_LINES,
    min_line_pages: int = 1,
    counts: tuple[str, str] | None = ("n_lines", "n_dropped"),
) -> DataFrame:
    """docs with boilerplate lines gone from ``text``, and the counts of lines and of dropped lines under the names given, if any."""
    lists = cut(boilerplate(docs, host, text, ratio, min_pages, min_line_pages), "lines")
    total = lists.agg(F.coalesce(F.sum(F.size("_keys")), F.lit(0)).alias("n")).first()["n"]
    # The row travels as one column, so that no name of its columns meets one of ours.
    d = docs.select(F.struct("*").alias("row"))
    d = d.select("row", F.coalesce(F.col("row")[host], F.lit("")).alias("at"), F.col("row")[host].isNull().alias("none"), F.split(F.col("row")[text], "\n", -1).alias("lines"))
    right = lists.select(F.coalesce(F.col("_host"), F.lit("")).alias("at"), F.col("_host").isNull().alias("none"), F.col("_keys").alias("keys"))
    # A host with a third of all pages makes a skewed join; adaptive execution splits it, as nothing after it groups.
    d = d.join(F.broadcast(right) if total <= broadcast_lines else right, ["at", "none"], "left")
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("keys"), _key(x))))
    d = d.select("row", "lines", kept.alias("kept"))
    known = F.col("lines").isNotNull()
    out = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        out.append(F.when(known, F.size("lines")).otherwise(0).cast("long").alias(counts[0]))
        out.append(F.when(known, F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias(counts[1]))
    return d.select(*out)
