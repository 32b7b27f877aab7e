"""A configuration of sources, compiled to one DataFrame of documents a source.

compile_config reads the mapping once and decides for each source its method and settings: a source's own value counts, 0 included,
else that of ``logic`` for all sources, else the default. A plan is plain data, so it can be looked at and tested before anything is fetched.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import ingest
from lexispark.sources import readers, services
from lexispark.storage import cut

#: Settings by name: what holds where neither the source nor ``logic`` says anything, and what a value of 0 of the source's own means.
SETTINGS = {"sleep_ms": (350, 0), "timeout_s": (30, 30), "retries": (3, 3), "fresh_seconds": (0, 0), "max_pages_total": (0, 0)}
WEB, NCBI, PLOS = "web", "ncbi_eutils", "plos"
Network = Callable[["Source"], services.Get]


@dataclass(frozen=True)
class Source:
    name: str
    method: str
    max_docs: int
    sleep_ms: int
    timeout_s: int
    retries: int
    fresh_seconds: int
    max_pages_total: int
    seeds: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    document: str = ""
    follow: str | None = None
    terms: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


def setting(source: dict, logic: dict, name: str) -> int:
    default, zero = SETTINGS[name]
    if name in source:
        return int(source[name] or zero)
    return int(logic.get(name) or default)


def compile_config(config: dict, only: str | None = None) -> list[Source]:
    """The sources in order, or the one of a name. Entries that are no mappings are left out, as are searches without a database or terms."""
    logic, ncbi = config.get("logic") or {}, config.get("ncbi") or {}
    out = []
    for s in config.get("sources") or []:
        if not isinstance(s, dict) or only and str(s.get("name", "")).strip() != only:
            continue
        method = str(s.get("method", WEB)).strip()
        method = method if method in (NCBI, PLOS) else WEB
        common = {name: setting(s, logic, name) for name in SETTINGS}
        name = str(s.get("name", {NCBI: "ncbi", PLOS: "plos"}.get(method, "web"))).strip()
        if method == NCBI:
            terms = s.get("terms") or s.get("queries") or s.get("term")
            terms = [terms] if isinstance(terms, str) else terms
            if not str(s.get("db", "")).strip() or not terms:
                continue
            options = {
                "db": str(s["db"]).strip(), "page_size": str(int(s.get("esearch_page_size") or services.NCBI.size)), "base": str(ncbi.get("eutils_base") or services.NCBI_BASE),
                "tool": str(ncbi.get("tool") or ""), "email": str(ncbi.get("email") or os.environ.get("NCBI_EMAIL", "")), "api_key": str(ncbi.get("api_key") or os.environ.get("NCBI_API_KEY", "")),
            }
            out.append(Source(name, method, int(s.get("max_docs") or 0), **common, terms=tuple(map(str, terms)), options={k: v for k, v in options.items() if v}))
        elif method == PLOS:
            # Pauses between pages of this service are fixed.
            common |= {"sleep_ms": 0}
            out.append(Source(name, method, int(s.get("max_docs", 1000)), **common, terms=(str(s.get("query", "CRISPR")).strip(),), options={"pause_ms": "1000"}))
        else:
            follow = s.get("follow_url_regex")
            out.append(Source(
                name, method, int(s.get("max_docs") or 0), **common, seeds=tuple(map(str, s.get("seeds") or [])), domains=tuple(map(str, s.get("allowed_domains") or [])),
                document=s.get("doc_url_regex") or "", follow=follow if isinstance(follow, str) and follow else None,
            ))
    return out


def over_http(source: Source) -> services.Get:
    timeout, retries = source.timeout_s, source.retries
    return lambda address: readers.http_text(address, timeout, retries)


def documents(spark: SparkSession, source: Source, stored: DataFrame, get: services.Get, now: int) -> DataFrame | None:
    """Rows of one source with their outcome against what is stored; None where there is nothing to ask for."""
    if source.method == NCBI:
        return services.ncbi(
            spark, source.name, source.options["db"], list(source.terms), stored, get, now, source.max_docs, source.fresh_seconds, source.sleep_ms,
            **{k: v for k, v in source.options.items() if k != "db"},
        )
    if source.method == PLOS:
        pause = int(source.options.get("pause_ms", 0))
        return services.plos(spark, source.name, source.terms[0], stored, get, now, source.max_docs, pause)
    if not source.seeds:
        return None
    seeds = spark.createDataFrame([(s,) for s in source.seeds], "url string")
    fetch = readers.fetch_with(services.polite(get, source.sleep_ms))
    at = F.lit(now).cast("long")
    found = ingest.crawl(seeds, fetch, stored, list(source.domains), source.document, source.follow, now, source.max_pages_total, source.max_docs, source.fresh_seconds, source.name)
    return found.withColumns({"source": F.lit(source.name), "method": F.lit(WEB), "fetched_at": at, "checked_at": at})


def run(spark: SparkSession, plan: list[Source], stored: DataFrame, now: int, network: Network = over_http) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The snapshot after all sources, one after another, and each source's rows with outcomes. Each source sees what those before it stored."""
    seen = {}
    for source in plan:
        rows = documents(spark, source, stored, network(source), now)
        if rows is not None:
            seen[source.name] = cut(rows, "seen")
            stored = cut(ingest.apply_outcomes(stored, seen[source.name], now), "stored")
    return stored, seen


def run_config(spark: SparkSession, path: str, stored: DataFrame, now: int, only: str | None = None, network: Network = over_http) -> tuple[DataFrame, dict[str, DataFrame]]:
    return run(spark, compile_config(readers.read_config(path), only), stored, now, network)
