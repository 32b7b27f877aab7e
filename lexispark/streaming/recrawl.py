"""Streams: texts to stems as they come, and pages that are fetched anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import stems
from lexispark.operators.index import postings
from lexispark.operators.ingest import apply_outcomes, classify, one_row_a_key, touch, upsert
from lexispark.operators.store import Store


def stem_stream(texts: DataFrame) -> DataFrame:
    """(doc_id, terms) of a stream of (doc_id, text), row by row, without state."""
    return texts.select("doc_id", stems(F.col("text")).alias("terms"))


def postings_stream(texts: DataFrame) -> DataFrame:
    """(term, doc_id, positions, tf) of a stream of (doc_id, text)."""
    return postings(texts)


def merge_into(store: Store, stream: str, now: Callable[[], int], fresh_seconds: int = 0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over pages (url, raw_content, raw_sha256, parsed_text), as merge_batch, into a store, of which only folders with
    such keys are read and rewritten. A batch that comes again changes nothing; one that broke off is finished with the time it began at."""

    def merge(pages: DataFrame, batch: int) -> None:
        def change(stored: DataFrame, at: int) -> DataFrame:
            fetched = F.lit(at).cast("long")
            seen = classify(one_row_a_key(pages, store.key, None, last=True), stored, at, fresh_seconds, store.key)
            return apply_outcomes(stored, seen.withColumns({"fetched_at": fetched, "checked_at": fetched}), at, store.key)

        store.apply_batch(stream, batch, pages, change, now)

    return merge


def merge_batch(load: Callable[[], DataFrame], save: Callable[[DataFrame], None], now: Callable[[], int], fresh_seconds: int = 0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over pages (url, raw_content, raw_sha256, parsed_text): fresh ones change nothing, equal ones are marked as
    checked, others are upserted. save must put the snapshot elsewhere than load reads it from."""

    def merge(pages: DataFrame, _: int) -> None:
        at, stored = now(), load()
        seen = classify(pages, stored, at, fresh_seconds)
        stored = touch(stored, seen.where("outcome = 'unchanged'"), at)
        fetched = F.lit(at).cast("long")
        new = seen.where("outcome in ('new', 'changed')").drop("outcome").withColumns({"fetched_at": fetched, "checked_at": fetched})
        save(upsert(stored, new))

    return merge
