"""SimHash near duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

A fingerprint has 64 bits, each the majority of this bit over the hashes of a document's shingles. The covering masks belong to the
non-zero vectors v of r + 1 bits (r: the radius): a fingerprint bit carries one such vector a, in turn, and mask v keeps it if a and v have an odd number of
bits in common. Any r bits carry vectors that some v is orthogonal to, as r vectors span at most r of r + 1 dimensions; this mask
keeps none of them. So two fingerprints that differ in r bits at most are equal under some mask (7 masks of about 36 bits for r = 2).

Only unlike fingerprints are compared; equal ones are counted in map tasks first. Keys under the masks are counted; fingerprints
that share none are done. The others are linked inside their buckets without pairs: two of one bucket within r bits differ in unmasked bits
only, so they have a point in common that is at most r/2 such bits from either, and each sends itself and the points so near to it. All that
send one point are within r bits of each other, 65 at most for r = 2, so a star joins them exactly. Rows grow with the number of fingerprints
whatever the buckets hold.

Defined results: no words (null or empty text) give fingerprint zero, which links like any other; fewer words than a shingle are one
shingle; repeats count; a bit of exactly half the hashes is 0; a row without an id links others but has itself the smallest id that it
reaches, null if there is none; rows that repeat an id or a text stay, each in its class; a very long text is counted in parts;
only id and text are read, so further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut
from lexispark.llm.components import connected_components

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: Hashes whose bits are counted at a time (64 bytes each).
PART = 1 << 15
#: Fingerprints of more than one in so many rows meet their classes apart; there are at most so many of them.
HOT = 1000


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """bytes.lower and bytes.split know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    joined, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, PART):
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts[at : at + PART], stops[at : at + PART], strict=True)]
        as_bytes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(as_bytes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """As a signed number of the same bits."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return run(text)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius + 1) - 1 masks, of which some keeps none of any ``radius`` bits."""
    vectors = range(1, 1 << (radius + 1))
    carried = [vectors[k % len(vectors)] for k in range(BITS)]
    return [sum(1 << k for k, a in enumerate(carried) if (a & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join all unlike fingerprints (fp, each once) within the radius, an even number; a star for each point that several are near to."""
    if radius % 2:
        raise ValueError("an even radius is needed: points half-way lie as far from either end")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)))
    keyed = fingerprints.select("fp", F.explode(tables).alias("t")).select("fp", "t.mask", "t.key")
    shared = cut(keyed.groupBy("mask", "key").count().where("count > 1").select("mask", "key"), "buckets")
    members = keyed.join(shared, ["mask", "key"], "left_semi")
    free = [[k for k in range(BITS) if not m >> k & 1] for m in masks]
    flips = [[_signed(sum(1 << k for k in some)) for size in range(radius // 2 + 1) for some in itertools.combinations(bits, size)] for bits in free]
    near = F.element_at(F.array(*(F.array(*(F.lit(x).cast("long") for x in xs)) for xs in flips)), F.col("mask") + 1)
    # A point of several masks is the same point.
    points = members.select("fp", F.explode(near).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point")).distinct()
    stars = points.groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    return stars.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 1 << 30)).alias("b")).distinct()


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n, component_id) of rows (doc_id, fp): the rows of each fingerprint and the smallest id that it reaches."""
    each = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "fingerprints")
    found = cut(links(each.select("fp"), radius), "links")
    if found.isEmpty():
        return each.select("fp", "n", F.col("id").alias("component_id"))
    linked = connected_components(found)
    # An id stands for no node, as several fingerprints may have it, or none.
    least = linked.join(each.select(F.col("fp").alias("id"), F.col("id").alias("doc_id")), "id").groupBy("component").agg(F.min("doc_id").alias("found"))
    of_linked = linked.join(least, "component").select(F.col("id").alias("fp"), "found", F.lit(True).alias("linked"))
    return each.join(of_linked, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("found")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 hex digits, component_id the smallest id reachable by links."""
    rows = cut(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "documents")
    of = cut(classes(rows, radius), "classes")
    total = of.agg(F.sum("n")).first()[0] or 0
    # More than a thousandth of the rows each: a thousand rows at most, so they are broadcast, and no fingerprint of the join below is hot.
    hot = of.where(F.col("n") * HOT > total).select("fp", "component_id")
    common = rows.join(F.broadcast(hot), "fp")
    rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(of.where(F.col("n") * HOT <= total).select("fp", "component_id"), "fp")
    both = common.select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
