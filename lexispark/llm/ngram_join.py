"""N-gram Jaccard join: MinHash bands find pairs of documents, full n-gram sets verify them.

1. Each document becomes its set of hashed word n-grams; documents with one set are one node (copies never make pairs).
2. Nodes meet in buckets of band hashes. ``bands_for`` chooses bands and rows for the recall wanted at the threshold. A bucket
   gives links from its members to its smallest member, never all pairs.
3. Connected buckets are candidate components. Each is verified on whole n-gram sets in cells of bounded size: a component of
   more n-grams than a cell holds is dealt to blocks, and every pair of blocks is a cell. A cell emits, for each node, how many
   verified links it has and the smallest node that they lead to; pairs stay inside.
4. Verified links make the classes.

Defined results: words are runs of word characters of the lower-cased text; a text of fewer than n words is one n-gram of all
its words; null texts and texts without a word have no n-grams, no links and a class of their own; rows of one doc_id are one
document, that of the longest of their texts; rows without a doc_id have no name to link by and are not returned (the pipeline names them
first); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import buckets_for, cut, forget_others, one_row_an_id, remembers
from lexispark.llm.components import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Hashes in a cell's block: 8 bytes each.
CELL = 500_000
_WORD = re.compile(r"\w+")
#: Words whose hashes a Python worker remembers.
_REMEMBERED = 400_000
_hashes: dict[str, int] = {}
remembers("ngram_join", _hashes.clear)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 7) -> tuple[int, int]:
    """(bands, rows): so many bands that a pair at the threshold meets in one with the recall wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_hashes) > _REMEMBERED:
        _hashes.clear()
    ids = list(map(_hashes.get, words))
    if None in ids:
        for w in set(words):
            if w not in _hashes:
                _hashes[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        ids = list(map(_hashes.get, words))
    h = np.array(ids, dtype=np.uint64)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, 0x9E3779B97F4A7C15 + width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(grams: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """One 64-bit key for each band of a MinHash signature."""
    rng = np.random.default_rng(seed)
    k = bands * rows
    a = rng.integers(1, 1 << 32, size=(k, 1), dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, size=(k, 1), dtype=np.uint32)
    x = (grams ^ (grams >> np.uint64(29))).astype(np.uint32)
    low = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[None, at : at + 2048] * a + b).min(axis=1), out=low)
    mix = rng.integers(1, 1 << 63, size=rows, dtype=np.uint64) | np.uint64(1)
    key = (low.reshape(bands, rows).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (key ^ (key >> np.uint64(33))).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, same, n_grams, keys) of each document; ``same`` is a digest of its whole n-gram set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_others("ngram_join")
        for batch in batches:
            same, count, keys = [], [], []
            for t in batch[text]:
                g = ngrams(t, n)
                same.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                count.append(len(g))
                keys.append(band_keys(g, bands, rows) if len(g) else np.zeros(0, dtype=np.int64))
            yield pd.DataFrame({"id": batch[key], "same": same, "n_grams": count, "keys": keys})

    return docs.select(key, text).mapInPandas(run, "id long, same binary, n_grams long, keys array<long>")


def verify(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links and the smallest node that they lead to, for each node of a cell.

    side: 0 or 1. If both occur, only pairs of unlike sides count. Nodes are compared through postings of their n-grams, rarest
    first: two sets of the wanted similarity share one of the first (1 - threshold) of each.
    """
    m = len(sets)
    links, parent = np.zeros(m, dtype=np.int64), list(range(m))
    sizes = np.array([len(s) for s in sets])
    if m < 2:
        return links, ids
    both = len(set(side.tolist())) > 1
    grams, codes, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(codes, kind="stable")
    posting, start = owner[order], np.concatenate(([0], np.cumsum(freq)))
    bounds = np.concatenate(([0], np.cumsum(sizes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def gather(c: np.ndarray) -> np.ndarray:
        """Owners of the postings of these n-grams, one after the other."""
        n = freq[c]
        at = np.repeat(start[c] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return posting[at]

    for i in range(m):
        c = codes[bounds[i] : bounds[i + 1]]
        head = c[np.argsort(freq[c], kind="stable")[: sizes[i] - math.ceil(threshold * sizes[i] - 1e-9) + 1]]
        near = np.unique(gather(head[freq[head] > 1]))
        near = near[near > i]
        if both:
            near = near[side[near] != side[i]]
        near = near[(sizes[near] >= threshold * sizes[i] - 1e-9) & (sizes[i] >= threshold * sizes[near] - 1e-9)]
        if not len(near):
            continue
        if len(near) > 8:
            shared = np.bincount(gather(c), minlength=m)[near]
        else:
            shared = np.array([np.isin(sets[j], sets[i], assume_unique=True).sum() for j in near])
        near = near[shared >= threshold * (sizes[i] + sizes[near] - shared) - 1e-9]
        links[i] += len(near)
        links[near] += 1
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                a, b = (a, b) if ids[a] < ids[b] else (b, a)
                parent[b] = a
    return links, ids[[find(i) for i in range(m)]]


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL
) -> DataFrame:
    """(doc_id, class_id, rep_id, n_copies, n_links) for each document.

    class_id: smallest doc_id that verified links lead to; rep_id: smallest doc_id with the same n-gram set; n_copies: documents
    with that set; n_links: other sets at or above the threshold.
    """
    bands, rows = bands_for(threshold, recall)
    docs = one_row_an_id(docs.where(F.col(key).isNotNull()).select(key, text), key, text)
    signed = cut(signatures(docs, key, text, n, bands, rows), "signatures")
    nodes = signed.where("same is not null").groupBy("same").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("keys").alias("keys")
    )
    banded = nodes.select("rep", F.explode("keys").alias("k"))
    shared = banded.groupBy("k").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = banded.join(shared, "k").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    parts = cut(connected_components(stars), "candidates")

    # Blocks of components, by the number of their n-grams.
    members = parts.join(signed.select(F.col("id").alias("doc"), "n_grams").where("n_grams > 0").dropDuplicates(["doc"]), F.col("id") == F.col("doc")).select("id", "component", "n_grams")
    weight = members.groupBy("component").agg(F.ceil(F.sum("n_grams") / F.lit(float(cell))).cast("int").alias("blocks"), F.sum("n_grams").alias("w"))
    weight = cut(weight, "blocks")
    bins = buckets_for(weight.where("blocks = 1").agg(F.sum("w")).first()[0], cell)
    placed = members.join(weight, "component").select(
        "id", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block")
    )
    placed = placed.join(docs.select(F.col(key).alias("id"), F.col(text).alias("_text")), "id")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_others("ngram_join")
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "component": b["component"], "blocks": b["blocks"], "block": b["block"], "grams": [ngrams(t, n).tobytes() for t in b["_text"]]})

    sets = placed.mapInPandas(grams, "id long, component long, blocks int, block int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sets = sets.select("*", other.alias("other"))
    cells = sets.select(
        "id",
        "component",
        "blocks",
        "block",
        "grams",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("cell"),
        (F.col("blocks") > 1).alias("split"),
    )

    def check(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in group.groupby("component"):
            g = g.drop_duplicates("id")
            side = (g["block"] != g["lo"]).to_numpy(dtype=int)
            if g["lo"].iloc[0] != g["hi"].iloc[0] and len(set(side)) < 2:
                links, low = np.zeros(len(g), dtype=np.int64), g["id"].to_numpy()
            else:
                links, low = verify(g["id"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in g["grams"]], side, threshold)
            out.append(pd.DataFrame({"id": g["id"].to_numpy(), "low": low, "links": links, "split": g["blocks"].to_numpy() > 1}))
        return pd.concat(out)

    found = cut(cells.groupBy("cell", "split", "lo", "hi").applyInPandas(check, "id long, low long, links long, split boolean"), "links")
    whole = found.where(~F.col("split")).select("id", F.col("low").alias("class"))
    joined = connected_components(found.where("split").select(F.col("id").alias("a"), F.col("low").alias("b"))).select("id", F.col("component").alias("class"))
    classes = whole.union(joined)
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    result = nodes.select("same", "rep", "n_copies").join(counts, F.col("rep") == counts["id"], "left").drop("id")
    result = result.join(classes.dropDuplicates(["id"]), F.col("rep") == classes["id"], "left").drop("id")
    return signed.select("id", "same").join(result, "same", "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("class", "rep", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("rep_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
