"""Suffix-array dedup: long strings that also start in an earlier document, by interval expansion on a Burrows-Wheeler transform.

Work is dealt by content. Each window of ``length`` bytes has an anchor: the k-gram of least hash within it, leftmost on a tie; k-grams
that very many documents hold come after all others, so that a common phrase in unlike surroundings is no anchor and fills no bucket. They
are counted first, over all documents, in a table of fixed size; which ones count as common changes the work, never the result.
Windows in a row with one anchor form a segment of at most 2 * length - k bytes. Equal windows have equal anchors, so a bucket
of anchor hashes holds all documents that can share a window; map tasks send compressed segments to buckets of a fixed
expected size. A passage that very many documents hold is aggregated before it is sent: of equal segments that a task sees, those of
its smallest document alone go to the bucket. The others lie in a later document than an equal one, so they are removed whole. What
stays in one bucket whatever is done: unlike windows of common k-grams only, and of a common passage one copy a task.

In a bucket, anchors of one document are dropped. Equal segments are one, with their smallest document. Where an anchor
has different segments, and some flanks agree far enough for a common window, these are concatenated and their transform is
built. From the interval of the empty string, intervals grow to the left by one byte a round; a child's right end not yet set
marks a longest common prefix of as many bytes as there were rounds, and only such children grow further. After ``length`` rounds
what is not set is a common prefix of ``length`` or more, and the suffixes between two ends that are set share a window.

Defined results: a null text is empty; matches are of bytes, inside one document's bounds, on the input; texts shorter than
``length`` lose nothing; ids of any size stay exact beside nulls; doc_id is a key (a row repeated as a whole is the same document, and not earlier than itself); rows of a null
doc_id lose nothing; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import buckets_for, cut, release

LENGTH = 50
GRAM = 20
BUCKET_BYTES = 8_000_000
#: Segments are sent and resolved in this many rounds, by anchor, so that a round's shuffle can go before the next.
ROUNDS = 2
#: Texts that a compression dictionary is made from, about, and its size. It keeps small blobs small, and changes no result.
SAMPLE_TEXTS, DICTIONARY_BYTES = 300, 65_536
CHUNK_BYTES = 2_000_000
#: Cells that k-grams are counted in, by hash; the least count in a task, and its share of a task's counts, of a cell that a task reports;
#: the cells that count as common, at most.
CELLS, COMMON_COUNT, COMMON_SHARE, COMMON_CELLS = 1 << 22, 64, 1e-5, 1 << 16
#: Segments that a task remembers, beside those of one chunk.
SEEN = 200_000
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k bytes in a row, put together from hashes of powers of two."""

    def power(e: int) -> np.uint64:
        return _U(pow(_BASE, e, 1 << 64))

    h, n, parts = (b.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15), 1, []
    out, have = None, 0
    while True:
        if k & n:
            parts.append((n, h))
        if n * 2 > k:
            break
        h = h[:-n] * power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2
    for n, h in reversed(parts):
        if out is None:
            out, have = h, n
        else:
            m = max(0, len(b) - have - n + 1)
            out = out[:m] * power(n) + h[have : have + m]
            have += n
    out ^= out >> _U(31)
    out *= _U(0xBF58476D1CE4E5B9)
    out ^= out >> _U(29)
    return out


def row_hashes(b: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the k bytes from each place."""
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        h = (h + b[at + j] + _U(1)) * _U(_BASE)
        h ^= h >> _U(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        x = np.minimum(x[:-n], x[n:]) if len(x) > n else x[:0]
        n *= 2
    return np.minimum(x[: n - w], x[w - n :]) if n < w and len(x) > w - n else x if n == w else x[:0]


def common_cells(docs: DataFrame, text: str, length: int, k: int) -> np.ndarray:
    """The cells of common k-grams, as one array of bits. Only k-grams of low hashes are counted, as others are hardly ever anchors.

    A task reports cells that stand out in it, which a k-gram of a larger share in all texts does in some task; a fixed number at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)

        def add(texts: list[bytes]) -> None:
            h = gram_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), k)
            counts[:] += np.bincount((h[h < _U(1 << 62)] & _U(CELLS - 1)).astype(np.int64), minlength=CELLS)

        texts, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid and len(raw := t.as_buffer().to_pybytes()) >= length:
                    texts.append(raw)
                    size += len(raw)
                if size >= CHUNK_BYTES:
                    add(texts)
                    texts, size = [], 0
        if texts:
            add(texts)
        found = np.flatnonzero(counts >= max(COMMON_COUNT, COMMON_SHARE * counts.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["cell", "n"])

    found = docs.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.col("n").desc(), "cell").limit(COMMON_CELLS).collect()  # so many numbers at most
    bits = np.zeros(CELLS, dtype=bool)
    bits[[r["cell"] for r in rows]] = True
    return np.packbits(bits)


def segments(b: np.ndarray, ends: np.ndarray, sizes: np.ndarray, length: int, k: int, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The hash of each k-gram of concatenated documents; and (hash, first byte, end, anchor, document index) of each segment. common: for
    each cell, whether its k-grams come last."""
    none = np.zeros(0, dtype=np.int64)
    if len(b) < length:
        return none, none.astype(np.uint64), none, none, none, none
    h = gram_hashes(b, k)
    key = ((h >> _U(1)) & _U(0x7FFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    if common is not None:
        key |= common[(h & _U(CELLS - 1)).astype(np.int64)].astype(np.uint64) << _U(63)
    low = (sliding_min(key, length - k + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(np.arange(len(low)) + length <= ends[owner[: len(low)]])
    if not len(start):
        return h, none.astype(np.uint64), none, none, none, none
    anchor, doc = low[start], owner[start]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = start[np.append(new[1:] - 1, len(start) - 1)]
    return h, h[anchor[new]], start[new], last + length, anchor[new], doc[new]


def _planes(x: np.ndarray) -> bytes:
    """Differences of integers, first bytes first: runs of equal bytes compress well."""
    return np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(raw: bytes, n: int, at: int) -> np.ndarray:
    columns = np.frombuffer(raw, dtype=np.uint8, count=8 * n, offset=at).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(columns.T).view("<i8").ravel())


def dictionary(docs: DataFrame, text: str, n_docs: int) -> bytes:
    """What frequent strings of the texts are, for compression; empty where the sample is too small for one."""
    place = (F.xxhash64(F.col(text)).cast("double") + 2.0**63) / 2.0**64
    some = (place < F.lit(SAMPLE_TEXTS / max(1, n_docs))) & (F.octet_length(text) <= 100_000)
    rows = docs.where(some).select(F.col(text).alias("t")).limit(4 * SAMPLE_TEXTS).collect()
    samples = [r["t"][i : i + 400].encode("utf-8", "replace") for r in rows for i in range(0, len(r["t"]), 400)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


class Seen:
    """Segments that repeated in a task, with their smallest document, so that later chunks need not send them. What is forgotten is sent."""

    def __init__(self, most: int = SEEN):
        self.most = most
        self.a = self.b = np.zeros(0, dtype=np.uint64)
        self.doc = np.zeros(0, dtype=np.int64)

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest known document of each segment, the largest number for unknown ones."""
        out = np.full(len(a), np.iinfo(np.int64).max)
        if len(self.a):
            at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
            hit = (self.a[at] == a) & (self.b[at] == b)
            out[hit] = self.doc[at[hit]]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> None:
        if len(self.a) + len(a) > self.most:
            self.__init__(self.most)
        a, b, doc = np.concatenate((self.a, a)), np.concatenate((self.b, b)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, a))
        first = np.concatenate(([True], a[order][1:] != a[order][:-1]))[: len(a)]
        self.a, self.b, self.doc = (x[order[first]] for x in (a, b, doc))


def marks(h: np.ndarray, first: np.ndarray, size: np.ndarray, anchor: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What tells segments of one anchor apart: the hashes of k-grams that cover the first and the last window, mixed with where these
    are. Both windows cover a segment, as it has at most 2 * length - k bytes."""
    steps = [*range(0, length - k, k), length - k]
    out = []
    for at in (first, first + size - length):
        m = size.astype(np.uint64) * _U(0xFF51AFD7ED558CCD) + (anchor - first).astype(np.uint64)
        for step in steps:
            m = (m ^ h[at + step]) * _U(_BASE)
            m ^= m >> _U(29)
        out.append(m)
    return out[0], out[1]


def repeats(a: np.ndarray, b: np.ndarray, names: np.ndarray, seen: Seen) -> np.ndarray:
    """Which segments have an equal one in a smaller document that the task has seen, this chunk included. ``seen`` learns."""
    order = np.lexsort((names, b, a))
    new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))[: len(a)]
    kind = np.empty(len(a), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    head = order[new]  # of each kind the segment of the smallest document
    known = seen.least(a[head], b[head])
    often = (np.bincount(kind, minlength=len(head)) > 1) & (names[head] < known)
    seen.add(a[head[often]], b[head[often]], names[head[often]])
    return names > np.minimum(names[head], known)[kind]


def send(docs: DataFrame, key: str, text: str, n_buckets: int, length: int, k: int, words: bytes = b"", round_: int = 0, rounds: int = 1, common: np.ndarray | None = None) -> DataFrame:
    """(bucket, blob): compressed segments of a chunk of documents, for each bucket of a round; also runs that are known to go, in
    blobs of their own for any bucket."""

    def chunk(ids: list[int], texts: list[bytes], pack: zstandard.ZstdCompressor, seen: Seen, last: np.ndarray | None) -> pd.DataFrame:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        b = np.frombuffer(b"".join(texts), dtype=np.uint8)
        grams, h, first, end, anchor, doc = segments(b, ends, sizes, length, k, last)
        own = np.flatnonzero((h >> _U(8)) % _U(rounds) == _U(round_))
        h, first, end, anchor, doc = h[own], first[own], end[own], anchor[own], doc[own]
        starts, names = ends - sizes, np.array(ids, dtype=np.int64)
        buckets, blobs = [], []
        if len(h):
            gone = repeats(*marks(grams, first, end - first, anchor, length, k), names[doc], seen)
            if gone.any():
                # Segments of a document overlap, so a copied part is one run.
                d, f, e = doc[gone], first[gone], end[gone]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (f[1:] > e[:-1]))))
                d, f, e = d[new], f[new], e[np.append(new[1:] - 1, len(e) - 1)]
                buckets.append(int(h[0] % _U(n_buckets)))
                blobs.append(pack.compress(b"".join((np.array([-len(d)], dtype="<i8").tobytes(), *map(_planes, (names[d], f - starts[d], e - f))))))
            h, first, end, anchor, doc = (x[~gone] for x in (h, first, end, anchor, doc))
        bucket = ((h >> _U(20)) % _U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, first, end, anchor, doc = bucket[order], first[order], end[order], anchor[order], doc[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, dtype=int)
        for x, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            f, n, d = first[x:z], end[x:z] - first[x:z], doc[x:z]
            body = b[np.repeat(f - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            head = (names[d], f - starts[d], n, anchor[x:z] - f)
            buckets.append(int(bucket[x]))
            blobs.append(pack.compress(b"".join((np.array([z - x], dtype="<i8").tobytes(), *map(_planes, head), body.tobytes()))))
        return pd.DataFrame({"bucket": buckets, "blob": blobs})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, seen = zstandard.ZstdCompressor(level=2, **_codec(words)), Seen()
        last = None if common is None else np.unpackbits(common).astype(bool)
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch[key], batch[text], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    ids.append(i)
                    texts.append(raw)
                    size += len(raw)
                if size >= CHUNK_BYTES:
                    yield chunk(ids, texts, pack, seen, last)
                    ids, texts, size = [], [], 0
        if ids:
            yield chunk(ids, texts, pack, seen, last)

    return docs.select(key, text).where(F.col(key).isNotNull()).mapInPandas(run, "bucket long, blob binary")


def suffix_order(t: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes of t up to their separators (0), ties by position. left: bytes from each place to its separator."""
    n, width = len(t), 7
    padded = np.concatenate((t, np.zeros(width, dtype=t.dtype))).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        key = (key << 9) | np.where(left >= j, padded[j : j + n], 0)
    while True:
        order = np.argsort(key, kind="stable")
        if width > longest:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], key[order][1:] != key[order][:-1])))
        after = np.zeros(n, dtype=np.int64)
        some = np.flatnonzero(left >= width)
        after[some] = rank[some + width]
        key = rank * (n + 2) + after
        width *= 2


def common_prefix_ends(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order, whether the suffix there and the one before it share fewer than ``length`` bytes.

    t has separators of 0 and letters above; order is of its suffixes. Rounds find longest common prefixes of 0, 1, 2 and so on.
    """
    n = len(t)
    bwt = t[order - 1]  # the byte before each suffix; the first suffix follows the last separator
    first = t[order]
    lf = np.empty(n, dtype=np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, dtype=bool)
    known[: int((t == 0).sum()) + 1] = True  # suffixes that are a separator share nothing
    known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        if not len(size):
            break
        place = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(size)), size)
        letter = bwt[place] > 0
        step, owner = lf[place[letter]], owner[letter]
        by = np.argsort(owner * n + step)
        step, owner = step[by], owner[by]
        if not len(step):
            break
        start = np.concatenate(([True], (step[1:] != step[:-1] + 1) | (owner[1:] != owner[:-1]) | (first[step[1:]] != first[step[:-1]])))
        low = step[start]
        high = step[np.append(np.flatnonzero(start)[1:] - 1, len(step) - 1)] + 1
        fresh = ~known[high]
        # Children of unlike parents may end at one place; the first sets it.
        low, high = low[fresh], high[fresh]
        high, at = np.unique(high, return_index=True)
        low = low[at]
        known[high] = True
    return known


def window_minima(contents: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments concatenated in ``contents``: for each byte the smallest document of the window that starts there, -1 if none does.

    Also the first byte of each segment in that array.
    """
    count = len(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    t = np.zeros(int((sizes + 1).sum()), dtype=np.uint16)
    inside = np.ones(len(t), dtype=bool)
    inside[starts + sizes] = False
    t[inside] = contents.astype(np.uint16) + 1
    owner = np.repeat(np.arange(count), sizes + 1)
    left = (starts + sizes)[owner] - np.arange(len(t))
    order = suffix_order(t, left, int(sizes.max()))
    known = common_prefix_ends(t, order, length)
    group = np.cumsum(known[:-1])
    full = left[order] >= length
    best = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, group[full], least[owner[order[full]]])
    out = np.full(len(t), -1, dtype=np.int64)
    out[order[full]] = best[group[full]]
    return out, starts


def _padded(contents: np.ndarray, at: np.ndarray, sizes: np.ndarray, width: int, backward: bool) -> np.ndarray:
    """Rows of ``width`` bytes + 1 from each place (to the left if backward), 0 beyond ``sizes``."""
    steps = np.arange(width)
    index = at[:, None] + (-1 - steps if backward else steps)
    inside = steps < sizes[:, None]
    return np.where(inside, contents[np.where(inside, index, 0)].astype(np.int16) + 1, 0)


def _shared(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each row, the longest prefix in common with another row of its group."""
    packed = np.ascontiguousarray(rows.astype(">u2")).view(f"S{2 * rows.shape[1]}").ravel() if rows.shape[1] else np.zeros(len(rows), dtype="S1")
    order = np.lexsort((packed, group))
    r, g = rows[order], group[order]
    same = (r[1:] == r[:-1]) & (r[1:] > 0)
    common = np.where(g[1:] == g[:-1], np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1), -1)
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = np.maximum(np.concatenate(([-1], common)), np.concatenate((common, [-1])))
    return out


def resolve(blobs: list[bytes], length: int, k: int, words: bytes = b"") -> pd.DataFrame:
    """(id, first, end): runs of bytes to remove that the segments of one bucket show."""
    empty = pd.DataFrame({"id": np.zeros(0, dtype="int64"), "first": np.zeros(0, dtype="int64"), "end": np.zeros(0, dtype="int64")})
    unpack = zstandard.ZstdDecompressor(**_codec(words))
    parts, known = [], []
    for blob in blobs:
        raw = unpack.decompress(blob)
        n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
        if n < 0:
            i, f, z = (_unplanes(raw, -n, 8 - 8 * n * c) for c in range(3))
            known.append(pd.DataFrame({"id": i, "first": f, "end": f + z}))
        else:
            parts.append((*(_unplanes(raw, n, 8 + 8 * n * c) for c in range(4)), np.frombuffer(raw, dtype=np.uint8, offset=8 + 32 * n)))
    found = _resolved(parts, length, k) if parts else None
    return pd.concat([x for x in (*known, found) if x is not None] or [empty], ignore_index=True)


def _resolved(parts: list[tuple[np.ndarray, ...]], length: int, k: int) -> pd.DataFrame | None:
    doc, pos, size, anchor, contents = (np.concatenate(c) for c in zip(*parts, strict=True))
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    grams = row_hashes(contents, start + anchor, k)
    order = np.argsort(grams, kind="stable")
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(np.concatenate(([0], grams[order][1:] != grams[order][:-1])))
    low = np.full(group.max() + 1, np.iinfo(np.int64).max)
    high = np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    many = np.flatnonzero((low < high)[group])
    if not len(many):
        return None
    doc, pos, size, anchor, start, group = doc[many], pos[many], size[many], anchor[many], start[many], group[many]
    # Equal segments of one anchor: the first and the last window, where they are, and the size tell a segment.
    mark = row_hashes(contents, start, length) * _U(0x9E3779B97F4A7C15) + row_hashes(contents, start + size - length, length)
    mark ^= size.astype(np.uint64) * _U(0xFF51AFD7ED558CCD) + anchor.astype(np.uint64)
    order = np.lexsort((doc, mark, group))
    mark, group, doc, pos, size, anchor, start = (x[order] for x in (mark, group, doc, pos, size, anchor, start))
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (mark[1:] != mark[:-1])))
    one = np.cumsum(new) - 1  # number of the segment that each entry has
    head = np.flatnonzero(new)
    least = doc[head]
    kinds = np.bincount(group[head], minlength=group.max() + 1)
    minima_at = np.full(len(head), -1, dtype=np.int64)
    minima = np.zeros(0, dtype=np.int64)
    unlike = np.flatnonzero(kinds[group[head]] > 1)
    if len(unlike):
        h = head[unlike]
        before, behind = anchor[h], size[h] - anchor[h] - k
        reach = _shared(_padded(contents, start[h] + anchor[h], before, length - k, True), group[h])
        reach = reach + k + _shared(_padded(contents, start[h] + anchor[h] + k, behind, length - k, False), group[h])
        unlike = unlike[reach >= length]  # else no window of the segment is in another one
    if len(unlike):
        h = head[unlike]
        n = size[h]
        body = contents[np.repeat(start[h] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        minima, at = window_minima(body, n, least[unlike], length)
        minima_at[unlike] = at
    # Segments that share windows only with their equals.
    alone = (minima_at[one] < 0) & (doc > least[one])
    ids, firsts, ends = [doc[alone]], [pos[alone]], [pos[alone] + size[alone]]
    mixed = np.flatnonzero(minima_at[one] >= 0)
    if len(mixed):
        windows = size[mixed] - length + 1
        within = np.arange(windows.sum()) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
        entry = np.repeat(mixed, windows)
        hit = minima[minima_at[one[entry]] + within] < doc[entry]
        entry, within = entry[hit], within[hit]
        if len(entry):
            new = np.concatenate(([True], (entry[1:] != entry[:-1]) | (within[1:] != within[:-1] + 1)))
            a = np.flatnonzero(new)
            z = np.append(a[1:] - 1, len(entry) - 1)
            ids.append(doc[entry[a]])
            firsts.append(pos[entry[a]] + within[a])
            ends.append(pos[entry[a]] + within[z] + length)
    return pd.DataFrame({"id": np.concatenate(ids), "first": np.concatenate(firsts), "end": np.concatenate(ends)})


def covered(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = GRAM, bucket_bytes: int = BUCKET_BYTES, rounds: int = ROUNDS
) -> DataFrame:
    """(id, first, end): byte runs of documents that a string of ``length`` bytes of an earlier document covers; they may overlap."""
    n_docs, total = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    n_buckets = buckets_for(buckets_for(total, bucket_bytes), rounds)
    words = dictionary(docs, text, n_docs)
    common = common_cells(docs.where(F.col(key).isNotNull()), text, length, k)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return resolve(group["blob"].tolist(), length, k, words)

    out = None
    for r in range(rounds):
        sent = send(docs, key, text, n_buckets, length, k, words, r, rounds, common)
        runs = cut(sent.groupBy("bucket").applyInPandas(run, "id long, first long, end long"), "runs")
        del sent
        release(docs.sparkSession)
        out = runs if out is None else out.union(runs)
    return out


def remove(raw: bytes, firsts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of raw without the runs, and the runs joined where they touch."""
    order = np.argsort(firsts, kind="stable")
    f, e = firsts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], f[1:] > e[:-1])))
    spans = list(zip(f[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist(), strict=True))
    kept, at = [], 0
    for a, z in spans:
        kept.append(raw[at:a])
        at = z
    return b"".join((*kept, raw[at:])), spans


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the remaining bytes of each document, and the byte runs that went."""
    runs = covered(docs, key, text, length, k, bucket_bytes)
    by_doc = runs.groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(by_doc, F.col("doc_id") == F.col("id"), "left")

    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, left = [], [], []
            for t, found in zip(b.column("text"), b.column("runs"), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                kept, spans = raw, []
                if found.is_valid and len(found):
                    kept, spans = remove(raw, found.values.field("first").to_numpy(), found.values.field("end").to_numpy())
                sizes.append(len(raw))
                gone.append([{"first": a, "end": z} for a, z in spans])
                left.append(kept)
            # Ids pass as they are: as numbers of pandas they would be floats beside a null.
            columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, spans_type), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    return rows.mapInArrow(apply, "doc_id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")
