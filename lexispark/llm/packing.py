"""Best-fit packing by sums of squares: each piece goes where the squared counts of open bins per residual gap become smallest.

Documents become ids and are cut into pieces of the capacity inside map tasks, so only (id, piece, start, length, checksum)
is written. Pieces, counted then, are dealt in turn into groups of a fixed size and each group is packed in one task; the number
of groups grows with the pieces, and neither a very long document nor repeated ids weigh on one group. In a group, pieces come
longest first, which leaves short ones to fill the gaps; a bin is opened only where no open one has room, as each costs a sequence.

Defined results: a null or empty text is the single end id; a table without rows gives none; rows that repeat a document
are packed each, told apart by their order in the group; documents longer than the capacity are the only ones cut; ties in length go by
id and piece, rows without an id last; ids of any size stay exact beside nulls; further columns are ignored, and names of the result that the input has do not matter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import buckets_for, cut, forget_others, remembers

CAPACITY = 4096
END_ID = 1
#: Pieces in one group. A group leaves a bin or two that are not full.
GROUP_PIECES = 8192
#: Words that a Python worker remembers, and characters of these; beyond either, the memory starts anew.
CACHE_WORDS, CACHE_CHARACTERS = 1_100_000, 16_000_000
#: A longer run of characters is encoded each time and not remembered.
LONG_RUN = 200
_CHUNK = re.compile(r"[^ \n\t\r]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Letters, then at most one run of ASCII marks; the apostrophe is left out, as it begins contractions.
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_encoders: dict = {}
remembers("packing", _encoders.clear)


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, lower-cases and keeps runs of letters apart from the rest.

    A run of non-white-space characters is encoded once and remembered as the bytes of its ids, so that frequent words cost a
    dictionary lookup; the ids of a text are those of its runs. A new run of Latin letters and then ASCII
    marks is put together from the remembered ids of its lower-cased letters and of its marks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.seen, self.characters = Tokenizer.from_file(path), {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Each is letters only, so it is one unit to the tokenizer and its last id carries the end of word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            self.seen.update((w, self._ids(w)) for w in words)
            return
        data, start = ids.tobytes(), 0
        for w, stop in zip(words, (4 * stops).tolist(), strict=True):
            self.seen[w] = data[start:stop]
            start = stop

    def _learn(self, chunks: set[str]) -> None:
        seen, marks, match = self.seen, self.marks, _LATIN.fullmatch
        plain, new = [], set()
        for c in chunks:
            if m := match(c):
                word, mark = m.groups()
                word = word.lower()
                plain.append((c, word, mark))
                if word not in seen:
                    new.add(word)
                if mark not in marks:
                    marks[mark] = self._ids(mark)
            else:
                seen[c] = self._ids(c)
        if new:
            self._learn_words(list(new))
        for c, word, mark in plain:
            seen[c] = seen[word] + marks[mark]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.seen) > CACHE_WORDS or self.characters > CACHE_CHARACTERS:
            self.seen, self.marks, self.characters = {}, {}, 0
        # str.split() also takes four control characters for white space, which the tokenizer does not.
        runs = [((_CHUNK.findall(t) if _CONTROLS.search(t) else t.split()) if t else []) for t in texts]
        missing = set().union(*runs).difference(self.seen)
        long = [x for x in missing if len(x) > LONG_RUN]
        if missing:
            self._learn(missing)
            self.characters += sum(map(len, missing)) - sum(map(len, long))
        out = [b"".join(map(self.seen.__getitem__, run)) for run in runs]
        for x in long:
            del self.seen[x]
        return out


def texts_by_size(column: pa.Array, size: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in slices of about so many bytes, one text at least; others stay in Arrow's memory."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
        yield column.slice(start, end - start).to_pylist()
        start = end


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, and a number to deal by, without a shuffle."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("packing")
        encoder = word_encoder(path)
        # In turn from a place of its own: rows of one task go to different groups, and what is written stays so.
        turn = zlib.crc32(str(TaskContext.get().partitionId()).encode())
        for batch in batches:
            out, rows = [], []
            encoded = (ids for texts in texts_by_size(batch.column("text")) for ids in encoder.encode(texts))
            for row, ids in enumerate(encoded):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part), turn))
                    rows.append(row)
                    turn += 1
            # Ids are taken as they are: as numbers of pandas they would be floats beside a null.
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array([x[c] for x in out], pa.int32() if not c else pa.int64()) for c in range(5))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, fields)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    With N(g) open bins of gap g, a piece of length s turns one bin of gap g into one of gap g - s. The change of the sum of
    squared N over gaps above 0 decides among the open bins with room; ties go to the smallest gap.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(counts[s:])
        if len(gaps):
            change = 2 * (counts[gaps] - counts[gaps + s]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * counts[s]
            gap = int(gaps[int(change.argmin())]) + s
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            b, used, gap = used, used + 1, capacity
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def pack(parts: DataFrame, n_groups: int, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset; one task packs one group."""

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = pack_lengths(group.column("length").to_numpy(), capacity)
        number = group.column("turn")[0].as_py() % n_groups
        placed = group.append_column("sequence_id", pa.array(bins * n_groups + number)).append_column("offset", pa.array(offsets))
        return placed.drop_columns(["turn", "_group"])

    dealt = parts.withColumn("_group", F.pmod("turn", F.lit(n_groups)))
    fields = ", ".join(f"{n} {t}" for n, t in parts.dtypes if n != "turn")
    return dealt.groupBy("_group").applyInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    parts = cut(pieces(docs, path, capacity), "pieces")  # counted and then packed
    return pack(parts, buckets_for(parts.count(), group_pieces), capacity)
