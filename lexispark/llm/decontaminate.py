"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

An alignment of M matched words in r unbroken runs scores at most 2 M - (r - 1), which is M + B + 1 for B = M - r pairs of
neighbouring words in common. That says how many words and how many pairs of an item a copy must hold, whatever the editing. So
an item's seeds are its rarest pairs, as many as no copy can lack all of, or its rarest words where a copy needs no pair (short
items); a document without a seed of an item is no candidate. A candidate, and then a window as long as an alignment can be, is left out only if its words and pairs in
common cannot add up to the threshold. Seeds and bounds are exact: nothing that full alignment finds is lost. The windows
left are aligned inside the task that reads the document: the corpus is never shuffled, and read once.

Items reach the tasks as one table of words. Its size is checked: more than ITEM_WORDS words are dealt to slices of items by a
hash, each with a pass of its own, so that neither a task nor the driver holds more at a time.

Defined results: words are runs of word characters of the lower-cased text; null or empty documents and items without a word
match nothing; an item of fewer than n words has to occur whole; repeated items and repeated documents each give
rows; of several passages of a document the best counts, the first on a tie; rows without an id keep
their null, and ids of any size stay exact beside it; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import buckets_for, cut, forget_others

#: Items of fewer words have to occur whole.
N = 3
#: The bounds of matches() and windows() rest on these.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of an item's perfect alignment score from which a passage is a copy.
THRESHOLD = 0.55
ITEM_WORDS = 2_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)


@dataclass
class Seeds:
    """Which items have a key as a seed, by key."""

    start: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, keys: list[np.ndarray], needed: list[int], n_keys: int) -> Seeds:
        """The rarest keys of each item, so many that a passage with ``needed`` keys of the item must hold one of them.

        Rare are keys of few items; a key that an item repeats counts as often. Items that need none have no seeds.
        """
        every = _joined(keys)
        spread = np.bincount(every, minlength=n_keys) if len(every) else np.zeros(n_keys, dtype=np.int64)
        chosen = []
        for k, need in zip(keys, needed, strict=True):
            order = np.lexsort((k, spread[k]))
            chosen.append(np.unique(k[order[: len(k) - need + 1]]) if need > 0 else k[:0])
        flat = _joined(chosen)
        of = np.repeat(np.arange(len(keys)), [len(c) for c in chosen]) if chosen else flat
        by = np.argsort(flat, kind="stable")
        return cls(np.searchsorted(flat[by], np.arange(n_keys + 1)), of[by])

    def items(self, keys: np.ndarray) -> np.ndarray:
        """Items with a seed among these distinct keys."""
        first, size = self.start[keys], self.start[keys + 1] - self.start[keys]
        return np.unique(self.item[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())])


class Numbers(dict):
    """Numbers of words; -1 for any other word."""

    def __missing__(self, word: str) -> int:
        return -1


def _kinds(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys found, sorted, and how often each occurs; -1 is none."""
    return np.unique(found[found >= 0], return_counts=True)


@dataclass
class Kinds:
    """The distinct keys of each item and how often it has each."""

    start: np.ndarray
    key: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Kinds:
        both = [np.unique(k, return_counts=True) for k in items]
        return cls(np.cumsum([0, *(len(k) for k, _ in both)]), _joined([k for k, _ in both]), _joined([c for _, c in both]))

    def of_item(self, k: int) -> np.ndarray:
        return self.key[self.start[k] : self.start[k + 1]]

    def in_common(self, items: np.ndarray, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each of some items, how many keys it shares with a document (sorted distinct keys), each as often as both hold it."""
        if not len(keys) or not len(items):
            return np.zeros(len(items), dtype=np.int64)
        size = self.start[items + 1] - self.start[items]
        at = np.repeat(self.start[items] - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = self.key[at]
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        shared = np.where(keys[place] == own, np.minimum(self.count[at], times[place]), 0)
        return np.bincount(np.repeat(np.arange(len(items)), size), weights=shared, minlength=len(items)).astype(np.int64)


def _places(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a document holds one of these sorted keys."""
    if not len(keys):
        return np.zeros(len(found), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found


@dataclass
class Items:
    """A slice of the items: their words as numbers, and what each word and each pair of neighbouring words is a seed of."""

    ids: list[int]
    words: list[np.ndarray]
    number: Numbers
    n: int
    pairs: np.ndarray  # sorted codes
    needs: np.ndarray  # the score that a passage needs
    sizes: np.ndarray
    word_keys: Kinds
    pair_keys: Kinds
    word_seeds: Seeds
    pair_seeds: Seeds

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], n: int, threshold: float) -> Items:
        number = Numbers()
        ids, words = [], []
        for i, text in rows:
            if w := words_of(text):
                ids.append(i)
                words.append(np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64))
        codes = [w[:-1] * len(number) + w[1:] for w in words]
        pairs, place = np.unique(_joined(codes), return_inverse=True)
        own_pairs = np.split(place, np.cumsum([len(c) for c in codes])[:-1]) if codes else []
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        needs = MATCH * sizes * np.where(sizes < n, 1.0, threshold)
        # A score of s takes s / 2 words of the item, and s - 1 less its words as pairs: M words and B pairs give M + B + 1 at most.
        least_pairs = [math.ceil(s - 1 - m - 1e-9) for s, m in zip(needs, sizes, strict=True)]
        least_words = [math.ceil(s / MATCH - 1e-9) if p < 1 else 0 for s, p in zip(needs, least_pairs, strict=True)]
        return cls(
            ids, words, number, n, pairs, needs, sizes, Kinds.of(words), Kinds.of(own_pairs),
            Seeds.of(words, least_words, len(number)), Seeds.of(own_pairs, least_pairs, len(pairs)),
        )

    def numbers(self, text: str | None) -> np.ndarray:
        """Numbers of a document's words; -1 for words of no item."""
        return np.array(list(map(self.number.__getitem__, words_of(text))), dtype=np.int64)

    def pairs_of(self, w: np.ndarray) -> np.ndarray:
        """For each word but the last, the index of its pair with the next word; -1 for pairs of no item."""
        out = np.full(max(0, len(w) - 1), -1, dtype=np.int64)
        if len(self.pairs):
            at = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
            g = w[at] * len(self.number) + w[at + 1]
            i = np.minimum(np.searchsorted(self.pairs, g), len(self.pairs) - 1)
            hit = self.pairs[i] == g
            out[at[hit]] = i[hit]
        return out

    def candidates(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Items that a document of these distinct words and pairs can hold a passage of, by their seeds."""
        by_pairs = self.pair_seeds.items(pairs)
        return np.union1d(by_pairs, self.word_seeds.items(words)) if len(self.word_seeds.item) else by_pairs


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of the item in the passage, and where the alignment ends (exclusive)."""
    steps = np.arange(len(passage) + 1) * GAP
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        now = np.maximum(row + GAP, 0)
        np.maximum(now[1:], diagonal, out=now[1:])
        row = np.maximum.accumulate(now - steps) + steps  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def windows(mine: np.ndarray, pairs: np.ndarray, m: int, need: float) -> list[tuple[int, int]]:
    """Stretches of a document that hold every alignment of the needed score. ``mine`` and ``pairs`` are the places of words and
    of pairs of the item."""
    # Each word that the passage has more than the item costs a gap, so it has no more than these.
    length = m + int(MATCH * m - need)
    n = len(mine)
    end = np.minimum(np.arange(n) + length, n)
    total = np.concatenate(([0], np.cumsum(mine)))
    words = np.minimum(total[end] - total[:-1], m)
    total = np.concatenate(([0], np.cumsum(pairs), [0]))
    total[-1] = total[-2]
    both = np.minimum(total[np.maximum(end - 1, np.arange(n))] - total[:n], m - 1)
    # An alignment begins with a word in common.
    starts = np.flatnonzero(mine & (words + both + 1 >= need) & (MATCH * words >= need))
    if not len(starts):
        return []
    apart = np.flatnonzero(np.diff(starts) > length)
    return [(int(a), int(min(n, z + length))) for a, z in zip(starts[np.append(0, apart + 1)], starts[np.append(apart, len(starts) - 1)], strict=True)]


def matches(items: Items, w: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(item index, score, first word, end) of the best passage of w for each item that it holds a copy of."""
    if not len(items.ids) or not (w >= 0).any():
        return []
    pairs, out = items.pairs_of(w), []
    words, doubles = _kinds(w), _kinds(pairs)
    may = items.candidates(words[0], doubles[0])
    n_pairs = items.pair_keys.in_common(may, *doubles)
    near = items.sizes[may] + n_pairs + 1 >= items.needs[may]
    may, n_pairs = may[near], n_pairs[near]
    n_words = items.word_keys.in_common(may, *words)
    for k in may[(MATCH * n_words >= items.needs[may]) & (n_words + n_pairs + 1 >= items.needs[may])].tolist():
        item, need = items.words[k], items.needs[k]
        mine, both = _places(w, items.word_keys.of_item(k)), _places(pairs, items.pair_keys.of_item(k))
        m, best = len(item), (0.0, 0, 0)
        for a, b in windows(mine, both, m, need):
            score, end = align(item, w[a:b])
            if score >= need and score / (MATCH * m) > best[0]:
                back, length = align(item[::-1], w[a : a + end][::-1])
                best = (score / (MATCH * m), a + end - length, a + end)
        if best[0]:
            out.append((k, *best))
    return out


class Slices(Sequence):
    """The items in slices of about item_words words, each read when it is asked for."""

    def __init__(self, items: DataFrame, key: str, text: str, n: int, count: int, threshold: float = THRESHOLD):
        self.items, self.key, self.text, self.n, self.count, self.threshold = items, key, text, n, count, threshold

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, s: int) -> Items:
        if not 0 <= s < self.count:
            raise IndexError(s)
        own = self.items.where(F.pmod(F.xxhash64(self.key, self.text), F.lit(self.count)) == s).select(self.key, self.text)
        return Items.of([(r[0], r[1]) for r in own.orderBy(self.key, self.text).collect()], self.n, self.threshold)  # about item_words words at most


def prepare(items: DataFrame, key: str = "item_id", text: str = "text", n: int = N, item_words: int = ITEM_WORDS, threshold: float = THRESHOLD) -> Slices:
    """All items, in slices of about item_words words, counted by the rule that cuts them. No frequencies of documents are needed."""
    size = items.agg(F.sum(F.size(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+"), F.lit(0))))).first()[0]
    return Slices(items, key, text, n, buckets_for(size, item_words), threshold)


def find(docs: DataFrame, slices: Sequence[Items], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): passages that copy an item, edited or not. One pass for each slice, whose tasks
    get this slice alone."""

    def passages(part: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(row, part.ids[k], s, a, z) for row, t in enumerate(b.column(1).to_pylist()) for k, s, a, z in matches(part, part.numbers(t))]
                rows, items, scores, firsts, ends = ([x[c] for x in out] for c in range(5))
                # Ids of documents are taken as they are: as numbers of pandas they would be floats beside a null.
                columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()), pa.array(ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "first_word", "end_word"])

        ids = F.col(key).cast("long").alias("doc_id")
        return docs.select(ids, F.col(text).alias("text")).mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")

    if len(slices) == 1:
        return passages(slices[0])
    # Written one after another, so that one slice at a time is in memory.
    return reduce(DataFrame.union, [cut(passages(slices[s]), "passages") for s in range(len(slices))])


def drop_contaminated(docs: DataFrame, slices: Sequence[Items], text: str = "text") -> DataFrame:
    """docs without those that hold a copy of any item. One pass for each slice, over what the slices before it left."""
    for s in range(len(slices)):
        docs = docs.where(~is_contaminated(F.col(text), slices[s]))
        if s < len(slices) - 1:
            docs = cut(docs, "clean")
    return docs


def is_contaminated(text: Column, part: Items) -> Column:
    """Whether a text holds a copy of an item of a slice."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_others("decontaminate")
        for texts in batches:
            yield pd.Series([bool(matches(part, part.numbers(t))) for t in texts], dtype=bool)

    return run(text)
