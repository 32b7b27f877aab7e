"""Language ID by the nearest of several clustered centroids of each language, over TF-IDF vectors of hashed byte trigrams.

Document frequencies, centroids and rejection cosines come from all training rows. Each row is encoded once; rounds of k-means read the
encoded rows and add up vectors in whole numbers, so the sums do not hang on the order of rows. Only the places that rounds start from are
single rows. Then each row and its runs of 1, 2, 4, ... words, which leave no word out, give the cosines that own texts of each length
reach: a text is rejected below LOW_SHARE of their LOW_QUANTILE, for its language and its number of distinct trigrams, as short texts
score low by nature. Cosines are counted in STEPS steps, so a quantile is found among counts. The driver gets some numbers for each
language and trigram, whatever the table's size. Prediction is one pass over the table without a shuffle; each text becomes a vector of
DIMENSIONS floats.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not accepted; a text whose best cosine is
below the rejection cosine keeps its nearest language but is not accepted; a null training language is no label; repeated rows each
count; an empty table gives no rows, further columns and clashing names do not matter; ties go to the language that sorts first; with no training rows every text is ``und``; ids of
training rows need not differ nor be there. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import cut, forget_others

BITS = 12
DIMENSIONS = 1 << BITS
CENTROIDS = 3
#: Rounds of k-means; they end before when no sum changes.
ROUNDS = 12
#: A cluster with less of its language's rows than this is no centroid: a few wrong labels must not found one.
LEAST_SHARE = 0.1
#: What part of which quantile of own texts' cosines is the least that is accepted.
LOW_QUANTILE = 0.01
LOW_SHARE = 0.6
#: Bands of distinct trigrams, by powers of two.
BANDS = BITS + 1
#: Cosines of runs are counted in steps of one part of this, upwards and from one: what has no trigram of a language is below all of its.
STEPS = 10_000
#: Vectors are added up as whole multiples of one part of this, so that sums are exact.
UNIT = 1 << 20
#: Rows that are a matrix of floats at a time.
SLICE = 50
UNKNOWN = "und"
#: Bytes of ASCII that are no letters become one separator.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = np.where([chr(i).isalpha() for i in range(128)], _FOLD[:128], 32)


def has_letter(text: str | None) -> bool:
    """Whether a character is of a letter category, the rule of \\p{L}: not so fractions, superscripts or Roman numerals."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length 1
    owner: np.ndarray  # index into languages for each row
    reject: np.ndarray  # least cosine accepted, by language and band


def folded(text: str | None) -> np.ndarray:
    """The bytes of the lower-cased text; words are set off by single separators, and so are the ends."""
    raw = np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "replace"), dtype=np.uint8)
    b = _FOLD[raw]
    gap = b == 32
    return b[~(gap & np.concatenate(([False], gap[:-1])))]


def trigrams(b: np.ndarray) -> np.ndarray:
    """The hash of each three bytes."""
    b = b.astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def counts(text: str | None) -> np.ndarray:
    """How often each hashed trigram of the lower-cased text occurs; words are set off by single separators."""
    return np.bincount(trigrams(folded(text)), minlength=DIMENSIONS).astype(np.float32)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of counts, which are damped."""
    x = np.log1p(x) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows, with damped counts."""
    return weighted(np.stack([counts(t) for t in texts]), idf)


def packed(x: np.ndarray) -> tuple[bytes, bytes]:
    """Counts of one text: a bit for each trigram, and how often those occur that do, in one byte each or in four."""
    n = x[x > 0]
    return np.packbits(x > 0).tobytes(), n.astype("<u4" if len(n) and n.max() > 255 else "u1").tobytes()


def unpacked(bits: list[bytes], times: list[bytes]) -> np.ndarray:
    """The counts again, a row for each text."""
    there = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(-1, DIMENSIONS // 8), axis=1).astype(bool)
    x = np.zeros(there.shape, dtype=np.float32)
    x[there] = np.concatenate([np.frombuffer(t, dtype="u1" if len(t) == n else "<u4") for t, n in zip(times, there.sum(axis=1), strict=True)] or [[]])
    return x


def encode(rows: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """lang, place (a hash of key and text), bits and times of all rows, on disk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [packed(counts(t)) for t in b["_text"]]
            yield pd.DataFrame({"lang": b["_lang"], "place": b["_place"], "bits": [x for x, _ in both], "times": [x for _, x in both]})

    placed = rows.select(F.xxhash64(*(F.col(c).cast("string") for c in (key, text))).alias("_place"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    return cut(placed.mapInPandas(run, "lang string, place long, bits binary, times binary"), "languages")


def document_frequencies(encoded: DataFrame) -> tuple[np.ndarray, int]:
    """Rows that hold each hashed trigram, over all rows; tasks add up before the shuffle."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                bits = np.frombuffer(b"".join(batch["bits"].iloc[at : at + SLICE]), dtype=np.uint8)
                total += np.unpackbits(bits.reshape(-1, DIMENSIONS // 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(batch)
        yield pd.DataFrame({"bin": np.arange(DIMENSIONS + 1), "df": np.append(total, n)})

    rows = encoded.select("bits").mapInPandas(add, "bin int, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in rows:  # one for each bin, whatever the number of documents
        df[r["bin"]] = r["df"]
    return df[:-1], int(df[-1])


def bounded_sample(docs: DataFrame, by: str, key: list[str], limit: int) -> DataFrame:
    """``limit`` rows at most for each value of ``by``, and one at least: those of the smallest hashes of ``key``. Of rows of one hash
    any stay, so the key should tell rows apart that differ."""
    place = (F.xxhash64(*(F.col(k).cast("string") for k in key)).cast("double") + 2.0**63) / 2.0**64
    placed = docs.withColumn("_place", place)
    share = placed.groupBy(by).agg((F.lit(float(limit)) / F.count(F.lit(1))).alias("_share"), F.min("_place").alias("_least"))
    some = placed.join(F.broadcast(share), by).where((F.col("_place") < F.col("_share")) | (F.col("_place") == F.col("_least")))
    # About ``limit`` rows are left, but for a hash that many have; map tasks keep the first ones already.
    order = F.row_number().over(Window.partitionBy(by).orderBy("_place"))
    return some.withColumn("_order", order).where(F.col("_order") <= limit).drop("_share", "_least", "_order")


def first_centres(encoded: DataFrame, languages: list[str], idf: np.ndarray, k: int) -> list[np.ndarray]:
    """Up to k rows of each language: of each remainder of their places by k the smallest place."""
    least = encoded.groupBy("lang", F.pmod("place", F.lit(k)).alias("_slot")).agg(F.min("place").alias("place")).drop("_slot")
    # Rows of one place are alike.
    rows = encoded.join(F.broadcast(least), ["lang", "place"]).dropDuplicates(["lang", "place"]).toPandas().sort_values("place")
    own = [rows[rows["lang"] == name] for name in languages]
    return [weighted(unpacked(r["bits"].tolist(), r["times"].tolist()), idf) for r in own]


def spherical_clusters(encoded: DataFrame, languages: list[str], idf: np.ndarray, k: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """k-means by cosine over all rows of each language: unit centres and the share of rows of each. A round is one pass over the encoded rows."""
    number, centres, last = {name: i for i, name in enumerate(languages)}, first_centres(encoded, languages, idf, k), None
    columns = [f"s{c}" for c in range(k)]

    def sums(centres: list[np.ndarray]) -> np.ndarray:
        """By language and cluster: the sum of its vectors in parts of UNIT, and at the end its number of rows."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {}
            for batch in batches:
                for at in range(0, len(batch), SLICE):
                    part = batch.iloc[at : at + SLICE]
                    x, of = weighted(unpacked(part["bits"].tolist(), part["times"].tolist()), idf), part["lang"].map(number).to_numpy()
                    for i in np.unique(of):
                        own = x[of == i]
                        near = (own @ centres[i].T).argmax(axis=1)
                        whole = np.rint(own * np.float32(UNIT))
                        t = total.setdefault(i, np.zeros((k, DIMENSIONS + 1), dtype=np.int64))
                        for c in np.unique(near):
                            t[c, :-1] += whole[near == c].sum(axis=0, dtype=np.float64).astype(np.int64)
                            t[c, -1] += (near == c).sum()
            for i, t in total.items():
                yield pd.DataFrame({"language": np.int32(i), "bin": np.arange(DIMENSIONS + 1, dtype=np.int32), **dict(zip(columns, t, strict=True))})

        schema = ", ".join(["language int", "bin int", *(f"{c} long" for c in columns)])
        rows = encoded.select("lang", "bits", "times").mapInPandas(add, schema).groupBy("language", "bin").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        out = np.zeros((len(languages), k, DIMENSIONS + 1), dtype=np.int64)
        out[rows["language"].to_numpy(), :, rows["bin"].to_numpy()] = rows[columns].to_numpy()
        return out

    # The last pass only counts the rows of the centres that the rounds gave.
    for turn in range(rounds + 1):
        got = sums(centres)
        if turn == rounds or (last is not None and (got == last).all()):
            break
        last = got
        for i, old in enumerate(centres):
            new = np.where(got[i, : len(old), -1:] > 0, got[i, : len(old), :-1] / UNIT, old)
            centres[i] = (new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return [(c, got[i, : len(c), -1] / got[i, :, -1].sum()) for i, c in enumerate(centres)]


def bands(x: np.ndarray) -> np.ndarray:
    """The band of each vector: the power of two of its number of distinct trigrams."""
    return np.log2(np.maximum(1, np.count_nonzero(x, axis=1))).astype(int)


def runs(text: str, idf: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band and cosine to the nearest of the centroids ``own`` of each run of 1, 2, 4, ... of the text's words, one after another and the last
    as long as words are left, up to the whole text; runs without a letter are left out. As if each run were a text."""
    b = folded(text)
    n = int(np.count_nonzero(b == 32)) - 1
    if n < 1:
        return np.zeros(0, dtype=int), np.zeros(0)
    known = np.ones(n, dtype=bool) if b.max() < 128 else np.array([w.isalpha() or has_letter(w) for w in b[1:-1].tobytes().decode("utf-8", "replace").split(" ")])
    number = np.int32 if n < 1 << 28 - BITS else np.int64  # there are fewer than four runs a word
    h, at = trigrams(b).astype(number), np.cumsum(b == 32, dtype=number) - number(1)
    first, last = at[:-2], at[1:-1]  # the words a trigram begins and ends in
    square, lean = idf * idf, own * idf

    def measure(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate(([0], np.flatnonzero(grams[1:] != grams[:-1]) + 1))
        damped = np.log1p(np.diff(starts, append=len(grams)).astype(np.float32))
        g, of = (grams[starts] & (DIMENSIONS - 1)).astype(np.intp), grams[starts] >> BITS
        heads = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1))
        norm = np.sqrt(np.add.reduceat(damped * damped * square[g], heads))
        cosine = np.max([np.add.reduceat(damped * c[g], heads) for c in lean], axis=0) / norm
        return np.log2(np.diff(heads, append=len(of))).astype(int), cosine

    # Lengths are taken together, as calls cost more than short texts do, but not all those of a very long text.
    grams, some, found = [], [], []
    for shift in range((n - 1).bit_length() + 1):
        run = first >> shift
        own_grams = ((run + number(sum(map(len, some)))) << BITS | h)[run == last >> shift]
        own_grams.sort()
        grams.append(own_grams)
        some.append(np.logical_or.reduceat(known, np.arange(0, n, 1 << shift)))
        if 1 << shift >= n or sum(map(len, grams)) > 1 << 17:
            found.append(measure(np.concatenate(grams)))
            grams = []
    some = np.concatenate(some)
    return np.concatenate([x for x, _ in found])[some], np.concatenate([x for _, x in found])[some]


def rejection(rows: DataFrame, text: str, lang: str, languages: list[str], idf: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """Least cosine by language and band, from the runs of all rows; a band without runs takes that of the next shorter one, else of the next longer."""
    number = {name: i for i, name in enumerate(languages)}

    def tally(codes: list[np.ndarray]) -> pd.DataFrame:
        code, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *codes]), return_counts=True)
        of, step = np.divmod(code, STEPS + 1)
        return pd.DataFrame({"language": of // BANDS, "band": of % BANDS, "step": step, "n": n})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, held = [], 0
        for batch in batches:
            for t, name in zip(batch["_text"], batch["_lang"], strict=True):
                i = number[name]
                band, cosine = runs(t, idf, own[i])
                codes.append((i * BANDS + band) * (STEPS + 1) + np.clip(np.ceil(cosine * STEPS), 1, STEPS).astype(np.int64))
                held += len(band)
                if held > 1 << 17:
                    yield tally(codes)
                    codes, held = [], 0
        yield tally(codes)

    texts = rows.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    found = texts.mapInPandas(measure, "language int, band int, step int, n long").groupBy("language", "band", "step").agg(F.sum("n").alias("n"))
    low = found.groupBy("language", "band").agg(F.percentile("step", F.lit(LOW_QUANTILE), F.col("n")).alias("low"))
    out = np.full((len(languages), BANDS), np.nan)
    for r in low.collect():
        out[r["language"], r["band"]] = LOW_SHARE * r["low"] / STEPS
    return pd.DataFrame(out.T).ffill().bfill().fillna(0.0).to_numpy().T


def fit(training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int | None = None, k: int = CENTROIDS) -> Model:
    """Centroids and rejection of each language from all labelled rows. A caller may ask for a model of ``sample`` rows of each language."""
    rows = training.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    if sample is not None:
        rows = cut(bounded_sample(rows, lang, [key, text], sample).select(key, text, lang), "sample")
    encoded = encode(rows, key, text, lang)
    df, n = document_frequencies(encoded)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    languages = sorted(r["lang"] for r in encoded.select("lang").distinct().collect())
    if not languages:
        return Model([], idf, np.zeros((0, DIMENSIONS), dtype=np.float32), np.array([], dtype=int), np.zeros((0, BANDS)))
    own = [c[share >= min(LEAST_SHARE, share.max())] for c, share in spherical_clusters(encoded, languages, idf, k)]
    owner = np.repeat(np.arange(len(languages)), [len(c) for c in own])
    return Model(languages, idf, np.concatenate(own), owner, rejection(rows, text, lang, languages, idf, own))


def predict(text: Column, model: Model, reject: float | None = None) -> Column:
    """struct(lang_pred, score, accepted) of a whole text. score is the cosine to the nearest centroid, in 0 to 1; ``reject``
    is the least accepted, by default the model's for the language and the text's length."""

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget_others("language_id")
        for texts in batches:
            names, scores, least = [], [], []
            for start in range(0, len(texts), 500):
                part = texts.iloc[start : start + 500].tolist()
                known = [has_letter(t) for t in part]
                if not len(model.owner):
                    known = [False] * len(part)
                    best, lang, low = np.zeros(len(part)), [UNKNOWN] * len(part), np.zeros(len(part))
                else:
                    x = vectors(part, model.idf)
                    cos = np.stack([model.centroids @ v for v in x])  # row by row: equal texts get equal scores, whatever the batch
                    at = cos.argmax(axis=1)
                    best, lang = cos[np.arange(len(part)), at], [model.languages[model.owner[a]] for a in at]
                    low = model.reject[model.owner[at], bands(x)]
                names += [name if ok else UNKNOWN for name, ok in zip(lang, known, strict=True)]
                least += low.tolist() if reject is None else [reject] * len(part)
                scores += [min(1.0, max(0.0, float(s))) if ok else 0.0 for s, ok in zip(best, known, strict=True)]
            yield pd.DataFrame({"lang_pred": names, "score": scores, "accepted": [n != UNKNOWN and s >= r for n, s, r in zip(names, scores, least, strict=True)]})

    return nearest(text)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % modulus == remainder
