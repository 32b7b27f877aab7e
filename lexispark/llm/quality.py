"""Quality classifier by Bradley-Terry ranking: scores learned from preference pairs by logistic loss on feature differences.

Every labelled row of the training part may be drawn; at most LABELLED of each label reach the driver, as vectors of a few
dozen numbers. A pair prefers a row of label 1 to one of label 0. The linear score is then mapped to a probability on the same
rows, each weighted by the training rows of its label for one drawn, so scores do not change with the size of the sample. Scoring is one pass over the table without a shuffle.

Defined results: a null or empty text has the features of an empty text and gets a score like any other; labels that are null
or neither 0 nor 1 are ignored; a document labelled twice counts twice; without both labels every score is 0.5; repeated rows
are scored each; equal texts get equal scores; an empty table gives no rows, and no labels a model all the same; further columns and
clashing names do not matter. Whole texts of any length are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.language_id import bounded_sample

LABELLED = 6000
PAIRS = 40_000
RIDGE = 1e-3
PREDICT_AT = 0.3

_CLASSES = np.zeros((256, 9))
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i, 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() and _i < 128 else 3 if _c in " \t\r\n" else 4 if _c in ".,;:'-\"()?" else 5 if _c in "#$%&*@^~" else 6 if _c in "|<>{}[]\\/=+_" else 7 if _c == "!" else 8] = 1


def features(text: str | None) -> np.ndarray:
    """What a text looks like: shares of byte classes, and how its words and lines repeat and vary."""
    raw = (text or "").encode("utf-8", "replace")
    share = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / max(1, len(raw))
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.concatenate((share, np.zeros(13)))
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    kinds = len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) / n
    upper = sum(map(str.isupper, words)) / n
    alpha = sum(map(str.isalpha, words)) / n
    lines = text.split("\n")
    return np.concatenate((share, [
        1.0, np.log1p(n), np.log1p(len(raw)), size.mean() / 10, size.std() / 10, (size <= 3).mean(), kinds / n, np.log1p(kinds) / np.log1p(n), again, upper, alpha,
        np.log1p(n / len(lines)), len(set(lines)) / len(lines),
    ]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        # Summed row by row: a matrix product may round equal rows of a batch differently.
        return 1 / (1 + np.exp(-np.clip(self.slope * (z * self.weights).sum(axis=1) + self.offset, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 30, count: np.ndarray | None = None) -> np.ndarray:
    """Weights of the least logistic loss of y (0 or 1) on x. ``count``: how many rows each row stands for."""
    c = np.ones(len(x)) if count is None else count / count.mean()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (c * p * (1 - p))) @ x / len(x) + np.diag(ridge), x.T @ (c * (p - y)) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def rank_pairs(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> np.ndarray:
    """Bradley-Terry weights from random pairs of one row of each side; both directions, as there is no intercept."""
    rng = np.random.default_rng(seed)
    d = better[rng.integers(len(better), size=pairs)] - worse[rng.integers(len(worse), size=pairs)]
    d[::2] *= -1
    return _newton(d, (np.arange(pairs) % 2).astype(float), np.full(d.shape[1], RIDGE))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = LABELLED) -> Model:
    """``limit`` bounds the rows of each label that reach the driver."""
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_y"))
    # At most about 2 * limit rows of numbers, so the texts need not be shuffled to meet them.
    rows = docs.select(key, text).join(F.broadcast(bounded_sample(known, "_y", [key], limit)), key)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["_y"], "place": b["_place"], "x": [features(t).tolist() for t in b[text]]})

    got = rows.select("_y", "_place", text).mapInPandas(measure, "y int, place double, x array<double>").toPandas()
    # All training rows, by label: two numbers. Only ids are read and shuffled.
    total = {r["_y"]: r["count"] for r in docs.select(key).join(known, key).groupBy("_y").count().collect()}
    got = got.sort_values("place", kind="stable").groupby("y").head(limit)
    width = len(features(""))
    x = np.array(got["x"].tolist()).reshape(-1, width)
    y = got["y"].to_numpy()
    if len(set(y)) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0)
    # Rows of a label count as often as the label occurs among all, whatever the sample held.
    count = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
    mean = np.average(x, axis=0, weights=count)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=count))
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    w = rank_pairs(z[y == 1], z[y == 0])
    a, b = _newton(np.column_stack((z @ w, np.ones(len(z)))), y.astype(float), np.array([1e-4, 1e-6]), count=count)
    return Model(mean, scale, w, float(a), float(b))


def score(text: Column, model: Model) -> Column:
    """0 to 1, higher where label 1 is likelier."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(np.stack([features(t) for t in texts])) if len(texts) else [], dtype="float64")

    return run(text)


def keep_above_quantile(scored: DataFrame, quantile: float, column: str = "score", accuracy: int = 10_000) -> DataFrame:
    """scored with ``kept``: whether the score reaches the given quantile of all scores."""
    at = scored.agg(F.percentile_approx(column, float(quantile), accuracy).alias("_at"))
    return scored.join(F.broadcast(at), how="cross").withColumn("kept", F.coalesce(F.col(column) >= F.col("_at"), F.lit(True))).drop("_at")
