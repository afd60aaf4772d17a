"""A quality classifier: naive Bayes support vectors.

A text's features are the n-grams that occur in it (of one and two words, and of three word shapes), as indicators,
hashed to 2**bits columns. The
naive Bayes part gives each column the logarithm of the ratio of its (smoothed, normalised) counts in the two classes;
the indicators scaled by it are the input of a linear model with hinge loss, fitted by dual coordinate descent. The
learned weights are interpolated with their mean magnitude, and margins become scores by a logistic curve fitted to
margins of rows that the model for it didn't see.

Training is on at most ``max_rows`` labelled rows, and on rows with ``max_features`` features in all at most (documented
bounds; the rows of smallest hash of their id are taken, each with all its features). The fitted model has a fixed size and is what scoring ships to executors.
Every row of every table is scored over its whole text. A null or empty text has no features and gets the score of the
model's bias. Ties and repeated rows are scored alike; an empty table gives an empty table; a model can't be fitted
without rows of both classes: then every score is the share of class 1 (0.5 without any row).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import give_back, lean, written

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SEED2 = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> int:
    """A word's form, 0 to 15: case, digits, punctuation, length."""
    if word.isalpha():
        if len(word) > 1 and word.isupper():
            return 1
        if word[0].isupper():
            return 2 if word[1:].islower() or len(word) == 1 else 3
        return 4 if len(word) < 4 else 5 if len(word) < 13 else 6 if len(word) < 25 else 7
    if word.isdigit():
        return 8 if len(word) < 5 else 9
    if word[0].isalnum() or word[0] == "_":
        return 10
    return 11 if word in {".", ",", ";", ":", "?"} else 12 if len(word) == 1 else 13 if len(set(word)) == 1 else 14


class Words(dict):
    """Word hashes with the word's shape in the lowest four bits, kept for a task; emptied when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        n = self[word] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995) & ~15 | shape(word)
        return n


def features(text: str | None, words: Words, bits: int) -> np.ndarray:
    """The columns (distinct, increasing) of the n-grams in a whole text: of one and two words, and of three shapes,
    where a word that repeats the one before has a shape of its own. Case counts."""
    tokens = _TOKEN.findall(text or "")
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _SEED2) ^ (h[1:] + (h[:-1] >> np.uint64(7)))
        s = h & np.uint64(15)
        s[1:] += np.uint64(16) * (h[1:] == h[:-1])
        s = np.concatenate([[31, 31], s, [31]]).astype(np.uint64)
        threes = ((s[:-2] << np.uint64(10)) | (s[1:-1] << np.uint64(5)) | s[2:]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
        both = np.concatenate([h, pairs, threes]) * _SEED2
    return np.unique(both >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Weights over hashed columns, a bias, and the slope and offset of the logistic curve."""

    bits: int
    weights: np.ndarray = field(repr=False)
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, columns: np.ndarray) -> float:
        n = max(1.0, float(len(columns))) ** 0.5
        return float(self.weights[columns].sum()) / n + self.bias

    def score(self, text: str | None, words: Words) -> float:
        z = self.slope * self.margin(features(text, words, self.bits)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float) -> np.ndarray:
    up, down = np.full(size, smooth), np.full(size, smooth)
    for x, label in zip(rows, y, strict=True):
        (up if label else down)[x] += 1
    return np.log(up / up.sum()) - np.log(down / down.sum())


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear model with hinge loss; a row's vector is ratio[columns] / sqrt(columns)."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = [(ratio[x] / max(1, len(x)) ** 0.5).astype(np.float32) for x in rows]
    diagonal = [float(v @ v) + 1.0 for v in values]
    sign, alpha = np.where(y > 0, 1.0, -1.0), np.zeros(len(rows))
    # Classes weigh alike, whatever their shares.
    share = max(1, int((y > 0).sum())) / len(y)
    top = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / max(1e-9, 1 - share))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), top[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logistic curve of best likelihood through margins and labels, by Newton's method with smoothed targets."""
    up = int((y > 0).sum())
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    a, b = 1.0, float(np.log((up + 1) / (len(y) - up + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - goal, p * (1 - p) + 1e-9
        g = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(m + 1e-9 * np.eye(2), g)
        a, b = max(1e-3, a - step[0]), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[int], *, bits: int, smooth: float = 0.5, cost: float = 1.0, mix: float = 0.75, rounds: int = 20, seed: int = 1) -> Model:
    """The model for feature rows and 0/1 labels."""
    y = np.array(labels, dtype=np.int64)
    model = Model(bits, np.zeros(1 << bits))
    if len(y) == 0 or y.min() == y.max():
        model.offset = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model

    def train(of: np.ndarray) -> tuple[np.ndarray, float]:
        some, own = [rows[i] for i in of], y[of]
        ratio = _ratios(some, own, 1 << bits, smooth)
        w, bias = _descend(some, own, ratio, cost, rounds, seed)
        mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
        return (mix * w + (1 - mix) * mean * np.where(w != 0, 1.0, 0.0)) * ratio, bias

    fold = np.random.default_rng(seed).integers(0, 3, len(y))
    margins = np.zeros(len(y))
    for k in range(3):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(inside) and y[inside].min() != y[inside].max():
            part = Model(bits, *train(inside))
            margins[outside] = [part.margin(rows[i]) for i in outside]
    model.weights, model.bias = train(np.arange(len(y)))
    model.slope, model.offset = _platt(margins, y)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 18, max_rows: int = 6_000, max_features: int = 40_000_000) -> Model:
    """Fits on at most ``max_rows`` rows of ``docs`` that ``labels`` marks 0 or 1. Both classes get up to half of the
    bound, so that a rare class isn't thinned out. A row with several labels takes part once for each."""
    marked = labels.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1) and k is not null").distinct()
    half = max_rows // 2
    # The rows of smallest hash; TakeOrderedAndProject keeps at most the bound in each task.
    some = [marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(half) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most max_rows rows of two numbers
    texts = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t")).join(chosen, "k").select("k", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            x = [features(t.as_py(), words, bits).astype("<i4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(x, pa.binary())], names=["k", "y", "x"])

    found = written(texts.mapInArrow(lean(run), "k long, y int, x binary").select("k", "y", "x", F.xxhash64("k").alias("h"), F.sha2("x", 256).alias("d")), "features")
    order = ["h", "k", "y", "d"]
    # Numbers of at most max_rows rows on the driver; a document that is there several times takes part as often.
    taken, room = 0, max_features
    for r in found.orderBy(*order).limit(max_rows).select((F.octet_length("x") / 4).cast("long").alias("n")).collect():
        room -= r["n"]
        taken += room >= 0 or not taken
    found = found.orderBy(*order).limit(taken).select("y", "x").toArrow() if taken else pa.table({"y": pa.array([], pa.int32()), "x": pa.array([], pa.binary())})
    rows = [np.frombuffer(x.as_py(), "<i4") for x in found.column("x")]  # four bytes a feature on the driver
    model = fit(rows, found.column("y").to_pylist(), bits=bits)
    del found, rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1."""
    spark = docs.sparkSession
    slim = Model(model.bits, model.weights.astype(np.float32), model.bias, model.slope, model.offset)
    shipped = spark.sparkContext.broadcast(slim)  # 2**bits numbers, whatever the input

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        words, m = _shared_words(), shipped.value
        return pd.Series([m.score(t, words) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(F.col(f"`{text_col}`")))


_WORDS = Words()


def _shared_words() -> Words:
    return _WORDS


