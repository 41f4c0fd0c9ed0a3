"""Quality by hashed word n-grams: logistic regression, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of punctuation, with their case. Words and pairs of words are
hashed to ``2**BITS`` weights; a pair of equal words hashes to one place whatever the word, so that repetition
is seen in words never met before. A feature counts its occurrences over the square root of their number; a
text's score is the sigmoid of one sparse dot product over the whole text.

Training sees at most ``max_rows`` labelled rows, those whose ids hash lowest (a documented bound: their
features go to one task, where the updates run in order of the hash). The weights are ``2**BITS`` floats, 1 MB,
whatever the input. Scoring covers every row and reads its text alone.

Nulls: a null or empty text has no feature and gets the score of the bias. Labels other than 0 and 1 and null
ids don't train; of contradicting labels of an id the 1 counts. With no label at all every score is 0.5. Rows that repeat
get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import small_batches

BITS = 18
MAX_ROWS = 8000
#: Step size, its smoothing, and the penalties on the sum of weights and of their squares.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 4
THRESHOLD = 0.3
_WORD = re.compile(r"\w+|[^\w\s]+")
_PAIR, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)
_SAME = np.uint64(0)
_MOST_WORDS_KEPT = 100_000
_STRETCH = 1 << 20


class _Hashes(dict):
    """Hash by word, kept for the words met; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST_WORDS_KEPT:
            self.clear()
        made = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) + 1
        return made


_hashes = _Hashes()


def _words(text: str):
    """Word hashes in stretches of bounded length, each beginning with the last word of the one before."""
    held, last = [], []
    for found in _WORD.finditer(text) if len(text) > _STRETCH else ():
        held.append(found.group())
        if len(held) == _STRETCH:
            yield last, held
            held, last = [], held[-1:]
    if len(text) <= _STRETCH:
        held = _WORD.findall(text)
    if held:
        yield last, held


def features(text: str) -> np.ndarray:
    """Places of all words and pairs of a text, with repeats."""
    parts = []
    for last, words in _words(text):
        h = np.fromiter(map(_hashes.__getitem__, last + words), np.uint64, len(last) + len(words))
        pair = (h[:-1] * _PAIR + h[1:] * _ONE) >> _SHIFT
        pair[h[:-1] == h[1:]] = _SAME
        parts += [(h[len(last) :] * _ONE) >> _SHIFT, pair]
    return np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)


def train_ftrl(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after ``EPOCHS`` passes over (places, label) rows."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    ready = []
    for places, label in rows:
        at, count = np.unique(places, return_counts=True)
        at = np.append(at, size)
        ready.append((at, np.append(count / np.sqrt(max(len(places), 1)), 1.0), label))

    def weights(at):
        zs = z[at]
        return np.where(
            np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        )

    for _ in range(EPOCHS):
        for at, x, label in ready:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            after = n[at] + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(n[at])) / ALPHA * w
            n[at] = after
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` of (h, text, label): the labelled documents whose ids hash lowest."""
    chosen = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(max_rows)
    )
    # broadcast: max_rows rows of three numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("h", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias learned from the labelled documents; see the module's bound on their number."""

    def featured(batches):
        for b in batches:
            yield pd.DataFrame(
                {"h": b.h, "label": b.label, "places": [features(t or "").tobytes() for t in b.text]}
            )

    def learned(batches):
        rows = [(np.frombuffer(p, np.int32), int(y)) for b in batches for p, y in zip(b.places, b.label, strict=True)]
        w, bias = train_ftrl(rows)
        yield pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, max_rows).mapInPandas(featured, "h long, label int, places binary")
    # ids that repeat among the documents must not raise the bound
    rows = rows.orderBy("h", "label", "places").limit(max_rows).repartition(1).sortWithinPartitions("h", "label", "places")
    made = rows.mapInPandas(learned, "w binary, bias double").collect()
    if not made:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(made[0].w, np.float32), made[0].bias


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    """A column function: text -> probability of label 1."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w, bias = sent.value
        out = np.full(len(texts), bias)
        for i, text in enumerate(texts):
            if text and len(places := features(text)):
                out[i] += w[places].sum(dtype=np.float64) / np.sqrt(len(places))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def unheld(docs_or_labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Rows outside the held-out fold."""
    return docs_or_labels.filter(fold(F.col("doc_id"), folds) != held)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
