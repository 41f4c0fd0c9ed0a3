"""Language of a text, word first: known words by their log frequency in each language, unseen words by their parts.

A known word adds its log frequency in each language. A word that training never saw adds the mean over its
longest known character n-grams instead (lengths 4, 3, 2, 1, with marks at both ends of the word): the next
shorter length is tried where none of a length is known. The language with the highest sum wins, ties to the
lesser name; ``score`` is its share after exponents of the sums over the square root of the number of words.

Training counts the words of at most ``max_rows`` labelled documents of each language, those whose ids hash lowest, and
keeps the ``max_entries`` most frequent words and n-grams of each length for each language. These bounds are parameters:
the model grows with the languages only, and a rare language is learned like a frequent one. Prediction covers every row
and its whole text, and reads the text alone.

Nulls: a null text, one with no letter, or any text where training had no label, is ``und`` with score 0. Rows that
repeat get equal predictions; of rows that share an id the least language and the least text train. An empty table gives
an empty result. Long texts are taken in stretches that end where a word ends.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import by_size, discard, materialize, small_batches

LENGTHS = (4, 3, 2, 1)
#: Of each language.
MAX_ROWS = 1000
MAX_ENTRIES = 6000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")
_STRETCH = 1 << 20
#: Numbers a worker remembers in a generation.
_CELLS = 1 << 18


def words_of(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def training_rows(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` of (doc_id, lang, text) of each language: ids that hash lowest, one row an id."""
    known = docs.filter("doc_id is not null and lang is not null and text is not null")
    least = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # cut to max_rows in each task before the shuffle
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = ids.withColumn("at", F.row_number().over(least)).filter(F.col("at") <= max_rows).drop("at")
    # broadcast: max_rows ids and names for each language
    texts = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES):
    """(languages, entries by gram, matrix of centred log frequencies); n-grams of a word stand under (length, gram)."""

    def words_counted(batches):
        for b in batches:
            held = {}
            for lang, text in zip(b.lang, b.text, strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, word, k) for lang, of in held.items() for word, k in of.items()]
            yield pd.DataFrame(rows, columns=["lang", "gram", "k"])

    def parts_counted(batches):
        for b in batches:
            held = {}
            for lang, word, k in zip(b.lang, b.gram, b.k, strict=True):
                of = held.setdefault(lang, Counter())
                for n in LENGTHS:
                    for g in grams(word, n):
                        of[n, g] += k
            rows = [(lang, n, g, k) for lang, of in held.items() for (n, g), k in of.items()]
            yield pd.DataFrame(rows, columns=["lang", "n", "gram", "k"])

    small_batches(docs.sparkSession)
    words = materialize(
        training_rows(docs, max_rows)
        .mapInPandas(words_counted, "lang string, gram string, k long")
        .groupBy("lang", "gram")
        .agg(F.sum("k").alias("k")),
        "langid-words",
    )
    parts = words.mapInPandas(parts_counted, "lang string, n int, gram string, k long")
    counts = materialize(
        words.withColumn("n", F.lit(0)).unionByName(parts).groupBy("n", "gram", "lang").agg(F.sum("k").alias("k")),
        "langid-counts",
    )
    most = W.partitionBy("n", "lang").orderBy(F.desc("k"), "gram")
    best = counts.withColumn("at", F.row_number().over(most)).filter(F.col("at") <= max_entries).select("n", "gram").distinct()
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "k"))).alias("by_lang")
    kept = counts.join(best, ["n", "gram"]).groupBy("n", "gram").agg(by_lang)
    rows = sorted(kept.collect(), key=lambda r: (r.n, r.gram))  # at most max_entries for each length and language
    discard(words)
    discard(counts)
    langs = sorted({lang for r in rows for lang in r.by_lang})
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((len(rows), len(langs)))
    length = np.array([r.n for r in rows], int)
    for i, r in enumerate(rows):
        for lang, k in r.by_lang.items():
            table[i, place[lang]] = k
    for n in (0, *LENGTHS):
        at = length == n
        if at.any():
            table[at] = np.log((table[at] + 0.5) / (table[at].sum(0) + 0.5 * at.sum()))
    if len(rows):
        table -= table.mean(1, keepdims=True)
    return langs, {(r.n, r.gram): i for i, r in enumerate(rows)}, table.astype(np.float32)


class Evidence:
    """Row of evidence of each word met. Words are remembered in two generations, so frequent ones stay."""

    def __init__(self, entries: dict, table: np.ndarray):
        self.by_length = {n: {} for n in (0, *LENGTHS)}
        for (n, gram), i in entries.items():
            self.by_length[n][gram] = i
        self.table = table
        self.most = max(1 << 12, _CELLS // max(table.shape[1], 1))
        self.young: dict[str, int] = {}
        self.rows = table[:0]
        self.old: dict[str, int] = {}
        self.old_rows = table[:0]

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of words, known or backed off, by one gathering of all their entries."""
        whole, parts = self.by_length[0], [(n, self.by_length[n]) for n in LENGTHS]
        found, many = [], []
        for word in words:
            at = whole.get(word)
            if at is not None:
                found.append(at)
                many.append(1)
                continue
            for n, known in parts:
                here = [known[g] for g in grams(word, n) if g in known]
                if here:
                    found += here
                    many.append(len(here))
                    break
            else:
                many.append(0)
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        many = np.array(many, np.int64)
        some = many > 0
        if some.any():
            first = (np.cumsum(many) - many)[some]
            out[some] = np.add.reduceat(self.table[np.array(found)], first) / many[some, None]
        return out

    def learn(self, words: set[str]) -> None:
        """Make all words known in the younger generation."""
        new = [w for w in words if w not in self.young]
        if len(self.young) + len(new) > self.most:
            self.old, self.old_rows = self.young, self.rows
            self.young, self.rows, new = {}, self.table[:0], list(words)
        met = [w for w in new if w in self.old]
        fresh = [w for w in new if w not in self.old]
        kept = self.old_rows[[self.old[w] for w in met]] if met else self.table[:0]
        self.young.update(zip(met + fresh, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, kept, self.of(fresh)])

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Sum of the evidence of each text's words."""
        self.learn({w for words in texts for w in words})
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(texts):
            if words:
                out[i] = self.rows[np.fromiter(map(self.young.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return out


def stretches(text: str):
    """Pieces of a long text that end where a word ends."""
    start = 0
    while len(text) - start > _STRETCH:
        gap = _GAP.search(text, start + _STRETCH)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def predictor(spark: SparkSession, model):
    """A column function: text -> (lang_pred, score)."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    held = {}

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, entries, rows = sent.value
        if "evidence" not in held:
            held["evidence"] = Evidence(entries, rows)
        parts = [(i, part) for i, text in enumerate(texts) for part in stretches(text or "")]
        total, n, at = np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64), 0
        for run in by_size([part for _, part in parts], _STRETCH):
            words = [words_of(part) for part in run]
            for (i, _), of, evidence in zip(parts[at : at + len(run)], words, held["evidence"].sums(words), strict=True):
                total[i] += evidence
                n[i] += len(of)
            at += len(run)
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for i in np.flatnonzero(n) if langs else ():
            share = np.exp((total[i] - total[i].max()) / np.sqrt(n[i]))
            best = int(total[i].argmax())
            names[i], scores[i] = langs[best], share[best] / share.sum()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict
