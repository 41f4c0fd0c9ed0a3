import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_features_of_stretches(monkeypatch):
    text = "One two, two two; three!! " * 50
    whole = sorted(quality.features(text))
    monkeypatch.setattr(quality, "_STRETCH", 7)
    assert sorted(quality.features(text)) == whole
    assert len(quality.features("")) == 0 and len(quality.features(" \n")) == 0


def test_ftrl_learns():
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 50, 20).astype(np.int32) + 100 * (i % 2), i % 2) for i in range(400)]
    w, bias = quality.train_ftrl(rows)
    said = [w[p].sum() / np.sqrt(len(p)) + bias > 0 for p, _ in rows]
    assert np.mean([s == bool(y) for s, (_, y) in zip(said, rows, strict=True)]) > 0.98
    assert (w[200:] == 0).all()


def test_quality_held_out(spark):
    got = queries.op10_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = labels.merge(got[got.held_out], on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_edges(spark):
    schema = "doc_id long, text string, label int, h long"
    docs = spark.createDataFrame([(1, "good text", 5, 1), (1, "good text", 5, 1), (2, None, 5, 1), (3, "", 5, 1), (None, "x", 5, 1)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = quality.fit(docs, given)
        scores = [r[0] for r in docs.select(quality.scorer(spark, model)("text")).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert scores == [0.5] * 5
    assert docs.limit(0).select(quality.scorer(spark, model)("text")).count() == 0
    assert quality.training_rows(docs, labels, 1).count() == 2  # one id, both of its rows


def test_language_held_out(spark):
    got = queries.op7_language(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    both = docs.merge(got, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(4)] + [(9, "le chat et le chien", "fr")]
    rows += [(20, None, None), (21, "123 !?", "en"), (22, "", "fr"), (23, "thecat", None), (24, "zzz", None), (None, "x", "en")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, score string, n int")
    model = langid.fit(df)
    said = {r.doc_id: r.p for r in df.select("doc_id", langid.predictor(spark, model)("text").alias("p")).collect()}
    assert said[0].lang_pred == "en" and said[9].lang_pred == "fr" and said[23].lang_pred == "en"
    for i in (20, 21, 22):
        assert tuple(said[i]) == ("und", 0.0)
    assert said[24].lang_pred in ("en", "fr") and 0 < said[24].score <= 1
    none = langid.fit(df.limit(0))
    assert {r.p.lang_pred for r in df.select(langid.predictor(spark, none)("text").alias("p")).collect()} == {"und"}


def test_backoff_takes_the_longest_known():
    table = np.array([[1, 0], [5, 0], [0, 7], [0, 1]], np.float32)
    entries = {(0, "word"): 0, (4, "^wor"): 1, (2, "xy"): 2, (1, "x"): 3}
    of = langid.Evidence(entries, table)
    assert of.of(["word", "worm", "xy", "xq", "q"]).tolist() == [[1, 0], [5, 0], [0, 7], [0, 1], [0, 0]]
    assert of.sums([["word", "xy", "xy", "q"], [], ["q"]]).tolist() == [[1, 14], [0, 0], [0, 0]]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "_CELLS", 0)
    of = langid.Evidence({(1, "a"): 0, (1, "b"): 1}, np.array([[1, 0], [0, 3]], np.float32))
    for turn in range(40):
        words = [f"a{turn % 30}x{i}" for i in range(300)] + ["b", "b"]
        assert of.sums([words, words[-1:]]).tolist() == [[300, 6], [0, 3]]
        assert len(of.young) == len(of.rows) <= of.most and len(of.old) == len(of.old_rows) <= of.most


def brute_language(model, text):
    """Language and score by the definition, a word at a time."""
    langs, entries, table = model
    words = [w for w in "".join(c if c.isalpha() or (not c.isascii() and c.isalnum() and not c.isdigit() and c != "_") else " " for c in text.lower()).split()]
    words = [w for w in words if any(map(str.isalpha, w))]
    if not words or not langs:
        return "und", 0.0
    total = np.zeros(len(langs))
    for w in words:
        for n in (0, 4, 3, 2, 1):
            marked = f"^{w}$" if n > 1 else w
            parts = [w] if n == 0 else [marked[i : i + n] for i in range(len(marked) - n + 1)]
            at = [entries[n, g] for g in parts if (n, g) in entries]
            if at:
                total += table[at].astype(float).sum(0) / len(at)
                break
    share = np.exp((total - total.max()) / np.sqrt(len(words)))
    return langs[int(total.argmax())], share.max() / share.sum()


def test_predictions_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"), max_rows=20, max_entries=300)
    texts = [r.text for r in docs.collect()] + ["", "12", "hello hello", "ah", "Ünter ß été"]
    df = spark.createDataFrame([(t,) for t in texts + texts[:9]], "text string")
    got = df.select("text", langid.predictor(spark, model)("text").alias("p")).collect()
    assert len(got) == len(texts) + 9
    for r in got:
        lang, score = brute_language(model, r.text)
        assert r.p.lang_pred == lang and abs(r.p.score - score) < 1e-4


def test_long_words_are_not_cut():
    word = "x" * ((1 << 20) + 5)
    for text in (word, word + " b", "a " + word + "-c" * 9):
        words = [w for part in langid.stretches(text) for w in langid.words_of(part)]
        assert words == langid.words_of(text)


def test_each_language_trains(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(400)] + [(1000, "een hond", "nl")]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    langs, entries, _ = langid.fit(docs, max_rows=5, max_entries=4)
    assert langs == ["de", "nl"] and (0, "hond") in entries and (0, "hund") in entries
    chosen = langid.training_rows(docs, 5).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in chosen} == {"de": 5, "nl": 1}


def test_ties_of_languages_go_to_the_lesser_name(spark):
    df = spark.createDataFrame([(1, "same word", "nl"), (2, "same word", "de")], "doc_id long, text string, lang string")
    said = df.select(langid.predictor(spark, langid.fit(df))("text").alias("p")).collect()
    assert [r.p.lang_pred for r in said] == ["de", "de"] and abs(said[0].p.score - 0.5) < 1e-9


def test_scores_by_given_weights(spark):
    """The sparse dot product against a sum over all words and pairs, one at a time."""
    rng = np.random.default_rng(4)
    weights = rng.normal(size=1 << quality.BITS).astype(np.float32)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    got = docs.select("text", quality.scorer(spark, (weights, 0.25))("text").alias("score")).collect()
    one, pair, top = 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15, 1 << 64
    for r in got:
        h = [zlib.crc32(w.encode()) + 1 for w in re.findall(r"\w+|[^\w\s]+", r.text)]
        at = [x * one % top >> 64 - quality.BITS for x in h]
        at += [0 if x == y else (x * pair + y * one) % top >> 64 - quality.BITS for x, y in zip(h[:-1], h[1:], strict=True)]
        z = 0.25 + (sum(float(weights[i]) for i in at) / len(at) ** 0.5 if at else 0)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-6


def test_folds_of_null_ids(spark):
    df = spark.createDataFrame([(None,), (5,)], "doc_id long")
    assert [r[0] for r in df.select(F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False))).collect()][0] is False
