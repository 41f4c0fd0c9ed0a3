import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from readloom.llm import bpe_tree, token_counts
from readloom.llm.common import tokenizer_json

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "", None, "a", "Hello  world\n\n it's 3<|endoftext|> x", "é́́ ﬁ Σς ΑΣ", "\u1100\u1161\u11a8" * 40, "🙂🙃" * 300, " \n\t ",
    "don't we'll 'S <|startoftext|>abc<|endoftext|>", "x" * 5000, "lorem ipsum " * 700, "ab12!?" * 900, "ß\u0130I\u0307 " * 200,
    # capitals without a composed form, which their small letters have
    "H\u0331asan " * 20, "T\u0308an. " * 20, "xW\u030Aan " * 20, "Y\u030Aan, " * 20, "J\u030Can Abc " * 20,
]
SCHEMA = "doc_id long, text string, n_tokens string, key int, digest string"


def made(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in enumerate(texts)], SCHEMA)


def test_counts_against_library(spark, tmp_path):
    texts = TEXTS + TEXTS[3:5] + ["word " * 30_000]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = token_counts.token_counts(made(spark, texts), BYTES, str(tmp_path / "cache")).toPandas().sort_values("doc_id")
    assert got.n_tokens.tolist() == want
    assert got.n_bytes.tolist() == [len((t or "").encode()) for t in texts]
    assert got.over_limit.tolist() == [n > 1024 for n in want]


def test_cache_is_used_and_grows(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), token_counts.version_of(tokenizer_json(BYTES))
    token_counts.token_counts(made(spark, ["one text", "one text", "two"]), BYTES, cache).collect()
    held = spark.read.parquet(f"{cache}/{version}")
    assert held.count() == 2
    # a stored count is believed: nothing is encoded again
    digest = hashlib.sha256(b"planted").hexdigest()
    spark.createDataFrame([(digest, 77)], token_counts.CACHE).write.mode("append").parquet(f"{cache}/{version}")
    got = token_counts.token_counts(made(spark, ["planted", "two", "three"]), BYTES, cache).toPandas()
    assert sorted(got.n_tokens) == [1, 1, 77]
    assert spark.read.parquet(f"{cache}/{version}").count() == 4
    assert token_counts.token_counts(made(spark, []), BYTES, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50])
def test_pieces_add_up(size):
    encoder = Tokenizer.from_file(BYTES)
    for text in filter(None, TEXTS):
        cut = token_counts.pieces(text, size)
        assert "".join(cut) == text
        assert sum(len(encoder.encode(p).ids) for p in cut) == len(encoder.encode(text).ids)


def test_tree_against_library(spark):
    encoder = Tokenizer.from_file(WORDS)
    want = [encoder.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    for leaf in (100, 1 << 15):
        got = bpe_tree.encode_documents(spark, made(spark, TEXTS), WORDS, leaf).toPandas().sort_values("doc_id")
        assert got.n_tokens.tolist() == [len(w) for w in want]
        assert got.ids_sha256.tolist() == [hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest() for w in want]
        decoded = [encoder.decode(w, skip_special_tokens=False) for w in want]
        assert got.decoded_sha256.tolist() == [hashlib.sha256(d.encode()).hexdigest() for d in decoded]


def test_parts_are_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(bpe_tree, "_MOST_PARTS", 6)
    encoder, parts, rng = Tokenizer.from_file(WORDS), bpe_tree.Parts(), random.Random(1)
    words = ["Don't,", "a.b", "€,", "ÀB!", "<|endoftext|>", "x1y22", "i\u0307.", "\u00a0", "The", "the."]
    for _ in range(40):
        texts = [" ".join(rng.choices(words, k=rng.randrange(5))) for _ in range(3)]
        got = bpe_tree.encode_by_parts(encoder, texts, parts)
        want = [encoder.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, "<u4").tolist() for _, i, _ in got] == want
        assert [d for *_, d in got] == [encoder.decode(w, skip_special_tokens=False) for w in want]
        assert len(parts.young) + len(parts.old) < 30


def test_tree_keeps_rows(spark):
    df = spark.createDataFrame([(1, "long " * 90), (1, "long " * 90), (None, "b " * 300), (None, None)], "doc_id long, text string")
    got = bpe_tree.encode_documents(spark, df, WORDS, 128).toPandas()
    assert sorted(got.n_tokens) == [0, 90, 90, 300]
    assert bpe_tree.encode_documents(spark, made(spark, []), WORDS).count() == 0


def test_joins_inside_unsplit_words():
    """No word end anywhere: halves of random letters, with repeats that merge in many ways."""
    encoder, rng = Tokenizer.from_file(WORDS), random.Random(5)
    for trial in range(60):
        letters = rng.choice(["ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz", "a", "éèß日本語", "!?.,*#"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(300, 2500)))
        starts = bpe_tree.cuts(text, 200)
        ends = [*starts[1:], len(text)]
        parts = [(text[s:e], *bpe_tree.encode(encoder, text[s:e])) for s, e in zip(starts, ends, strict=True)]
        whole, ids, spans = bpe_tree.join_all(encoder, parts)
        ids_want, spans_want = bpe_tree.encode(encoder, text)
        assert whole == text and ids.tolist() == ids_want.tolist() and (spans == spans_want).all(), trial
