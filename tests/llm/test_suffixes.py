import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from readloom.llm import suffixes
from readloom.llm.common import table
from readloom.llm.queries import op11_suffixes

L = suffixes.LENGTH


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    often = Counter(t[i : i + L] for t in texts for i in range(len(t) - L + 1))
    out = []
    for (doc_id, _), text in zip(rows, texts, strict=True):
        gone = bytearray(len(text))
        for i in range(len(text) - L + 1):
            if often[text[i : i + L]] > 1:
                gone[i : i + L] = b"\1" * L
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out.append((doc_id, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, df.select(columns).collect()), key=str)


def made(spark, rows):
    return rows_of(suffixes.kept_digests(spark.createDataFrame(rows, "doc_id long, text string")))


def noise(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


def passages(seed, n, shared):
    """Texts of noise with some of the shared passages, or parts of them, in between."""
    rng = random.Random(seed)
    common = [noise(rng, k) for k in shared]
    texts = []
    for _ in range(n):
        parts = [noise(rng, rng.randrange(700))]
        for p in rng.sample(common, rng.randrange(len(common) + 1)):
            a = rng.choice([0, 0, rng.randrange(90)])
            parts += [p[a : len(p) - rng.choice([0, 0, rng.randrange(90)])], noise(rng, rng.choice([0, 1, 3, 400]))]
        texts.append("".join(parts))
    return texts


EDGES = [None, "", "x", "y" * (L - 1), "z" * L, "w" * (L + 1), "ab" * 900, "a" * 5000, "é" * 300, "0123456789" * 50 + "!" + "0123456789" * 50]


def test_passages(spark):
    texts = passages(1, 60, [399, 400, 401, 450, 640, 900, 1500]) + EDGES
    texts += [texts[3], texts[4][:-1], "q" + texts[5]]
    rows = [(i + (1 << 60) if i % 20 else None, t) for i, t in enumerate(texts)]
    assert made(spark, rows) == brute(rows)


def test_repeated_rows(spark):
    rows = [(i, t) for i, t in enumerate(passages(2, 12, [500, 800]))]
    assert made(spark, rows + rows[:4] + rows[:2]) == brute(rows + rows[:4] + rows[:2])


def test_hot_passage_over_shards(spark, monkeypatch):
    """A key with more different pieces than a shard takes: what stands once in each shard is found by the merge."""
    monkeypatch.setattr(suffixes, "MOST_PIECES", 4)
    monkeypatch.setattr(suffixes, "_BLOCK", 1)
    rows = list(enumerate(passages(3, 90, [410, 700])))
    assert made(spark, rows) == brute(rows)


def test_many_ids_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_IDS", 0)
    rows = list(enumerate(passages(4, 30, [600, 1000]) + EDGES))
    assert made(spark, rows) == brute(rows)


def test_stretches_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffixes, "_STRETCH", 700)
    monkeypatch.setattr(suffixes, "_RUN", 50)
    rows = list(enumerate(passages(5, 30, [600, 1500]) + EDGES))
    docs = [(i, (t or "").encode()) for i, t in rows if len((t or "").encode()) >= L]
    batch = pd.DataFrame({"id": [i for i, _ in docs], "t": 0, "text": [t.decode() for _, t in docs]})
    seen = Counter()
    for found in suffixes._found(batch):
        for r in found.itertuples():
            seen.update((r.id, k) for k in range(r.at, r.at + r.size - L + 1))
    assert seen == Counter((i, k) for i, t in docs for k in range(len(t) - L + 1))


def test_query(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = rows_of(op11_suffixes(spark, "/root/testdata/sf0.001"))
    assert got == brute(rows) and any(r[2] for r in got)


def test_very_long_text(spark):
    rng = random.Random(6)
    passage = noise(rng, 3000)
    text = noise(rng, 1_200_000) + passage + noise(rng, 1000) + passage
    n = len(passage.encode())
    got = {r[0]: r for r in made(spark, [(1, text), (2, passage), (3, "short")])}
    assert got[1][2] == 2 * n and got[1][3] == 2 and got[2][2:4] == (n, 1) and got[3][2:4] == (0, 0)


def test_empty_and_extra_columns(spark):
    assert suffixes.kept_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "k" * 500, 3, "x")], "doc_id long, text string, key long, runs string")
    assert rows_of(suffixes.kept_digests(docs)) == brute([(1, "k" * 500)])


@pytest.mark.parametrize("text", [b"banana", b"a" * 50, b"mississippi" * 9, bytes(range(1, 250)) * 3])
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    sa = suffixes.suffix_array(data, len(text))
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = suffixes.common_prefixes(data, sa, np.array([0]), np.array([len(text)]), 40)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        k = 0
        while k < 40 and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        assert lcp[b] == k
