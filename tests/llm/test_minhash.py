import random

import numpy as np
import pytest

import corpus_pipeline
from readloom.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(rng, share):
    """A text of about 300 words, and a copy with that share of its words replaced."""
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    return " ".join(words), " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def texts_of_all_similarities(seed=11):
    rng, texts = random.Random(seed), []
    for i in range(120):
        texts += planted(rng, 0.001 + 0.04 * i / 120)
    star = planted(rng, 0)[0].split()
    for _ in range(40):  # near copies of one text, not all of each other
        w = list(star)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(300)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return [*texts, None, "", " \n", "a b", "A  B", "a b c", texts[0].upper()]


def brute_groups(texts):
    sets = [brute_set(t) for t in texts]
    reach = list(range(len(texts)))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                reach[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [2, minhash.SMALL])
def test_groups_of_all_pairs(spark, tmp_path, monkeypatch, small):
    """Keys of more than two texts are crowded in the first case: the star's texts only meet through splits."""
    monkeypatch.setattr(minhash, "SMALL", small)
    texts = texts_of_all_similarities()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.read.parquet(f"{tmp_path}/d")).collect()}
    want = dict(enumerate(brute_groups(texts)))
    if small == minhash.SMALL:
        assert got == want
    linked = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)
    assert all(want[i] == want[got[i]] for i in got)  # nothing else is linked


def test_stage_drops_planted_copies(spark, tmp_path):
    texts = texts_of_all_similarities(12)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    kept = corpus_pipeline.without_near_copies(spark, spark.read.parquet(f"{tmp_path}/d"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(texts)))


def test_empty_and_long(spark):
    assert minhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(minhash.shingles_of("a b c d e f " * 20_000)) == 6


def crowd(n, seed=5):
    """Texts that share a long passage and are yet dissimilar (0.74), and copies of some with three words replaced."""
    rng = random.Random(seed)
    passage = [f"p{rng.randrange(9000)}" for _ in range(260)]
    texts = [" ".join(passage + [f"q{rng.randrange(10**9)}" for _ in range(45)]) for _ in range(n)]
    copies = []
    for t in texts[:20]:
        words = t.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**9)}"
        copies.append(" ".join(words))
    return texts + copies


def pairs_made(spark, tmp_path, monkeypatch, texts, name):
    """Groups, and how many pairs were compared."""
    kept, write = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, step: kept.append((step, write(df, step))) or kept[-1][1])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{name}")
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.read.parquet(f"{tmp_path}/{name}")).collect()}
    return got, sum(df.count() for step, df in kept if step == "compared")


def test_dissimilar_texts_that_share_keys_make_no_square(spark, tmp_path, monkeypatch):
    made = {}
    for n in (80, 160):
        texts = crowd(n)
        with monkeypatch.context() as patch:
            got, made[n] = pairs_made(spark, tmp_path, patch, texts, f"d{n}")
        assert got == dict(enumerate(brute_groups(texts)))
    assert made[160] < 2.5 * made[80]


def test_similar_texts_differ_from_a_pivot_in_common_shingles():
    """Of any two similar sets, one not near the pivot, the prefixes that are compared have a shingle in common."""
    rng, met = random.Random(3), 0
    pool = list(range(3000))
    for _ in range(6000):
        pivot = set(rng.sample(pool, rng.randrange(3, 60)))

        def varied(base, share):
            kept = {s for s in base if rng.random() > share * rng.random()}
            return kept | set(rng.sample(pool, rng.randrange(int(share * len(base)) + 1))) or {1}

        x = varied(pivot, 0.5)
        y = varied(x, 0.15)
        if x == y or jaccard(x, y) < 0.8:
            continue
        near, _, common, plain, most, prefix = zip(*(minhash.differing(np.array(sorted(s), np.uint64), np.array(sorted(pivot), np.uint64)) for s in (x, y)), strict=True)
        assert near == (jaccard(x, pivot) >= 0.8, jaccard(y, pivot) >= 0.8)
        if all(near):
            continue
        met += 1
        both = (x ^ pivot) & (y ^ pivot)
        reach = plain if not any(near) else most  # most is plain for what is near
        least = max(c for c, other in zip(common, near[::-1], strict=True) if not other)
        assert len(both) >= least
        for level in range(1, min(least, 4) + 1):
            assert len(set(prefix[0][: reach[0] + level - 1].tolist()) & set(prefix[1][: reach[1] + level - 1].tolist())) >= level
    assert met > 300


def test_a_star_makes_few_keys(spark, tmp_path, monkeypatch):
    """Texts around one, near to it or not, make keys in proportion to their number (before: 3 of each, each round)."""
    rng = random.Random(8)
    middle = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(f"v{rng.randrange(60)}" if rng.random() < i / 2000 else w for w in middle) for i in range(240)]
    kept, write = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, step: kept.append((step, write(df, step))) or kept[-1][1])
    monkeypatch.setattr(minhash, "discard", lambda df: None)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == dict(enumerate(brute_groups(texts)))
    assert sum(df.count() for step, df in [m for m in kept if m[0] == "members"][1:]) < 40 * len(texts)
