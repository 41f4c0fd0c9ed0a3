import hashlib

import numpy as np

from readloom.llm import phrases

SCHEMA = "doc_id long, text string, n_chars string, at int"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))


def test_equal_substrings_are_cut_alike():
    middle = prose(1, 400)
    a, b = prose(2, 50) + middle, prose(3, 77) + "é" + middle + prose(4, 20)
    names = [set(), set()]
    for level, name, owner in phrases.parse([a, b]):
        if level == 3:
            for i in (0, 1):
                names[i] = set(name[owner == i].tolist())
    assert len(names[0] & names[1]) > 0.75 * len(names[0])
    assert len(names[0]) < len(a) / 8


def test_parsing_is_the_same_in_any_company():
    texts = [prose(i, 3 + 40 * i) for i in range(6)] + ["", "a", "aaaaaaaaaa" * 50, "ab" * 400]
    together = phrases.sketches(texts)
    for i, t in enumerate(texts):
        assert (phrases.sketches([t])[0] == together[i]).all(), i
        assert (phrases.from_text(phrases.as_text(together[i])) == together[i]).all()


def test_likeness():
    s = phrases.sketches([prose(1, 300), prose(1, 300), prose(2, 300), "", ""])
    assert phrases.likeness(s[[0, 0, 0, 3]], s[[1, 2, 3, 4]]).tolist()[0::3] == [1.0, 1.0]
    assert phrases.likeness(s[:1], s[2:3])[0] < 0.1
    assert phrases.likeness(s[:1], s[3:4])[0] == 0.0


def test_long_text_in_stretches(monkeypatch):
    text = prose(5, 4000)
    whole = phrases.sketches([text])
    monkeypatch.setattr(phrases, "_STRETCH", 5000)
    assert phrases.likeness(whole, phrases.sketches([text]))[0] > 0.8


def test_against_brute_force(spark):
    texts = {i * 3: prose(i, 5 + i * 11 % 90) for i in range(60)}
    texts[9] = texts[12]
    rows = [*texts.items(), (300, None), (301, ""), (302, "ab"), (303, "€" * 999)]
    got = phrases.fingerprints(made(spark, rows)).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    rows.sort()
    known = {i: t or "" for i, t in rows}
    for k, (i, _) in enumerate(rows):
        after = known[rows[(k + 1) % len(rows)][0]]
        n = len(known[i]) // 4
        edited = known[i][: len(known[i]) - n] + after[:n]
        r = got.loc[i]
        assert r.n_chars == len(known[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, ed, nx = phrases.sketches([known[i]]), phrases.sketches([edited]), phrases.sketches([after])
        assert r.fingerprint == phrases.as_text(own[0]) and r.edited_fingerprint == phrases.as_text(ed[0])
        assert r.near_edited == phrases.likeness(own, ed)[0] and r.near_next == phrases.likeness(own, nx)[0]
    assert got.loc[9].fingerprint == got.loc[12].fingerprint


def test_repeated_and_missing_ids(spark):
    rows = [(1, "one two three"), (1, "another one"), (2, "zz"), (2, "next text"), (None, "without id"), (None, None)]
    got = phrases.fingerprints(made(spark, rows)).toPandas()
    assert len(got) == 6
    one = got[got.n_chars == 13].iloc[0]
    assert one.edited_sha256 == hashlib.sha256(b"one two thnex").hexdigest()
    assert phrases.fingerprints(made(spark, [])).count() == 0
    only = phrases.fingerprints(made(spark, [(5, "abcdefgh")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and only.near_next == 1.0
