import hashlib
import random
import zlib

import pytest

from readloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level):
    """The node left, and for each leaf the siblings left and right on its way."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            first = i - i % 16
            ways[leaf].append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        at = [i // 16 for i in at]
        level = [sha(*level[r : r + 16]) for r in range(0, len(level), 16)]
    return level[0], ways


def brute(rows):
    if not rows:
        return []
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = [
        sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, sha(*map(field, r))))
        for s in sources
    ]
    trees = [climb([sha(*map(field, r)) for r in part]) for part in parts]
    root, upper = climb([sub for sub, _ in trees])
    out = []
    for part, (sub, ways), rest in zip(parts, trees, upper, strict=True):
        for r, way in zip(part, ways, strict=True):
            leaf = node = sha(*map(field, r))
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                node = sha(*map(field, (*r[:4], text)))
            for a, b in way + rest:
                node = sha(a, node, b)
            out.append((r[0], leaf, sub, root, sha(*[a + b for a, b in way + rest]), node, node == root))
    return sorted(out, key=str)


def made(spark, rows):
    return sorted(map(tuple, merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


ROW = (5, "a", "en", 3, "Abc")


@pytest.mark.parametrize(
    "rows",
    [[], [(None,) * 5], [ROW], [ROW, (6, None, None, None, "")], [ROW] * 40, [(i, "s", "en", 1, "X" * 70_000) for i in range(17)]],
    ids=["empty", "nulls", "one", "two sources", "repeats", "last run of one"],
)
def test_small(spark, rows):
    assert made(spark, rows) == brute(rows)


def test_hot_source_and_many_sources(spark):
    rng = random.Random(3)
    names = [None, "", "B", "é", *["hot"] * 8, *[f"s{i}" for i in range(300)]]
    rows = []
    for i in range(4500):
        doc_id = None if rng.random() < 0.02 else rng.randrange(4000)  # ties
        rows.append((doc_id, rng.choice(names[:12] + names), rng.choice(["en", None]), i % 5, rng.choice([None, "", "AbC é", f"T{i}"])))
    assert made(spark, rows) == brute(rows)


def test_deep_tree(spark):
    rows = [(i, "one", "en", 1, f"Text {i}") for i in range(16**3 + 1)]  # four levels: pointers jump twice
    assert made(spark, rows) == brute(rows)


def test_jumps_meet_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ARITY", 2)
    rows = [(i, f"s{i % 3}", "en", 1, "x") for i in range(200)]  # seven levels: pointers over four and more
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        node = r.leaf
        for s in r.path:
            node = sha(s.left, node, s.right)
        assert node == r.root and len(r.path) == 9


def test_extra_columns(spark):
    docs = spark.createDataFrame([(*ROW, "x", 1, 2)], SCHEMA + ", tree string, n long, leaf long")
    assert sorted(map(tuple, merkle.verified(docs).collect())) == brute([ROW])
