import random
import re

import numpy as np
import pytest
import xxhash

from readloom.llm import simhash
from readloom.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """fingerprint -> least fingerprint reachable, all pairs compared."""
    reach = {p: p for p in prints}

    def root(p):
        while reach[p] != p:
            p = reach[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = root(a), root(b)
                reach[max(x, y)] = min(x, y)
    return {p: root(p) for p in prints}


def test_fingerprints():
    for text in ("", " \n", "One", "one TWO", "É a B c É a B c", "x y z " * 70_000, "\u00a0a\u2003b c d"):
        assert simhash.fingerprint_of(text) & (2**64 - 1) == brute_fingerprint(text), text[:20]


@pytest.mark.parametrize("most_in_cell", [0, 3, 10**6])
def test_links_find_all(spark, most_in_cell):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = {0, -1, 1, 1 << 62, -(1 << 63)}
    for _ in range(25):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            prints.add(signed(p))
            for _ in range(rng.randrange(1, 5)):
                p ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(p,) for p in sorted(prints)], "fingerprint long")
    got = simhash.links(df, most_in_cell)
    for a, b in got.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and a != b
    reached = {r.node: r.least for r in components(got).collect()}
    assert {p: reached.get(p, p) for p in prints} == brute_components(sorted(prints))


def test_no_exploded_rows_are_broadcast(spark):
    df = spark.range(2000).selectExpr("xxhash64(id) as fingerprint")
    lines = simhash.links(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    sent = None
    for line in lines:
        sent = None if sent is not None and depth(line) <= sent else sent
        assert sent is None or "Generate" not in line
        sent = depth(line) if sent is None and "BroadcastExchange" in line else sent
    assert sum("SortMergeJoin" in line for line in lines) == 2


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.least for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_documents(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    texts += [texts[0].upper(), texts[1] + " x", texts[2].replace(" ", "\n"), None, "", "a b", "A  b"] + [texts[3]] * 40
    rows = [(100 - i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, texts[3], "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, cell int")
    got = simhash.near_copies(df).withColumn("hex", simhash.as_hex("fingerprint")).toPandas()
    assert len(got) == len(rows)
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    reach, least = brute_components(sorted(set(prints.values()))), {}
    for i in (i for i in prints if i is not None):
        at = reach[prints[i]]
        least[at] = min(least.get(at, i), i)
    for doc_id, hexed, component in zip(got.doc_id, got.hex, got.component_id, strict=True):
        doc_id = None if doc_id != doc_id else int(doc_id)
        assert hexed == f"{prints[doc_id]:016x}" and component == least[reach[prints[doc_id]]]
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_offsets_cover_the_distance():
    every = simhash.offsets()
    assert len(every) == len(set(every)) == 145 and {-o for o in every} == set(every)
