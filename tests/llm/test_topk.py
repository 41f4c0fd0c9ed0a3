import numpy as np
import pytest

from readloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, v int"


def brute(rows, ask, k):
    q = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows}
    out = []
    for a in ask:
        scored = sorted((-sum(x * y for x, y in zip(q[a], v, strict=False)), i) for i, v in q.items() if i != a)
        out += [(a, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.1, 12).astype("float32").tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, [0.0] * 12), (400, [1.0]), (500, [])]
    bad = [(600, None), (700, [float("nan")] * 12), (800, [float("inf")] + [0.0] * 11), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + bad], SCHEMA).repartition(5)
    ask = [i for i, _ in rows if i % 100 == 0]
    got = topk.search(df, df.filter("vec_id % 100 = 0"), 10)
    assert [c for c in got.columns] == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, ask, 10)


def test_null_component_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (100, [1.0, 2.0]), (1, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id % 100 = 0")).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 0)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_reading_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(-3, 4, (5000, 4))
    rows[7] = [100, 100, 0, 0]
    lists = topk.Lists(np.arange(5000), rows)
    seen = []
    original = np.lexsort
    try:
        np.lexsort = lambda keys: seen.append(len(keys[0])) or original(keys)
        ids, scores = lists.top(np.array([1, 1, 0, 0]), -1, 1)
    finally:
        np.lexsort = original
    assert ids.tolist() == [7] and scores.tolist() == [200] and sum(seen) < 500
