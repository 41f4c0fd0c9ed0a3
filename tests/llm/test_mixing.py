import math
import re

import pytest
from pyspark.sql import functions as F

from readloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 9) for i, t, s in rows], SCHEMA)


def water_fill(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * sizes[s] < level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), ("a", "b", "é", None)[min(i % 9, 3)]) for i in range(600)]
    rows += [(1000 + i, "x " * 3000, "a") for i in range(3)]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water_fill(sizes)
    for s, part in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert part.source_size.iloc[0] == sizes[s]
        assert abs(part.taken.sum() - want[s]) <= 3
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    again = mixing.mix(docs(spark, rows)).toPandas()
    assert got.sort_values("row").taken.tolist() == again.sort_values("row").taken.tolist()


def test_size_is_runs_without_ascii_space(spark):
    texts = ["", None, " a\x0bb\u00a0c\r\nd ", "\x1f", "a" * 100_000]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = [r.n for r in df.orderBy("doc_id").select(mixing.size_of(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_rates_are_tilts(spark):
    pairs = spark.createDataFrame([("a", 1, 10), ("a", 5, 3), ("a", 40, 2)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 105, 60.0)], "source string, source_size long, target double")
    r = mixing.solve(pairs, goals).first()
    taken = sum(n * x * 2 / (1 + math.exp(-r.tilt * x / r.scale)) for x, n in ((1, 10), (5, 3), (40, 2)))
    assert taken == pytest.approx(60, rel=1e-5)


def test_one_size_for_all_and_repeated_rows(spark):
    got = mixing.mix(docs(spark, [(7, "a b", "s")] * 1001 + [(None, "c d", "t")])).toPandas()
    of = got[got.source == "s"]
    assert len(of) == 1001 and abs(of.taken.sum() - of.target.iloc[0]) <= 2


def test_no_words_and_no_rows(spark):
    got = mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).toPandas()
    assert got.taken.tolist() == [0, 0] and got.target.tolist() == [0, 0]
    assert mixing.mix(docs(spark, [])).count() == 0


def test_copies_do_not_change_with_the_packing(spark, tmp_path):
    """Rows are numbered otherwise where Spark packs the files otherwise; the copies of a document stay."""
    key, made = "spark.sql.files.minPartitionNum", []
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(12).write.parquet(f"{tmp_path}/d")
    try:
        for number in ("1", "12"):
            spark.conf.set(key, number)
            docs = spark.read.parquet(f"{tmp_path}/d")
            made.append(sorted(map(tuple, mixing.mix(docs).select("doc_id", "copies", "rate").collect())))
    finally:
        spark.conf.unset(key)
    assert made[0] == made[1] and {c for _, c, _ in made[0]} == {0, 1, 2}
