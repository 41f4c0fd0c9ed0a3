"""The reads and columns derived from orders: few shuffled rows, and the letters one by one."""

from hashlib import md5

import numpy as np
import pytest

from catalog import queries, reads


@pytest.fixture
def orders(spark, tmp_path):
    """Orders with a repeated and a null key."""
    rows = [(i,) for i in range(40)] + [(7,), (None,)]
    spark.createDataFrame(rows, "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def cells_of(key, genome):
    """(mate, g, raw, b, q) of each base of an order, letter by letter."""
    d = md5(f"s{key}".encode()).hexdigest()
    start, hap, indel = int(d[:12], 16) % genome, d[12] <= "7", d[13]
    for mate in (0, 1):
        at = start + (100 + int(d[15:19], 16) % 100 if mate else 0)
        for i in range(85 + int(d[14], 16)):
            g = at + i + ({"0": 1, "1": -1}.get(indel, 0) if i >= 50 else 0)
            m, gm = md5(f"{key}:{mate}:{i}".encode()).hexdigest(), md5(str(g).encode()).hexdigest()
            base = "ACGT"[int(gm[0], 16) % 4]
            base = base.translate(str.maketrans("ACGT", "GTAC")) if hap and gm[1:3] == "00" else base
            wrong, none = m[:2] < "03", m[2:5] == "000"
            base = "N" if none else base.translate(str.maketrans("ACGT", "CGTA")) if wrong else base
            odd = m[9:12] == "000" or m[12:15] == "000"
            yield mate, g, "N" if odd else base, 2 if none else 5 if wrong else int(m[5:7], 16) % 30 + 10


def test_letters(spark, orders):
    got = {(r.file_id, r.rec_offset // 256): r for r in reads.reads(spark, orders).collect()}
    assert len(got) == 80
    flip = str.maketrans("ACGT", "TGCA")
    for (mate, key), r in got.items():
        times = 2 if key == 7 else 1
        mine = [c for c in cells_of(key, 400) if c[0] == mate]
        seq, qual = "".join(c[2] * times for c in mine), "".join(chr(c[3] + 33) * times for c in mine)
        if (key % 2 == 1) != (mate == 1):
            seq, qual = seq[::-1].translate(flip), qual[::-1]
        assert (r.seq, r.qual) == (seq, qual)


def test_digests_are_those_of_md5():
    numbers = np.array([0, 9, 10, 99, 100, 12345, 10**17, 10**18 - 1])
    want = lambda texts: [md5(x.encode()).digest()[:8] for x in texts]
    assert [d.tobytes() for d in reads._digests(None, None, numbers)] == want(map(str, numbers.tolist()))
    names, row = np.array([b"-7:0:", b"9223372036854775807:1:"]), np.arange(8) % 2
    texts = [f"{names[r].decode()}{i}" for r, i in zip(row, numbers.tolist(), strict=True)]
    assert [d.tobytes() for d in reads._digests(names, row, numbers)] == want(texts)
    assert reads._digests(None, None, numbers[:0]).shape == (0, 8)
    with pytest.raises(ValueError):
        reads._digests(np.array([b"x" * 55]), np.array([0]), numbers[:1])


def test_columns_draw_letters_in_array_steps(spark, orders):
    """The hash of an order is the only one in the plan: those of bases are worked out in one Python step."""
    plan = plan_of(queries.column_votes(spark, orders))
    assert plan.count("md5(") == 1 and plan.count("ArrowEvalPython") == 1


def test_columns_are_the_cells(spark, orders, monkeypatch):
    monkeypatch.setattr(reads, "TILE", 64)  # reads cross tiles
    got = reads.genome_columns(spark, orders).select("file_id", "col", "base", "qual").collect()
    want = [c for key in [*range(40), 7] for c in cells_of(key, 400)]
    assert sorted(map(tuple, got)) == sorted(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["quantiles", "column_error_test", "column_votes", "column_reference_base"])
def test_columns_are_tested_where_they_lie(spark, orders, name):
    """Reads are dealt by tile; no base and no tally of a column is shuffled or written."""
    plan = plan_of(getattr(queries, name)(spark, orders))
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(tile" in plan


def test_exact_test_reads_its_histogram_once(spark, orders):
    """Only the votes of a column, after their quantile is known, are shuffled again."""
    plan = plan_of(queries.column_error_test_exact(spark, orders))
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and plan.count("Scan parquet") == 1


def test_reads_gather_no_bases(spark, orders, monkeypatch):
    plans = []
    monkeypatch.setattr(reads, "materialize", lambda df, name: plans.append(plan_of(df)) or df)
    monkeypatch.setattr(reads, "_written", {})
    reads.reads(spark, orders)
    assert "collect_list" not in plans[0] and plans[0].count("Exchange hashpartitioning") == 1
