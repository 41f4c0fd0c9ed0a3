import math
import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.functions import dna
from readloom.functions.stats import binomial_quantile
from readloom.operators import kmers


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_strands_and_canonical_form(spark):
    rows = spark.createDataFrame([("ACGTN-A",), ("AAGCC",), ("GGCTT",)], "s string")
    twice = dna.reverse_complement(dna.reverse_complement(F.col("s")))
    assert rows.filter(twice != F.col("s")).count() == 0
    assert _one(spark, dna.reverse_complement(F.lit("ACGTN-A"))) == "T-NACGT"
    both = rows.filter("length(s) = 5").select(dna.canonical_kmer(F.col("s"), 5).alias("c")).distinct()
    assert both.count() == 1


@pytest.mark.parametrize("k", [5, 21, 31, 33])
def test_key_round_trip_and_order_is_total(spark, k):
    texts = [("ACGT" * 9)[i : i + k] for i in range(4)] + ["A" * k, "T" * k]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    keyed = rows.withColumn("key", dna.kmer_key(F.col("s"), k))
    assert keyed.filter(dna.kmer_text(F.col("key"), k) != F.col("s")).count() == 0
    assert keyed.select("key").distinct().count() == len(set(texts))


def test_even_k_is_refused():
    with pytest.raises(ValueError):
        dna.check_k(20)


def test_address_round_trip(spark):
    for at, gap in (((1 << 51) - 1, 2047), ((1 << 40) + 5, 0), (0, 1)):
        node = dna.node_key(F.lit(at), F.lit(gap))
        assert _one(spark, node) < 1 << 62
        assert [_one(spark, c) for c in dna.node_address(node).values()] == [at, gap]


def test_trimmed_length(spark):
    for text, want in [("AAAA", 1), ("AACGTT", 4), ("ACGT", 4), ("AAACAAA", 3), ("A", 1), ("AAC", 2)]:
        assert _one(spark, dna.trimmed_length(F.lit(text))) == want


def test_binomial_quantile_goldens(spark):
    for n, p, want in [(30, 0.99, 3.580949203161968), (2, 0.9, 1.99), (3, 0.999999, -32.33339899915792)]:
        assert abs(_one(spark, binomial_quantile(F.lit(n), F.lit(p))) - want) < 1e-9
    assert _one(spark, binomial_quantile(F.lit(3), F.lit(0.0))) is None
    # However deep the column: a normal distribution, one step off at most.
    for n, p in [(74_000, 0.99), (1_000_000, 0.999), (30_000_000, 0.99)]:
        want = n * (1 - p) + 3.719 * math.sqrt(n * p * (1 - p))
        assert abs(_one(spark, binomial_quantile(F.lit(n), F.lit(p))) - want) < 0.02 * (want - n * (1 - p)) + 2


def _exact(n, p):
    """By fractions: binomial coefficients are integers."""
    q, p, total = 1 - Fraction(p), Fraction(p), Fraction(0)
    for i in range(n + 1):
        term = math.comb(n, i) * q**i * p ** (n - i)
        total += term
        if i and total > Fraction(9999, 10000):
            return float(i - (total - Fraction(9999, 10000)) / term)


def test_quantile_against_fractions(spark):
    for n, p in [(1, 0.5), (7, 0.25), (40, 0.9990234375), (300, 0.5), (200, 0.0078125), (64, 0.984375), (33, 2.0**-30)]:
        assert abs(_one(spark, binomial_quantile(F.lit(n), F.lit(p))) - _exact(n, p)) < 1e-6, (n, p)


@pytest.mark.parametrize("k", [5, 21, 33])
def test_kmers_of_other_letters(spark, k):
    """Lower case counts as upper case; k-mers over anything but A, C, G, T are none."""
    text = ("ACGTTGCA" * 9)[: k + 3]
    rows = [(1, text), (2, text.lower()), (3, text[:2] + "R" + text[3:]), (4, "." * len(text)), (5, text + "n")]
    reads = spark.createDataFrame(rows, "read_id bigint, seq string")
    got = {}
    for r in kmers.kmers(reads, k).collect():
        assert set(r.kmer) <= set("ACGT")
        got.setdefault(r.read_id, []).append((r.kmer, r.pos, r.rc))
    assert sorted(got[1]) == sorted(got[2]) and len(got[1]) == 4 and len(got[3]) == 1 and 4 not in got and len(got[5]) == 4
    keys = {r.read_id: sorted(r["keys"]) for r in kmers.read_keys(reads, k).collect()}
    assert keys[1] == keys[2] and len(keys[3]) == 1 and keys[4] == []
    counts = kmers.with_kmer_text(kmers.kmer_counts(reads, k), k).collect()
    assert sum(r.n for r in counts) == sum(map(len, got.values())) and all(len(r.kmer) == k for r in counts)
    canonical = spark.createDataFrame([("acgta",), ("TACGT",)], "s string").select(dna.canonical_kmer(F.col("s"), 5))
    assert canonical.distinct().count() == 1


@pytest.mark.parametrize("k", [1, 3, 7, 21, 31])
def test_packed_kmers_by_brute_force(spark, k, monkeypatch):
    """Rows, arrays and counts of k-mers; no k-mer is a row before its part merges it."""
    rng, flip = random.Random(k), str.maketrans("ACGT", "TGCA")
    seqs = ["".join(rng.choices("ACGTacgtNR.", [9, 9, 9, 9, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 90))) for _ in range(60)]
    seqs += ["A" * 700, "ACGT" * 40, None, "", "C" * k, "N" * 50, "G" * (k - 1)]
    reads = spark.createDataFrame([(i if i != 5 else None, s) for i, s in enumerate(seqs)], "read_id long, seq string")
    want, arrays = [], {}
    for i, s in ((i if i != 5 else None, re.sub("[^ACGT]", "N", s.upper())) for i, s in enumerate(seqs) if s is not None):
        of = [] if len(s) >= k else None
        for at in range(len(s) - k + 1):
            kmer = s[at : at + k]
            if "N" not in kmer:
                rc = kmer[k // 2] in "GT"
                kmer = kmer[::-1].translate(flip) if rc else kmer
                want.append((kmer, i, len(s) - k - at if rc else at, rc))
                of.append(kmer)
        if of is not None:
            arrays[i] = of
    clean = pa.array([re.sub("[^ACGT]", "N", s.upper()) for s in seqs if s is not None and len(s) >= k])
    parts = lambda: [tuple(map(list, zip(*p, strict=True))) for p in kmers._packed_kmers(clean[1:], k)]
    whole = [r for p in parts() for r in p]
    monkeypatch.setattr(kmers, "_STRETCH", 64)  # stretches end within reads
    assert [r for p in parts() for r in p] == whole and len(parts()) > 1
    monkeypatch.setattr(kmers, "_SORTED", 100)
    got = [tuple(r) for r in kmers.with_kmer_text(kmers.kmer_rows(reads, k), k).select("kmer", "read_id", "pos", "rc").collect()]
    order = lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3])
    assert sorted(got, key=order) == sorted(want, key=order)
    texts = kmers.read_keys(reads, k).select("read_id", F.transform("keys", lambda x: dna.kmer_text(x, k)).alias("keys"))
    assert {r.read_id: list(r["keys"]) for r in texts.collect()} == arrays
    counts = kmers.kmer_counts(reads, k)
    assert {r.kmer: r.n for r in kmers.with_kmer_text(counts, k).collect()} == Counter(w[0] for w in want)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan
    assert kmers.kmer_counts(reads.limit(0), k).count() == 0
