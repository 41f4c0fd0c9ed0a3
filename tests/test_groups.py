import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from readloom import session
from readloom.operators import groups, kmers, overlap
from readloom.plans import correction

K = 5
SWAP = str.maketrans("ACGT", "TGCA")


def _reads(spark, seqs):
    rows = [(i, s, "I" * len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "read_id bigint, seq string, qual string")


def _plain_rows(seqs):
    out = []
    for i, s in enumerate(seqs):
        for p in range(len(s) - K + 1):
            f = s[p : p + K]
            if "N" not in f:
                rc = f[K // 2] in "GT"
                out.append((f.translate(SWAP)[::-1] if rc else f, i, len(s) - p - K if rc else p, rc))
    return out


def _sample(seed, n=40):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(120))
    seqs = []
    for _ in range(n):
        at = rng.randrange(90)
        s = "".join("N" if rng.random() < 0.02 else c for c in genome[at : at + rng.randint(10, 30)])
        seqs.append(s if rng.random() < 0.5 else s.translate(SWAP)[::-1])
    return seqs + ["ACG", "NNNNNNN", "AANAA", "ACACACACACACA", ""]


def test_kmers_of_odd_reads(spark):
    seqs = _sample(1)
    got = sorted(tuple(r) for r in kmers.kmers(_reads(spark, seqs), K).collect())
    assert got == sorted(_plain_rows(seqs))
    keys = {r.read_id: sorted(r["keys"]) for r in kmers.read_keys(_reads(spark, seqs), K).collect()}
    slim = defaultdict(list)
    for r in kmers.kmer_rows(_reads(spark, seqs), K).collect():
        slim[r.read_id].append(r.key)
    assert {i: sorted(x) for i, x in slim.items()} == {i: x for i, x in keys.items() if x}


def test_nonredundant_groups_against_plain_python(spark):
    seqs = _sample(2)
    reads = _reads(spark, seqs)
    counts = kmers.kmer_counts(reads, K)
    total = counts.agg(F.sum("n")).first()[0]
    rank = {}
    for r in kmers.with_kmer_text(counts.withColumn("rank", F.col("key")), K).collect():
        rank[r.kmer] = r["rank"]
    for cov in (1, 3):
        by_kmer, of_read = defaultdict(list), defaultdict(set)
        for kmer, i, pos, rc in _plain_rows(seqs):
            by_kmer[kmer].append((-pos, i, rc))
            of_read[i].add(rank[kmer])
        want = set()
        for kmer, members in by_kmer.items():
            members.sort()
            if not 1 < len(members) < 20 * cov:
                continue
            linked = any(
                min(of_read[a[1]] & of_read[b[1]]) == rank[kmer] for a, b in zip(members, members[1:])
            )
            if linked:
                want |= {(kmer, i, -p, rc, n) for n, (p, i, rc) in enumerate(members)}
        got = groups.nonredundant_groups(reads, counts, cov, total, K)
        assert {tuple(r) for r in kmers.with_kmer_text(got, K).collect()} == want


def test_hot_kmer_leaves_the_other_groups_whole(spark):
    # A third of all k-mer rows belongs to one k-mer.
    seqs = _sample(3) + ["AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"] * 20
    reads = _reads(spark, seqs)
    rows, counts = kmers.kmer_rows(reads, K), kmers.kmer_counts(reads, K)
    total = counts.agg(F.sum("n")).first()[0]
    got = groups.banded_rows(rows, counts, 3, total)
    want = rows.join(counts.filter("n > 1 and n < 60"), "key", "left_semi")
    assert got.count() == want.count()
    assert got.exceptAll(want).isEmpty()


def test_heavy_share_follows_the_partitions(spark):
    """With 100,000 partitions a key of a twenty-thousandth of the rows is heavy; what stays is small against one."""
    assert 10 * 8 <= groups.heavy_share(8) and groups.heavy_share(100_000) == 1_000_000
    counts = spark.createDataFrame([(1, 50_000), (2, 40), (3, 10**9 - 50_040)], "key bigint, n bigint")
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "key bigint, read_id bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100000")
    try:
        plan = groups.light_rows(rows, counts, 2, 10**9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.key for r in plan.collect()] == [2]


def test_fold_of_repeats_is_an_argument(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 5, 60, 61, 400])], "key bigint, n bigint")
    assert sorted(r.n for r in groups.group_sizes(counts, 3).collect()) == [2, 5]
    assert sorted(r.n for r in groups.group_sizes(counts, 3, max_fold=100).collect()) == [2, 5, 60, 61]
    assert tuple(groups.outside_band(counts, 3).first()) == (1, 3, 521)


def test_short_repeats_can_be_left_out(spark):
    frame = spark.createDataFrame([("p", "AAAAAXCGTAC", "AAAAAYCGTAC")], "pair_id string, template string, pattern string")
    assert overlap.exact_segments(frame, 4).count() == 2
    assert [r.p_start for r in overlap.exact_segments(frame, 4, min_trimmed=3).collect()] == [6]


def test_exact_segments_are_unique_and_maximal(spark):
    pairs = [
        ("same", "ACGTTGCAAC", "ACGTTGCAAC"),
        ("twice", "ACGTAXXACGTA", "ACGTA"),
        ("two", "AACCGGTTXAAGGCCTT", "AACCGGZZZAAGGCC"),
        ("none", "AAAAAA", "CCCCCC"),
        ("short", "ACG", "ACGTACGT"),
    ]
    frame = spark.createDataFrame(pairs, "pair_id string, template string, pattern string")
    segments = overlap.exact_segments(frame, 4)
    got = sorted(tuple(r) for r in segments.collect())
    assert got == [("same", 0, 0, 10), ("two", 0, 0, 6), ("two", 9, 9, 15)]
    longest = {r.pair_id: (r.diagonal, r.len) for r in overlap.longest_match(segments, frame).collect()}
    assert longest == {"same": (0, 10), "two": (0, 6), "twice": (0, 0), "none": (0, 0), "short": (0, 0)}
    votes = {r.pair_id: (r.diagonal, r.votes) for r in overlap.diagonal_vote(segments).collect()}
    assert votes == {"same": (0, 10), "two": (0, 12)}


def _unique_by_brute_force(template, pattern, k):
    """Longest common stretches of at least k letters that the template has once."""
    made = set()
    for p in range(len(pattern)):
        for t in range(len(template)):
            if p and t and pattern[p - 1] == template[t - 1]:
                continue
            n = 0
            while p + n < len(pattern) and t + n < len(template) and pattern[p + n] == template[t + n]:
                n += 1
            if n >= k and template.find(pattern[p : p + n], template.find(pattern[p : p + n]) + 1) < 0:
                made.add((t, p, p + n))
    return made


def test_unique_segments_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "_PIECE", 16)
    draw = random.Random(5)
    made = [("none", "abcdef", "uvwxyz"), ("short", "ab", "abab"), ("one letter", "a" * 40, "a" * 33), ("empty", "", "")]
    for i in range(60):
        letters = "ab" if i % 2 else "abé日"
        passage = "".join(draw.choice(letters) for _ in range(draw.randint(3, 30)))
        sides = []
        for _ in range(2):
            text = ""
            while len(text) < 90:
                text += passage if draw.random() < 0.5 else "".join(draw.choice(letters) for _ in range(draw.randint(1, 12)))
            sides.append(text)
        made.append((f"r{i}", *sides))
    frame = spark.createDataFrame([*made, ("null", None, "abab")], "pair_id string, template string, pattern string")
    for k in (5,):
        got = {tuple(r) for r in overlap.unique_segments(frame, k).collect()}
        assert got == {(name, *s) for name, t, p in made for s in _unique_by_brute_force(t, p, k)}
        assert got == {tuple(r) for r in overlap.exact_segments(frame, k).collect()}
    assert overlap.unique_segments(frame.limit(0), 4).count() == 0


def test_unique_segments_make_few_rows_of_a_repeated_passage(spark):
    draw = random.Random(6)

    def text(n):
        return "".join(draw.choice("abcdefgh") for _ in range(n))

    passage = text(300)
    rows = {}
    for times in (10, 20):
        template, pattern = ("".join(passage + text(30) for _ in range(times)) for _ in range(2))
        frame = spark.createDataFrame([("p", template, pattern)], "pair_id string, template string, pattern string")
        windows = []

        def counted(df, name, windows=windows):
            table = session.materialize(df, name)
            windows.append(table.count())
            return table

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(overlap, "materialize", counted)
            overlap.unique_segments(frame, 20)
        rows[times] = sum(windows)
    assert rows[20] < 3 * rows[10], rows  # all hits would be four times as many


def test_overlap_score_with_both_signs_of_offset(spark):
    rows = [("ACGTACGTAC", "GTACGTACAA", 2), ("GTACGTACAA", "ACGTACGTAC", -2), ("AAAAAAAAAA", "CCCCCCCCCC", 0)]
    frame = spark.createDataFrame(rows, "seq_a string, seq_b string, offset int")
    got = overlap.score_overlaps(frame, k=5, match_rate=0.9).collect()
    assert sorted((r.offset, r.overlap, r.matches, r.score) for r in got) == [(-2, 8, 8, 8), (2, 8, 8, 8)]


def test_groups_are_found_when_asked_for(spark, monkeypatch):
    names = []

    def noted(df, name):
        names.append(name)
        return session.materialize(df, name)

    monkeypatch.setattr(correction, "materialize", noted)
    ready = correction.prepare(_reads(spark, _sample(4)), K)
    assert names == ["counts"]
    assert ready.groups is ready.groups and names == ["counts", "groups"]


def test_second_join_carries_lower_kmers_only(spark):
    reads = _reads(spark, _sample(5))
    pairs = spark.createDataFrame([(7, 0, 1)], "key bigint, a bigint, b bigint")
    made = groups.shares_no_lower_key(pairs, kmers.read_keys(reads, K))
    assert "filter(keys_a" in made._jdf.queryExecution().optimizedPlan().toString()


def test_segments_shuffle_texts_only(spark):
    frame = spark.createDataFrame([("x", "ACGTACGGT", "ACGTACGGT"), (None, "ACGT", "ACGT")], "pair_id string, template string, pattern string")
    made = overlap.exact_segments(frame, 4)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in made.collect()] == [("x", 0, 0, 9)]


def test_unique_segments_write_no_row_of_a_letter(spark, monkeypatch):
    draw, names = random.Random(8), []
    text = "".join(draw.choice("abcdefgh") for _ in range(3000))
    pairs = [("p", text, text[500:]), ("twice", text, text), ("twice", text, text), (None, text, text)]
    frame = spark.createDataFrame(pairs, "pair_id string, template string, pattern string")

    def noted(df, name):
        names.append(name)
        return session.materialize(df, name)

    monkeypatch.setattr(overlap, "materialize", noted)
    assert [tuple(r) for r in overlap.unique_segments(frame, 50).collect()] == [("p", 500, 0, 2500)]
    assert names == ["segments"]
