"""k-mers of reads, their counts, and the spectrum of the counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import (
    DEFAULT_K,
    MAX_PACKED_K,
    as_digits,
    check_k,
    clean_bases,
    digits_key,
    error_probability,
    kmer_key,
    kmer_text,
    phred,
    phred_at,
    rank_mask,
    reads_reversed,
    reverse_complement,
    seq_keys,
)
from readloom.session import shuffle_partitions, small_batches

# Letters whose k-mers are worked out in one go.
_STRETCH = 1 << 16
# k-mers that a task sorts before it deals them, and the bits of a k-mer that name the part it is dealt to.
_SORTED = 1 << 21
_PART_BITS = 12
# Rows of an Arrow batch that goes back to Spark.
_BATCH = 1 << 16
# Any odd number of 64 bits serves.
_MIX = 0x9E3779B97F4A7C15
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def _clean(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, seq) of the reads with at least one window, all letters in ACGTN."""
    long_enough = reads.filter(F.length("seq") >= check_k(k))
    return long_enough.select("read_id", clean_bases(F.col("seq")).alias("seq"))


def _strands(reads: DataFrame, k: int, packed: bool) -> DataFrame:
    """(read_id, fw, bw, len) of the reads with at least one k-mer.

    Strand and digits are worked out once per read; a k-mer is a slice of one
    of the two strings.
    """
    letters = as_digits if packed else (lambda text: text)
    clean = reads.select("read_id", clean_bases(F.col("seq")).alias("seq"), F.length("seq").alias("len"))
    bw = reverse_complement(F.col("seq"))
    return clean.filter(F.col("len") >= check_k(k)).select(
        "read_id", letters(F.col("seq")).alias("fw"), letters(bw).alias("bw"), "len"
    )


def _kmer_windows(reads: DataFrame, k: int, packed: bool) -> DataFrame:
    """One row per k-mer over A, C, G, T: read_id, canonical k-mer, oriented pos, rc."""
    cut = _strands(reads, k, packed).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - k)))
    forward = F.substr("fw", F.col("i") + 1, F.lit(k))
    mirrored = F.col("len") - k - F.col("i")
    middle = F.substr("fw", F.col("i") + k // 2 + 1, F.lit(1))
    return cut.filter(~F.contains(forward, F.lit("N"))).select(
        "read_id",
        F.when(reads_reversed(middle), F.substr("bw", mirrored + 1, F.lit(k))).otherwise(forward).alias("kmer"),
        F.when(reads_reversed(middle), mirrored).otherwise(F.col("i")).alias("pos"),
        reads_reversed(middle).alias("rc"),
    )


def _folded(codes: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n windows of k codes, two bits each: as they stand, and of the other strand."""
    ahead, back = codes.astype(np.uint64), (codes ^ 3).astype(np.uint64)
    size, done = 1, 0
    forward, mirrored = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    while True:  # windows of 1, 2, 4 ... letters; those of the bits of k are put one behind the other
        if k & size:
            forward = (forward << np.uint64(2 * size)) | ahead[done : done + n]
            mirrored |= back[done : done + n] << np.uint64(2 * done)
            done += size
        if done == k:
            return forward, mirrored
        ahead = (ahead[:-size] << np.uint64(2 * size)) | ahead[size:]
        back = back[:-size] | (back[size:] << np.uint64(2 * size))
        size *= 2


def _packed_kmers(text: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, pos, rc) of the k-mers over A, C, G, T of clean texts of at least k letters, some at a time."""
    text = text.cast(pa.large_string())
    if not len(text):
        return
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)
    for lo in range(int(ends[0]), int(ends[-1]), _STRETCH):
        hi = min(lo + _STRETCH, int(ends[-1]) - k + 1)
        if hi <= lo:
            return
        codes = _CODES[data[lo : hi + k - 1]]
        a, b = np.searchsorted(ends, [lo, hi - 1], side="right") - 1
        row = np.repeat(np.arange(a, b + 1), np.diff(np.clip(ends[a : b + 2], lo, hi)))
        before = np.concatenate([[0], np.cumsum(codes == 4)])
        at = np.flatnonzero((before[k:] == before[:-k]) & (np.arange(lo + k, hi + k) <= ends[row + 1]))
        forward, mirrored = _folded(codes & 3, k, hi - lo)
        row, rc = row[at], codes[at + k // 2] >= 2
        key = (np.where(rc, mirrored[at], forward[at]) ^ np.uint64(rank_mask(k))).view(np.int64)
        begin = at + lo
        yield row, key, np.where(rc, ends[row + 1] - k - begin, begin - ends[row]).astype(np.int32), rc


def kmers(reads: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """(kmer, read_id, pos, rc): canonical k-mers and their place in the oriented read."""
    return _kmer_windows(reads, k, packed=False).select("kmer", "read_id", "pos", "rc")


def kmer_rows(reads: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """:func:`kmers` with the k-mer as its rank: (key, read_id, pos, rc).

    The form to shuffle: 24 bytes of values and no read body. Packed k-mers
    are worked out in array steps over a batch of reads.
    """
    if k > MAX_PACKED_K:
        return _kmer_windows(reads, k, packed=False).select(kmer_key(F.col("kmer"), k).alias("key"), "read_id", "pos", "rc")
    clean = _clean(reads, k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, *values in _packed_kmers(batch["seq"], k):
                key, pos, rc = map(pa.array, values)
                yield pa.RecordBatch.from_arrays([key, batch["read_id"].take(pa.array(row)), pos, rc], names=["key", "read_id", "pos", "rc"])

    id_type = clean.schema["read_id"].dataType.simpleString()
    return clean.mapInArrow(cut, f"key bigint, read_id {id_type}, pos int, rc boolean")


def kmer_counts(reads: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """(key, n): occurrences of each canonical k-mer, combined before the shuffle.

    Packed k-mers are mixed (a bijection of their bits), sorted and counted some
    two million at a time. The first bits name the part a k-mer is dealt to, so a
    run of sorted k-mers of one part is one row, four bytes a k-mer up to 22
    bases and a byte for its count. A task merges one part after the other.
    """
    if k > MAX_PACKED_K:
        return kmer_rows(reads, k).groupBy("key").agg(F.count("*").alias("n"))
    small_batches(reads.sparkSession)
    bits = 2 * k
    part_bits = min(_PART_BITS, bits)
    mask, rest_bits = np.uint64((1 << bits) - 1), np.uint64(bits - part_bits)
    rest_mask, rest_type = np.uint64((1 << (bits - part_bits)) - 1), "<u4" if bits - part_bits <= 32 else "<u8"
    mix, unmix = np.uint64(_MIX), np.uint64(pow(_MIX, -1, 1 << 64))

    def runs(held: list[np.ndarray]) -> pa.RecordBatch:
        mixed, n = np.unique((np.concatenate(held).view(np.uint64) * mix) & mask, return_counts=True)
        part = (mixed >> rest_bits).astype(np.int32)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        few = np.maximum.reduceat(n, cuts) < 256
        stops = np.append(cuts[1:], len(part)).tolist()
        rest, small, large = (mixed & rest_mask).astype(rest_type), n.astype(np.uint8), n.astype("<i8")
        spans = list(zip(cuts.tolist(), stops, few.tolist(), strict=True))
        keys = [rest[a:b].tobytes() for a, b, _ in spans]
        times = [(small if fits else large)[a:b].tobytes() for a, b, fits in spans]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts]), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["part", "rest", "times"]
        )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, key, _, _ in _packed_kmers(batch["seq"], k):
                held.append(key)
                size += len(key)
                if size >= _SORTED:
                    yield runs(held)
                    held, size = [], 0
        if size:
            yield runs(held)

    def tallied(held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        mixed, n = [], []
        for part, rest, times in held:
            rest = np.frombuffer(rest, rest_type).astype(np.uint64)
            mixed.append(rest | (np.uint64(part) << rest_bits))
            n.append(np.frombuffer(times, np.uint8 if len(times) == len(rest) else "<i8").astype(np.int64))
        mixed, n = np.concatenate(mixed), np.concatenate(n)
        order = np.argsort(mixed)
        mixed, n = mixed[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        n, key = np.add.reduceat(n, first), ((mixed[first] * unmix) & mask).view(np.int64)
        for at in range(0, len(key), _BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + _BATCH]) for x in (key, n)], names=["key", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for run in zip(*(batch[c].to_pylist() for c in ("part", "rest", "times")), strict=True):
                if size >= _SORTED and run[0] != held[-1][0]:
                    yield from tallied(held)
                    held, size = [], 0
                held.append(run)
                size += len(run[1]) // np.dtype(rest_type).itemsize
        if held:
            yield from tallied(held)

    sorted_runs = _clean(reads, k).mapInArrow(dealt, "part int, rest binary, times binary")
    by_part = sorted_runs.repartition(shuffle_partitions(reads), "part").sortWithinPartitions("part")
    return by_part.mapInArrow(merged, "key bigint, n bigint")


def with_kmer_text(df: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Replace ``key`` by the k-mer it stands for."""
    rest = [c for c in df.columns if c != "key"]
    return df.select(kmer_text(F.col("key"), k).alias("kmer"), *rest)


def read_keys(reads: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """(read_id, keys): the k-mer ranks of each read as an array, in place, without a shuffle."""
    if k > MAX_PACKED_K:
        strands = _strands(reads, k, packed=False)
        return strands.select("read_id", seq_keys(F.col("fw"), F.col("bw"), k).alias("keys"))
    clean = _clean(reads, k)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, key) for row, key, _, _ in _packed_kmers(batch["seq"], k)]
            row = np.concatenate([np.empty(0, np.int64), *(row for row, _ in found)])
            key = np.concatenate([np.empty(0, np.int64), *(key for _, key in found)])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key))
            yield pa.RecordBatch.from_arrays([batch["read_id"], lists], names=["read_id", "keys"])

    id_type = clean.schema["read_id"].dataType.simpleString()
    return clean.mapInArrow(keyed, f"read_id {id_type}, keys array<bigint>")


def bases(reads: DataFrame) -> DataFrame:
    """One row per base: (read_id, file_id, pos, i, base, qual), pos in its file."""
    cut = reads.select(
        "read_id",
        "file_id",
        "seq_offset",
        "qual",
        F.posexplode(F.split("seq", "")).alias("i", "base"),
    )
    return cut.select(
        "read_id",
        "file_id",
        (F.col("seq_offset") + F.col("i")).alias("pos"),
        "i",
        "base",
        phred_at(F.col("qual"), F.col("i")).alias("qual"),
    ).filter("base <> ''")


def spectrum(counts: DataFrame, n: str = "n") -> DataFrame:
    """(multiplicity, n_kmers): how many keys occur how often; works on any counts."""
    return counts.groupBy(F.col(n).alias("multiplicity")).agg(F.count("*").alias("n_kmers"))


def valley_and_peak(spectrum_df: DataFrame) -> DataFrame:
    """One row: valley_index, valley_multiplicity, kmer_cov, peak_kmers.

    Neighbours are adjacent *present* multiplicities. The valley is the first
    one not above its two neighbours; the peak is the largest, from there on,
    not below its neighbours (the lower multiplicity on a tie). NULL if absent.

    The ordered window runs in one task. A spectrum of N occurrences has at
    most sqrt(2 N) rows, since multiplicities are distinct and add up to N.
    """
    by_multiplicity = Window.orderBy("multiplicity")
    h, before, after = F.col("n_kmers"), F.col("before"), F.col("after")
    marked = (
        spectrum_df.withColumn("idx", (F.row_number().over(by_multiplicity) - 1).cast("bigint"))
        .withColumn("before", F.lag("n_kmers").over(by_multiplicity))
        .withColumn("after", F.lead("n_kmers").over(by_multiplicity))
        .withColumn("valley", (before >= h) & (h <= after))
        .withColumn("past", F.max("valley").over(by_multiplicity.rowsBetween(Window.unboundedPreceding, 0)))
    )
    top = F.col("past") & (before <= h) & (h >= after)
    return marked.agg(
        F.min(F.when(F.col("valley"), F.col("idx"))).alias("valley_index"),
        F.min(F.when(F.col("valley"), F.col("multiplicity"))).alias("valley_multiplicity"),
        F.max(F.when(top, F.struct(h.alias("n"), (-F.col("multiplicity")).alias("m")))).alias("peak"),
        F.sum(F.col("multiplicity") * h).alias("n_occurrences"),
    ).select(
        "valley_index",
        "valley_multiplicity",
        (-F.col("peak.m")).alias("kmer_cov"),
        F.col("peak.n").alias("peak_kmers"),
        "n_occurrences",
    )


def read_totals(reads: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """One row: bases, kmers (all windows, also with N; short reads count negative), expected_errors.

    One scan: the bases are first counted per quality (at most 94 rows leave a
    task), so the sum of error probabilities does not depend on the row order.
    """
    chars = reads.select(
        (F.length("seq") - k + 1).alias("windows"),
        F.length("seq").alias("len"),
        F.posexplode_outer(F.split("qual", "")).alias("i", "c"),
    )
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    per_quality = chars.groupBy("c").agg(
        F.sum(F.when(first, F.col("len"))).alias("bases"),
        F.sum(F.when(first, F.col("windows"))).alias("kmers"),
        F.count("*").alias("n"),
    )
    errors = F.when(F.col("c") != "", F.col("n") * error_probability(phred(F.col("c"))))
    return per_quality.agg(
        F.sum("bases").alias("bases"),
        F.sum("kmers").alias("kmers"),
        F.sum(errors).alias("expected_errors"),
    )


__all__ = [
    "bases",
    "kmer_counts",
    "kmer_rows",
    "kmers",
    "read_keys",
    "read_totals",
    "spectrum",
    "valley_and_peak",
    "with_kmer_text",
]
