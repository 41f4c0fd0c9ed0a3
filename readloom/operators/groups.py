"""Groups of reads that share a k-mer: size band, order, redundancy, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import DEFAULT_K
from readloom.operators.kmers import kmer_rows, read_keys
from readloom.session import shuffle_partitions

# Groups of this many coverages or more are repeats, unless an operator is told otherwise.
REPEAT_FOLD = 20


def in_size_band(n: Column, kmer_cov: int, max_fold: int = REPEAT_FOLD) -> Column:
    return (n > 1) & (n < max_fold * kmer_cov)


def group_sizes(counts: DataFrame, kmer_cov: int, max_fold: int = REPEAT_FOLD) -> DataFrame:
    """(key, n) of the k-mers neither unique nor repeats; an occurrence counts, not a read."""
    return counts.filter(in_size_band(F.col("n"), kmer_cov, max_fold))


def outside_band(counts: DataFrame, kmer_cov: int, max_fold: int = REPEAT_FOLD) -> DataFrame:
    """One row: how many k-mers the size band leaves out as unique or as repeats, and their occurrences."""
    unique, repeat = F.col("n") <= 1, F.col("n") >= max_fold * kmer_cov
    return counts.agg(
        F.count_if(unique).alias("unique_keys"),
        F.count_if(repeat).alias("repeat_keys"),
        F.coalesce(F.sum(F.when(repeat, F.col("n"))), F.lit(0)).alias("repeat_rows"),
    )


def heavy_share(n_partitions: int) -> int:
    """A key with at least 1/heavy_share of all rows is heavy.

    There are at most that many such keys, whatever the data, so a list of
    them can be broadcast (8 bytes each: 8 MB for 100,000 partitions). Every
    other key is a tenth of a mean partition at most.
    """
    return 10 * max(1000, n_partitions)


def light_rows(
    rows: DataFrame, counts: DataFrame, kmer_cov: int, n_occurrences: int, max_fold: int = REPEAT_FOLD
) -> DataFrame:
    """k-mer rows without those of repeats heavy enough to overload a task.

    The dropped keys lie outside the size band. Their number is bounded where
    ``n_occurrences`` is the sum of ``counts``; the limit below makes it so
    whatever the caller passes.
    """
    share = heavy_share(shuffle_partitions(rows))
    heavy_from = max(max_fold * kmer_cov, n_occurrences // share + 1)
    heavy = counts.filter(F.col("n") >= heavy_from).orderBy(F.desc("n")).limit(share).select("key")
    return rows.join(F.broadcast(heavy), "key", "left_anti")


def banded_rows(
    rows: DataFrame, counts: DataFrame, kmer_cov: int, n_occurrences: int, max_fold: int = REPEAT_FOLD
) -> DataFrame:
    """k-mer rows of the groups inside the size band."""
    light = light_rows(rows, counts, kmer_cov, n_occurrences, max_fold)
    return light.join(group_sizes(counts, kmer_cov, max_fold).select("key"), "key", "left_semi")


def group_order() -> Window:
    """Reads of a group by oriented position, furthest first, then by address."""
    return Window.partitionBy("key").orderBy(F.desc("pos"), "read_id", "rc")


def ordered_groups(rows: DataFrame) -> DataFrame:
    """Add ``ord``, the 0-based place of a read in its group."""
    return rows.withColumn("ord", F.row_number().over(group_order()) - 1)


def consecutive_pairs(rows: DataFrame) -> DataFrame:
    """Each read of a group with the one before it: one row per read, never all pairs.

    Columns key, a (earlier read), b, rc_a, rc_b, offset (= pos a - pos b, the
    index in oriented a of the first base of oriented b).
    """
    w = group_order()
    # The window reads plain rows, so plans that order the same groups share one shuffle.
    return (
        rows.withColumn("a", F.lag("read_id").over(w))
        .withColumn("rc_a", F.lag("rc").over(w))
        .withColumn("pos_a", F.lag("pos").over(w))
        .filter("a is not null")
        .select(
            "key",
            "a",
            F.col("read_id").alias("b"),
            "rc_a",
            F.col("rc").alias("rc_b"),
            (F.col("pos_a") - F.col("pos")).alias("offset"),
        )
    )


def overlap_pairs(rows: DataFrame) -> DataFrame:
    """Candidate overlaps: (a, b, rc_a, rc_b, offset, n_kmers, key), key the lowest shared rank."""
    return (
        consecutive_pairs(rows)
        .groupBy("a", "b", "rc_a", "rc_b", "offset")
        .agg(F.count("*").alias("n_kmers"), F.min("key").alias("key"))
    )


def shares_no_lower_key(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (key, a, b, ...) for which ``key`` is the lowest k-mer that a and b share.

    ``keys`` is (read_id, keys). Two joins on read ids; nothing is compared
    beyond the given pairs. Of a's k-mers only those up to ``key`` go on to
    the second join: the others cannot be the lowest.
    """
    left = keys.select(F.col("read_id").alias("a"), F.col("keys").alias("keys_a"))
    right = keys.select(F.col("read_id").alias("b"), F.col("keys").alias("keys_b"))
    low = F.filter("keys_a", lambda x: x <= F.col("key"))
    return (
        pairs.join(left, "a")
        .withColumn("keys_a", low)
        .join(right, "b")
        .filter(F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key"))
        .select(*pairs.columns)
    )


def minimal_links(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, key): consecutive reads linked in the group of their lowest common k-mer.

    Only the lowest group in which two reads follow each other can be that of
    their lowest common k-mer, so the pairs shrink to one row each before the
    k-mers of the reads are joined in.
    """
    lowest = consecutive_pairs(rows).groupBy("a", "b").agg(F.min("key").alias("key"))
    return shares_no_lower_key(lowest, keys)


def nonredundant_groups(
    reads: DataFrame,
    counts: DataFrame,
    kmer_cov: int,
    n_occurrences: int,
    k: int = DEFAULT_K,
    max_fold: int = REPEAT_FOLD,
) -> DataFrame:
    """Groups in which some consecutive pair is linked: (key, read_id, pos, rc, ord).

    The few groups kept are cut from the reads again rather than carried
    through the steps that find them.
    """
    rows = light_rows(kmer_rows(reads, k), counts, kmer_cov, n_occurrences, max_fold)
    banded = rows.join(group_sizes(counts, kmer_cov, max_fold).select("key"), "key", "left_semi")
    kept = minimal_links(banded, read_keys(reads, k)).select("key").distinct()
    ordered = ordered_groups(rows.join(kept, "key", "left_semi"))
    return ordered.select("key", "read_id", "pos", "rc", "ord")
