"""Dataset statistics from the k-mer spectrum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import DEFAULT_K
from readloom.operators.kmers import kmer_counts, read_totals, spectrum, valley_and_peak

STAT_COLUMNS = (
    "valley_index",
    "valley_multiplicity",
    "kmer_cov",
    "peak_kmers",
    "n_occurrences",
    "bases",
    "kmers",
    "expected_errors",
)


@dataclass(frozen=True)
class Coverage:
    """Scalars of a spectrum that later steps need as plan constants."""

    kmer_cov: int
    n_occurrences: int


def coverage(counts: DataFrame) -> Coverage:
    """Run the spectrum and fetch its one row."""
    row = valley_and_peak(spectrum(counts)).first()
    if row["kmer_cov"] is None:
        raise ValueError("the k-mer spectrum has no valley with a later peak")
    return Coverage(row["kmer_cov"], row["n_occurrences"])


def dataset_stats(reads: DataFrame, k: int = DEFAULT_K, counts: DataFrame | None = None) -> DataFrame:
    """One row: spectrum marks, totals, average error rate, base coverage, genome size."""
    peaks = valley_and_peak(spectrum(counts if counts is not None else kmer_counts(reads, k)))
    # Two one-row frames side by side, without a join.
    both = peaks.unionByName(read_totals(reads, k), allowMissingColumns=True)
    row = both.agg(*(F.max(c).alias(c) for c in STAT_COLUMNS))
    rate = F.col("expected_errors") / F.col("bases")
    cover = F.col("kmer_cov") / F.pow(1 - F.col("error_rate"), F.lit(float(k))) * F.col("bases") / F.col("kmers")
    return (
        row.withColumn("error_rate", rate)
        .withColumn("base_coverage", cover)
        .withColumn("genome_size", F.col("bases") / F.col("base_coverage"))
    )
