"""Read correction end to end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from readloom.functions.dna import DEFAULT_K
from readloom.operators.correct import call_corrections, edge_nodes, position_members
from readloom.operators.graph import signed_components
from readloom.operators.groups import REPEAT_FOLD, nonredundant_groups
from readloom.operators.kmers import kmer_counts, read_keys
from readloom.operators.pileup import (
    agreeing_reads,
    anchored_reads,
    by_alignment,
    column_edges,
    equal_print_clusters,
    polymorphic_columns,
    read_fingerprints,
)
from readloom.operators.prints import CUT_THRESHOLD, cluster_fingerprints
from readloom.plans.spectrum import Coverage, coverage
from readloom.session import materialize


@dataclass(frozen=True)
class Prepared:
    """Reads with the written tables that all later steps start from."""

    reads: DataFrame
    k: int
    counts: DataFrame
    coverage: Coverage
    max_fold: int = REPEAT_FOLD

    @cached_property
    def groups(self) -> DataFrame:
        """The non-redundant groups, found and written when a step first asks for them."""
        cover = self.coverage
        found = nonredundant_groups(self.reads, self.counts, cover.kmer_cov, cover.n_occurrences, self.k, self.max_fold)
        return materialize(found, "groups")


def prepare(reads: DataFrame, k: int = DEFAULT_K, max_fold: int = REPEAT_FOLD) -> Prepared:
    """Count k-mers and read off the coverage; the non-redundant groups follow when they are asked for."""
    counts = materialize(kmer_counts(reads, k), "counts")
    return Prepared(reads, k, counts, coverage(counts), max_fold)


def clusters(prepared: Prepared, cut: int | None = CUT_THRESHOLD) -> DataFrame:
    """Aligned reads with the cluster of compatible fingerprints, or of equal ones where ``cut`` is None."""
    aligned = materialize(agreeing_reads(anchored_reads(prepared.groups, prepared.reads)), "agreeing")
    aligned = by_alignment(aligned)
    marks = polymorphic_columns(aligned, prepared.coverage.kmer_cov)
    prints = read_fingerprints(aligned, marks)
    return equal_print_clusters(prints) if cut is None else cluster_fingerprints(prints, cut)


def members_of(prepared: Prepared, clustered: DataFrame) -> DataFrame:
    """Members of the components of base addresses."""
    clustered = by_alignment(materialize(clustered, "clustered"))
    edges = materialize(column_edges(clustered, read_keys(prepared.reads, prepared.k)), "cells")
    labels = signed_components(edges)
    return position_members(labels, edge_nodes(edges))


def correct_reads(
    reads: DataFrame, k: int = DEFAULT_K, cut: int | None = CUT_THRESHOLD, max_fold: int = REPEAT_FOLD
) -> DataFrame:
    """Corrections (address, gap, base, qual) of substitutions."""
    prepared = prepare(reads, k, max_fold)
    members = members_of(prepared, clusters(prepared, cut))
    return call_corrections(members, prepared.coverage.kmer_cov)
