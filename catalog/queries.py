"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import reads as source
from readloom.functions.dna import error_probability, reverse_complement
from readloom.functions.stats import binomial_quantile
from readloom.operators import columns, correct, graph, groups, kmers, overlap, paired, pileup, prints
from readloom.plans import correction
from readloom.plans.spectrum import coverage, dataset_stats
from readloom.session import materialize, shared_folder
from readloom.sources.fastq import read_fastq
from readloom.sources.sinks import write_fastq

# The cells are partitioned by tile, so grouping by both needs no shuffle.
GENOME_COLUMN = ["tile", "col"]

_shared: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """Tables that several queries start from are derived once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def prepared(spark: SparkSession, sf_dir: str) -> correction.Prepared:
    return _once(spark, sf_dir, "prepared", lambda: correction.prepare(source.reads(spark, sf_dir)))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmer_counts(source.reads(spark, sf_dir))


def _text(df: DataFrame) -> DataFrame:
    return kmers.with_kmer_text(df)


def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.reads(spark, sf_dir).select("read_id", reverse_complement(F.col("seq")).alias("rc_seq"))


def all_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.kmers(source.reads(spark, sf_dir))


def canonical_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_counts(spark, sf_dir))


def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.spectrum(_counts(spark, sf_dir))


def spectrum_valley_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.valley_and_peak(kmer_spectrum(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = dataset_stats(source.reads(spark, sf_dir))
    real = ("expected_errors", "error_rate", "base_coverage", "genome_size")
    return row.select(*(F.round(c, 6).alias(c) if c in real else c for c in row.columns))


def phred_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = kmers.bases(source.reads(spark, sf_dir))
    return bases.groupBy("read_id").agg(
        F.count("*").alias("n_bases"),
        F.min("pos").alias("first_pos"),
        F.sum("qual").alias("sum_q"),
        F.round(F.sum(error_probability(F.col("qual"))), 6).alias("expected_errors"),
    )


def kmer_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepared(spark, sf_dir)
    return _text(groups.group_sizes(ready.counts, ready.coverage.kmer_cov))


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepared(spark, sf_dir)
    cover = ready.coverage
    return groups.banded_rows(kmers.kmer_rows(ready.reads), ready.counts, cover.kmer_cov, cover.n_occurrences)


def group_reads_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(groups.ordered_groups(_banded(spark, sf_dir)))


def nonredundant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(prepared(spark, sf_dir).groups)


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(groups.overlap_pairs(_banded(spark, sf_dir)))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepared(spark, sf_dir)
    return _once(
        spark,
        sf_dir,
        "links",
        lambda: materialize(groups.minimal_links(_banded(spark, sf_dir), kmers.read_keys(ready.reads)), "links"),
    )


def min_common_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_links(spark, sf_dir))


def _sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate overlaps with both sequences."""
    candidates = groups.overlap_pairs(_banded(spark, sf_dir)).drop("n_kmers", "key")
    return overlap.oriented_pairs(candidates, source.reads(spark, sf_dir))


def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.score_overlaps(_sequence_pairs(spark, sf_dir)).drop("seq_a", "seq_b")


def overlap_scores_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.score_overlaps(_sequence_pairs(spark, sf_dir), early=True).drop("seq_a", "seq_b")


def _text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked reads as (pair_id, template, pattern), both as they were read."""
    pairs = _links(spark, sf_dir).select("a", "b", F.lit(False).alias("rc_a"), F.lit(False).alias("rc_b"))
    both = overlap.oriented_pairs(pairs, source.reads(spark, sf_dir))
    ids = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
    return both.select(ids.alias("pair_id"), F.col("seq_a").alias("template"), F.col("seq_b").alias("pattern"))


def exact_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.exact_segments(_text_pairs(spark, sf_dir))


def diagonal_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.diagonal_vote(exact_segments(spark, sf_dir))


def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.longest_match(exact_segments(spark, sf_dir), _text_pairs(spark, sf_dir))


def _document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside the first one with the same least digest of five words: (pair_id, template, pattern)."""

    def build() -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

        def least(words: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1)))
            five = F.transform(starts, lambda i: F.md5(F.array_join(F.slice(words, i, 5), " ").cast("binary")))
            return F.array_min(five)

        # the array of one keeps the words from being split anew for each five of them
        key = F.transform(F.array(F.split("text", " ")), least)[0]
        keyed = materialize(docs.select("doc_id", key.alias("key")), "document-keys")
        first = keyed.groupBy("key").agg(F.min("doc_id").alias("a"))
        pairs = keyed.join(first, "key").filter("doc_id > a").select("a", F.col("doc_id").alias("b"))
        one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("template"))
        two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("pattern"))
        made = pairs.join(one, "a").join(two, "b")
        ids = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
        return materialize(made.select(ids.alias("pair_id"), "template", "pattern"), "document-pairs")

    return _once(spark, sf_dir, "document-pairs", build)


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "document-segments", lambda: overlap.unique_segments(_document_pairs(spark, sf_dir), min_len=50)
    )


def document_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where most of a document lies in the one it resembles, and the longest passage of both."""
    segments = document_segments(spark, sf_dir)
    pairs = _document_pairs(spark, sf_dir)
    longest = overlap.longest_match(segments, pairs).select("pair_id", F.col("len").alias("longest"))
    return longest.join(overlap.diagonal_vote(segments), "pair_id", "left").na.fill(0, ["diagonal", "votes"])


def column_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_votes(source.genome_columns(spark, sf_dir), GENOME_COLUMN).drop("tile")


def column_reference_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.reference_bases(source.genome_columns(spark, sf_dir), GENOME_COLUMN).drop("tile")


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = source.genome_columns(spark, sf_dir)
    per_column = cells.groupBy(*GENOME_COLUMN).agg(
        F.count("*").alias("n"), (1 - F.avg(error_probability(F.col("qual")))).alias("p")
    )
    # cut to six places where no number of nine places is a border
    cut = F.floor(binomial_quantile(F.col("n"), F.col("p")) * 1e6 + 0.3337) / 1e6
    return per_column.select("col", "n", cut.alias("quantile"))


def column_error_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_error_test(source.genome_columns(spark, sf_dir), GENOME_COLUMN).drop("tile")


def weighted_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return columns.weighted_consensus(events, ["user_id"], "event_type", cents)


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepared(spark, sf_dir)
    return pileup.anchored_reads(ready.groups, ready.reads)


def _agreeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _once(
        spark, sf_dir, "agreeing", lambda: materialize(pileup.agreeing_reads(_aligned(spark, sf_dir)), "agreeing")
    )
    return pileup.by_alignment(made)


def consensus_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pileup.alignment_consensus(_aligned(spark, sf_dir), keep_gaps=False)
    return _text(made.select("key", "consensus"))


def pileup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(pileup.pileup(_aligned(spark, sf_dir)).drop("aln"))


def read_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(pileup.read_identity(_aligned(spark, sf_dir)).drop("aln"))


def polymorphic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = prepared(spark, sf_dir).coverage.kmer_cov
    return _text(pileup.polymorphic_columns(_agreeing(spark, sf_dir), cov).drop("aln"))


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = prepared(spark, sf_dir).coverage.kmer_cov
    aligned = _agreeing(spark, sf_dir)
    return pileup.read_fingerprints(aligned, pileup.polymorphic_columns(aligned, cov))


def read_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _fingerprints(spark, sf_dir)
    return _text(
        printed.select(
            "key", "ord", "read_id", "print", F.array_join(F.transform("print_q", lambda q: q.cast("string")), ",").alias("print_q")
        )
    )


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _once(
        spark,
        sf_dir,
        "clustered",
        lambda: materialize(pileup.equal_print_clusters(_fingerprints(spark, sf_dir)), "clustered"),
    )
    return pileup.by_alignment(made)


def _cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = kmers.read_keys(source.reads(spark, sf_dir))
    return pileup.column_cliques(_clustered(spark, sf_dir), keys)


def column_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_cliques(spark, sf_dir).drop("aln"))


def clique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clique_edges(_cliques(spark, sf_dir), ["key", "cluster", "col"])


def _supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    return items.select(
        (F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"), sign.alias("s")
    ).distinct()


def large_star_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.large_star(_supply_edges(spark, sf_dir))


def small_star_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supply_edges(spark, sf_dir)
    downward = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "s")
    return graph.small_star(downward)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_supply_edges(spark, sf_dir))


def _strand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked reads and whether they lie on the same strand."""
    flags = groups.overlap_pairs(_banded(spark, sf_dir))
    strand = flags.select("a", "b", "key", F.when(F.col("rc_a") == F.col("rc_b"), 1).otherwise(-1).alias("s"))
    linked = _links(spark, sf_dir).join(strand, ["a", "b", "key"])
    return linked.select(F.col("a").alias("u"), F.col("b").alias("v"), "s")


def signed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.signed_components(_strand_edges(spark, sf_dir))


def sign_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked reads, and a few links said with both signs."""
    edges = _strand_edges(spark, sf_dir)
    planted = edges.filter(F.col("u") % 7936 == 16).select("u", "v", (-F.col("s")).alias("s"))
    return graph.contradicting_components(edges.unionByName(planted))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        ready = prepared(spark, sf_dir)
        return materialize(correction.members_of(ready, _clustered(spark, sf_dir)), "members")

    return _once(spark, sf_dir, "members", build)


def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.with_file(_members(spark, sf_dir), source.files(spark, sf_dir))


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.call_corrections(_members(spark, sf_dir), prepared(spark, sf_dir).coverage.kmer_cov)


def call_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.with_file(_corrections(spark, sf_dir), source.files(spark, sf_dir))


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with the called corrections, and planted ones that drop and insert bases."""
    reads = source.reads(spark, sf_dir)
    dropped = reads.filter(F.col("rec_offset") % 1792 == 0).select(
        (F.col("address") + 3).alias("address"), F.lit(0).alias("gap"), F.lit("-").alias("base"), F.lit(5).alias("qual")
    )
    inserted = reads.filter(F.col("rec_offset") % 2816 == 0).select(
        (F.col("address") + 5).alias("address"), F.explode(F.array(F.lit(1), F.lit(2))).alias("gap")
    )
    inserted = inserted.select(
        "address", "gap", F.when(F.col("gap") == 1, "A").otherwise("C").alias("base"), (F.col("gap") + 6).alias("qual")
    )
    fixes = _corrections(spark, sf_dir).unionByName(dropped).unionByName(inserted)
    return correct.apply_corrections(reads, fixes)


def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir).select("read_id", "seq", "qual")


def _read_back(spark: SparkSession, reads: DataFrame) -> DataFrame:
    """``reads`` written as FASTQ, a folder for each of the two files, and both read back together."""
    folder = f"{shared_folder(spark).rstrip('/')}/fastq-{uuid.uuid4().hex}"
    write_fastq(reads, folder)
    return read_fastq(spark, [f"{folder}/file_id=0", f"{folder}/file_id=1"])


def lifted_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads scanned, corrected, written and scanned again: their new address as read and as lifted over."""
    named = F.concat_ws("/", "name", (F.col("file_id") + 1).cast("string")).alias("name")  # of both mates
    scanned = _read_back(spark, source.reads(spark, sf_dir).select("read_id", "file_id", named, "seq", "qual"))
    fixed = materialize(_corrected(spark, sf_dir).select("read_id", "file_id", named, "seq", "qual"), "corrected")
    back = _read_back(spark, fixed)
    after = scanned.select("read_id", "name").join(fixed.select("name", "seq"), "name")
    lifted = correct.lift_over(scanned, after).join(scanned.select("read_id", "name"), "read_id")
    return back.select("name", "seq", "address").join(lifted.select("name", "lifted"), "name")


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived reads written as FASTQ, a folder for each file, and both read back together with their offsets."""
    back = _read_back(spark, source.reads(spark, sf_dir))
    return back.select("name", "seq", "qual", "address", (F.col("address") - F.col("seq_offset") + F.col("rec_offset")).alias("record_at"))


def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepared(spark, sf_dir)
    return groups.outside_band(ready.counts, ready.coverage.kmer_cov)


def fingerprint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = prints.cluster_fingerprints(_fingerprints(spark, sf_dir))
    return _text(clustered.select("key", "ord", "read_id", "cluster"))


def column_error_test_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_error_test_exact(source.genome_columns(spark, sf_dir), GENOME_COLUMN).drop("tile")


def _paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = paired.paired_rows(source.mate_pairs(spark, sf_dir))
        counts = materialize(rows.groupBy("key").agg(F.count("*").alias("n")), "paired-counts")
        cover = coverage(counts)
        return materialize(
            groups.banded_rows(rows, counts, cover.kmer_cov, cover.n_occurrences), "paired-rows"
        )

    return _once(spark, sf_dir, "paired", build)


def paired_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = groups.overlap_pairs(_paired_rows(spark, sf_dir))
    return overlap.paired_best_match(candidates, source.mate_pairs(spark, sf_dir))


def paired_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    mates = source.mate_pairs(spark, sf_dir)
    keys = _once(spark, sf_dir, "mate-keys", lambda: materialize(paired.mate_keys(mates), "mate-keys"))
    groups_of = paired.linked_groups(paired.by_mate(_paired_rows(spark, sf_dir)), keys)
    laid = materialize(paired.paired_alignments(materialize(groups_of, "paired-groups"), mates), "paired-laid")
    return _text(paired.paired_cliques(laid, keys, mates))


QUERIES = {
    "paired_cliques": paired_cliques,
    "read_fastq": fastq_round_trip,
    "repeat_groups": repeat_groups,
    "reverse_complement": reverse_complements,
    "kmers": all_kmers,
    "canonical_kmer_counts": canonical_kmer_counts,
    "kmer_spectrum": kmer_spectrum,
    "spectrum_valley_peak": spectrum_valley_peak,
    "dataset_stats": stats,
    "phred_bases": phred_bases,
    "kmer_group_sizes": kmer_group_sizes,
    "group_reads_ordered": group_reads_ordered,
    "nonredundant_groups": nonredundant_groups,
    "overlap_pairs": overlap_pairs,
    "min_common_kmer": min_common_kmer,
    "overlap_scores": overlap_scores,
    "overlap_scores_early": overlap_scores_early,
    "exact_segments": exact_segments,
    "diagonal_vote": diagonal_vote,
    "longest_match": longest_match,
    "document_segments": document_segments,
    "document_shifts": document_shifts,
    "column_votes": column_votes,
    "column_reference_base": column_reference_base,
    "binomial_quantile": quantiles,
    "column_error_test": column_error_test,
    "weighted_consensus": weighted_consensus,
    "consensus_sequence": consensus_sequence,
    "pileup": pileup_table,
    "read_identity": read_identity,
    "polymorphic_columns": polymorphic_columns,
    "read_fingerprints": read_fingerprints,
    "column_cliques": column_cliques,
    "clique_edges": clique_edges,
    "large_star_once": large_star_once,
    "small_star_once": small_star_once,
    "components": components,
    "signed_components": signed_components,
    "sign_conflicts": sign_conflicts,
    "component_members": component_members,
    "call_corrections": call_corrections,
    "apply_corrections": apply_corrections,
    "lifted_addresses": lifted_addresses,
    "paired_best_match": paired_best_match,
    "fingerprint_clusters": fingerprint_clusters,
    "column_error_test_exact": column_error_test_exact,
}
