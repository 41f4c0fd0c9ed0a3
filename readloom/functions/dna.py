"""Column expressions over DNA strings and Phred qualities.

Everything here is a built-in Spark expression, so it runs inside
whole-stage code generation and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabet, its complement, and the ASCII offset of a quality of 0.
ALPHABET = "ACGTN-"
STRAND_BASES = "ACGT"
COMPLEMENT_BASES = "TGCA"
PHRED_OFFSET = 33

# Widths of the byte position and of the gap index in an address: 62 bits together.
POSITION_BITS = 51
GAP_BITS = 11

DEFAULT_K = 21
# Two bits per base have to fit a signed 64-bit integer.
MAX_PACKED_K = 31
# Any fixed 62-bit pattern serves; it keeps poly-A from being the lowest rank.
_RANK_PATTERN = 0x2545F4914F6CDD1D


def clean_bases(seq: Column) -> Column:
    """Upper case, and N for every letter but A, C, G and T.

    Soft-masked (lower-case) bases are bases; ambiguity codes and dots are not.
    """
    return F.regexp_replace(F.upper(seq), f"[^{STRAND_BASES}]", "N")


def complement(base: Column) -> Column:
    """A<->T, C<->G; N and '-' stay."""
    return F.translate(base, STRAND_BASES, COMPLEMENT_BASES)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def on_strand(seq: Column, rc: Column) -> Column:
    """``seq`` as it reads on the strand chosen by the boolean ``rc``."""
    return F.when(rc, reverse_complement(seq)).otherwise(seq)


def check_k(k: int) -> int:
    if k < 1 or k % 2 == 0:
        raise ValueError(f"k must be odd, or a k-mer has no middle base to tell its strand: {k}")
    return k


def reads_reversed(middle: Column) -> Column:
    """True for a middle base (or its digit) whose k-mer is canonical on the other strand."""
    return middle.isin("G", "T", "2", "3")


def canonical_kmer(kmer: Column, k: int) -> Column:
    """Strand-neutral form: the strand whose middle base is A or C."""
    check_k(k)
    clean = clean_bases(kmer)
    return on_strand(clean, reads_reversed(F.substring(clean, k // 2 + 1, 1)))


def as_digits(seq: Column) -> Column:
    return F.translate(seq, STRAND_BASES, "0123")


def digits_key(digits: Column, k: int) -> Column:
    """Key of a k-mer given as base-4 digits."""
    packed = F.conv(digits, 4, 10).cast("bigint").bitwiseXOR(F.lit(rank_mask(k)))
    # Never NULL for a k-mer over ACGT; saying so keeps joins from testing the key twice.
    return F.coalesce(packed, F.lit(-1))


def rank_mask(k: int) -> int:
    return _RANK_PATTERN & ((1 << (2 * k)) - 1)


def kmer_key(kmer: Column, k: int) -> Column:
    """Rank of a k-mer in a fixed total order, usable as its join key.

    Up to 31 bases the k-mer is packed, two bits a base, in a bigint: no two
    k-mers share a key and a shuffled row is a third of its text form. The
    mask spreads the low ranks over the k-mers. Longer k-mers keep their text
    behind its digest.
    """
    if k > MAX_PACKED_K:
        return F.concat(F.md5(kmer), kmer)
    return digits_key(as_digits(kmer), k)


def kmer_text(key: Column, k: int) -> Column:
    """Inverse of :func:`kmer_key`."""
    if k > MAX_PACKED_K:
        return F.substring(key, 33, k)
    digits = F.conv(key.bitwiseXOR(F.lit(rank_mask(k))).cast("string"), 10, 4)
    return F.translate(F.lpad(digits, k, "0"), "0123", STRAND_BASES)


def seq_keys(fw: Column, bw: Column, k: int) -> Column:
    """Array of the keys of all k-mers without N of one sequence.

    ``fw`` and ``bw`` are its two strands, as digits where the k-mers are packed.
    """
    check_k(k)
    size = F.length(fw)
    key = digits_key if k <= MAX_PACKED_K else kmer_key

    def key_at(i: Column) -> Column:
        forward = F.substr(fw, i + 1, F.lit(k))
        flipped = reads_reversed(F.substr(fw, i + k // 2 + 1, F.lit(1)))
        kmer = F.when(flipped, F.substr(bw, size - k - i + 1, F.lit(k))).otherwise(forward)
        return F.when(~F.contains(forward, F.lit("N")), key(kmer, k))

    keys = F.array_compact(F.transform(F.sequence(F.lit(0), size - k), key_at))
    none = F.array().cast("array<bigint>" if k <= MAX_PACKED_K else "array<string>")
    # Never NULL, so that no join pushes a second evaluation below itself.
    return F.coalesce(F.when(size >= k, keys), none)


def phred(char: Column) -> Column:
    """Quality of one quality character."""
    return F.ascii(char) - PHRED_OFFSET


def phred_at(qual: Column, index0: Column) -> Column:
    """Quality at a 0-based position of a quality string."""
    return phred(F.substr(qual, index0 + 1, F.lit(1)))


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def base_rank(base: Column) -> Column:
    """Order of the bases used to break ties: lowest character first."""
    return F.ascii(base)


def trimmed_length(segment: Column) -> Column:
    """Length without the repeats of the first and of the last base (at least 1)."""
    once = F.regexp_replace(segment, r"^(.)\1+", "$1")
    return F.length(F.regexp_replace(once, r"(.)\1+$", "$1"))


def node_key(address: Column, gap: Column) -> Column:
    """Address of a base (or of a gap behind it) as one bigint below 2**62.

    ``address`` is a byte position in the input files laid end to end, 51
    bits; 11 bits of gap index. A value that doesn't fit is an error.
    """
    fits = address.between(0, (1 << POSITION_BITS) - 1) & gap.between(0, (1 << GAP_BITS) - 1)
    packed = F.shiftleft(address.cast("bigint"), GAP_BITS) + gap.cast("bigint")
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("a base address doesn't fit in 62 bits")).cast("bigint"))


def node_address(node: Column) -> dict[str, Column]:
    """Inverse of :func:`node_key`."""
    return {
        "address": F.shiftright(node, GAP_BITS),
        "gap": node.bitwiseAND(F.lit((1 << GAP_BITS) - 1)).cast("int"),
    }


def pack_call(base: Column, q: Column) -> Column:
    """Base and quality as one integer, which aggregates without a string buffer."""
    return q.cast("int") * 128 + F.ascii(base)


def called_base(call: Column) -> Column:
    return F.char(call % 128)


def called_quality(call: Column) -> Column:
    return F.shiftright(call, 7)
