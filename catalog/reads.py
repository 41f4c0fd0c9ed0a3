"""DNA reads derived from the ``orders`` table, in Spark and in SQL.

The driver's tables hold no DNA. Every order gives one read pair: its key is
hashed to a start in a genome whose bases are hashes of their positions, so the
number of reads and the genome grow with the table and coverage stays near 30.
The reads carry substitutions (low quality), a few N, lower-case bases, ambiguity
codes and dots, insertions and deletions, and two haplotypes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.dna import PHRED_OFFSET, called_base, called_quality, clean_bases, on_strand
from readloom.session import materialize

READ_SCHEMA = (
    "read_id bigint, file_id int, rec_offset bigint, seq_offset bigint, address bigint, name string, "
    "seq string, qual string"
)
# Bytes set aside for one record in the made-up file layout.
RECORD_BYTES = 256


def _hex_number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def _genome(orders: DataFrame) -> DataFrame:
    """One row: the length of the genome."""
    return orders.agg(F.greatest(F.floor(F.count("*") * 20 / 3), F.lit(400)).alias("g"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))


def _mates(orders: DataFrame, genome: Column) -> DataFrame:
    """(orders, mate, rev, hap, indel, len, start): where the two reads of each order lie, and what befalls them."""
    digest = F.md5(F.concat(F.lit("s"), F.col("id").cast("string")))
    placed = orders.withColumn("d", digest).select(
        *orders.columns,
        (F.col("id") % 2 == 1).alias("rev"),
        F.pmod(_hex_number(F.col("d"), 1, 12), genome).alias("st"),
        (F.substring("d", 13, 1) <= "7").alias("hap"),
        F.substring("d", 14, 1).alias("indel"),
        (85 + _hex_number(F.col("d"), 15, 1)).cast("int").alias("len"),
        (100 + F.pmod(_hex_number(F.col("d"), 16, 4), F.lit(100))).alias("ins"),
    )
    mated = placed.withColumn("mate", F.explode(F.array(F.lit(0), F.lit(1))))
    start = F.col("st") + F.when(F.col("mate") == 1, F.col("ins")).otherwise(0)
    return mated.withColumn("start", start).drop("st", "ins")


def _place(i: Column) -> Column:
    """Genome position of base ``i`` of a mate."""
    shift = (
        F.when((F.col("indel") == "0") & (i >= 50), 1)
        .when((F.col("indel") == "1") & (i >= 50), -1)
        .otherwise(0)
    )
    return F.col("start") + i + shift


@F.pandas_udf(T.StructType([T.StructField("raw", T.StringType()), T.StructField("qual", T.StringType())]))
def _sequence_of(
    id: pd.Series, mate: pd.Series, start: pd.Series, length: pd.Series, hap: pd.Series, indel: pd.Series, times: pd.Series
) -> pd.DataFrame:
    """Letters and qualities of whole mates, each repeated ``times``."""
    row, raw, q = _bases_of(id, mate, start, length, hap, indel)
    each = times.to_numpy(np.int64)
    row_times, stops = each[row], np.cumsum(length.to_numpy(np.int64) * each).tolist()
    letters = np.repeat(np.frombuffer(b"ACGTNacgtnR.", np.uint8)[raw], row_times).tobytes().decode()
    quals = np.repeat((q + PHRED_OFFSET).astype(np.uint8), row_times).tobytes().decode()
    cuts = list(zip([0, *stops[:-1]], stops, strict=True)) if stops else []
    return pd.DataFrame({"raw": [letters[a:b] for a, b in cuts], "qual": [quals[a:b] for a, b in cuts]})


@F.pandas_udf(T.ArrayType(T.ShortType()))
def _calls_of(
    id: pd.Series, mate: pd.Series, start: pd.Series, length: pd.Series, hap: pd.Series, indel: pd.Series
) -> pd.Series:
    """Letter as a FASTQ scan has it and quality of each base of whole mates, packed as :func:`pack_call` does."""
    row, raw, q = _bases_of(id, mate, start, length, hap, indel)
    calls = (q * 128 + np.frombuffer(b"ACGTNACGTNNN", np.uint8)[raw]).astype(np.int16)
    return pd.Series(np.split(calls, np.cumsum(length.to_numpy(np.int64))[:-1]) if len(length) else [], dtype=object)


def _bases_of(
    id: pd.Series, mate: pd.Series, start: pd.Series, length: pd.Series, hap: pd.Series, indel: pd.Series
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, raw letter (an index in ACGTNacgtnR.) and quality of each base, by hashes of the base and of its place."""
    lens = length.to_numpy(np.int64)
    row, ends = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens)
    i = np.arange(len(row)) - (ends - lens)[row]
    shift = np.where(indel == "0", 1, np.where(indel == "1", -1, 0))
    g = start.to_numpy(np.int64)[row] + i + np.where(i >= 50, shift[row], 0)
    names = np.array([f"{a}:{b}:".encode() for a, b in zip(id, mate, strict=True)], dtype=np.bytes_)
    raw, q, haps = np.empty(len(row), np.int64), np.empty(len(row), np.int64), hap.to_numpy(bool)
    for at in range(0, len(row), _STRETCH):
        here = slice(at, at + _STRETCH)
        m, gm = _digests(names, row[here], i[here]), _digests(None, None, g[here])
        raw[here], q[here] = _drawn(m, gm, haps[row[here]])
    return row, raw, q


def _drawn(m: np.ndarray, gm: np.ndarray, hap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw letters and qualities by the hashes of bases and of their genome positions."""
    # nibble n of a digest is letter n + 1 of its hexadecimal form
    nibble = lambda d, n: d[:, n // 2] >> 4 if n % 2 == 0 else d[:, n // 2] & 15
    zero = lambda d, first, last: ~np.any([nibble(d, n) for n in range(first, last + 1)], axis=0)
    own = (nibble(gm, 0) & 3) ^ np.where(hap & zero(gm, 1, 2), 2, 0)
    wrong, none = m[:, 0] < 3, zero(m, 2, 4)
    base = np.where(none, 4, np.where(wrong, (own + 1) & 3, own))
    lower = np.where(zero(m, 7, 8), 5, 0)
    raw = np.where(zero(m, 9, 11), 10, np.where(zero(m, 12, 14), 11, base + lower))
    q = np.where(none, 2, np.where(wrong, 5, (nibble(m, 5).astype(np.int64) * 16 + nibble(m, 6)) % 30 + 10))
    return raw, q


# Texts that are hashed in one go: few enough for a cache.
_STRETCH = 1 << 15
_SHIFTS = [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]
_SINES = [np.uint32(int(abs(math.sin(n + 1)) * (1 << 32))) for n in range(64)]
_BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _digests(names: np.ndarray | None, row: np.ndarray | None, numbers: np.ndarray) -> np.ndarray:
    """The first eight bytes of the MD5 of each number in decimals, from 0 on, behind ``names[row]``.

    All texts go through the rounds of MD5 together, each as one block: they have 55 bytes at most.
    """
    n = len(numbers)
    size = np.searchsorted(10 ** np.arange(1, 19), numbers, side="right") + 1
    width = 0 if names is None else names.itemsize
    if width + int(size.max(initial=0)) > 55:
        raise ValueError("a name is too long for one block of MD5")
    block = np.zeros((n, 64), np.uint8)
    head = np.zeros(n, np.int64)
    if names is not None:
        block[:, :width] = names.view(np.uint8).reshape(len(names), width)[row]
        head = np.char.str_len(names)[row]
    for digits in np.unique(size).tolist():
        of = np.flatnonzero(size == digits)
        value, at = numbers[of], head[of]
        for place in range(digits - 1, -1, -1):
            value, digit = np.divmod(value, 10)
            block[of, at + place] = digit + 48
    length = head + size
    block[np.arange(n), length] = 128
    words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32, copy=False)
    words[14] = length * 8
    return _md5_start(words)


def _md5_start(words: np.ndarray) -> np.ndarray:
    """The first eight bytes of the digests of blocks, sixteen words a column."""
    used = words.any(axis=1)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _BEGIN)
    f, high = np.empty_like(a), np.empty_like(a)
    for n in range(64):
        if n < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = n
        elif n < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * n + 1) % 16
        elif n < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * n + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * n % 16
        f += a
        f += _SINES[n]
        if used[at]:
            f += words[at]
        np.right_shift(f, np.uint32(32 - _SHIFTS[n]), out=high)
        np.left_shift(f, np.uint32(_SHIFTS[n]), out=f)
        f |= high
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([a + _BEGIN[0], b + _BEGIN[1]], axis=1).astype("<u4", copy=False).view(np.uint8)


def _tasks(spark: SparkSession) -> int:
    """Small rows become long reads, so adaptive execution must not size these partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _file_bytes(spark: SparkSession, sf_dir: str):
    """Size of each of the two made-up files."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.agg((F.coalesce(F.max("o_orderkey"), F.lit(-1)) + 1) * RECORD_BYTES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, start, bytes) of the two files laid end to end."""
    size = _file_bytes(spark, sf_dir).scalar()
    return spark.range(2).select(F.col("id").cast("int").alias("file_id"), (F.col("id") * size).alias("start"), size.alias("bytes"))


def _derived_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as a FASTQ scan gives them, each put together in its own row.

    Repeated orders are one read in which every letter is repeated.
    """
    orders = _orders(spark, sf_dir)
    counted = orders.repartition(_tasks(spark), "id").groupBy("id").agg(F.count("*").cast("int").alias("times"))
    mates = _mates(counted, _genome(orders).scalar()).filter("id is not null")
    made = mates.select("id", "mate", "rev", _sequence_of("id", "mate", "start", "len", "hap", "indel", "times").alias("of"))
    file_bytes = _file_bytes(spark, sf_dir).scalar()
    rec_offset = F.col("id") * RECORD_BYTES
    # The second mate is read from the opposite strand.
    rev = F.col("rev") != (F.col("mate") == 1)
    address = F.col("mate") * file_bytes + rec_offset + 16
    laid = made.select("id", "mate", clean_bases(F.col("of.raw")).alias("seq"), "of.qual", rev.alias("rev"))
    return laid.select(
        address.alias("read_id"),
        F.col("mate").alias("file_id"),
        rec_offset.alias("rec_offset"),
        (rec_offset + 16).alias("seq_offset"),
        address.alias("address"),
        F.concat(F.lit("@order/"), F.col("id").cast("string")).alias("name"),
        on_strand(F.col("seq"), F.col("rev")).alias("seq"),
        F.when(F.col("rev"), F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )


_written: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = materialize(build(), name)
    return _written[key]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads of both files; the derived table is written once per application."""
    return _once(spark, sf_dir, "reads", lambda: _derived_reads(spark, sf_dir))


def mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq1, seq2): both files at the same offset."""
    both = reads(spark, sf_dir)
    first = both.filter("file_id = 0").select("read_id", "seq_offset", F.col("seq").alias("seq1"))
    second = both.filter("file_id = 1").select("seq_offset", F.col("seq").alias("seq2"))
    return first.join(second, "seq_offset")


# Columns of a tile, and tiles that a task has in the mean.
TILE = 1 << 12
TILES_PER_TASK = 1 << 6


def genome_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of all reads by true genome position: (tile, col, file_id, pos, gap, base, qual, strand).

    ``tile`` numbers stretches of ``TILE`` columns. Whole reads are dealt by the tiles they touch before they are laid
    out in bases, so what groups by tile and column needs no other shuffle.
    """
    orders = _orders(spark, sf_dir)
    genome = _genome(orders).first()["g"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-genome // (TILE * TILES_PER_TASK)))
    i = F.col("i")
    mates = _mates(orders.repartition(_tasks(spark)), F.lit(genome)).filter("id is not null")
    # an indel shifts the later bases by one
    tiles = F.sequence(F.floor((F.col("start") - 1) / TILE), F.floor((F.col("start") + F.col("len")) / TILE))
    # two bytes a base travel with a read: a Python step behind the deal would hide it from what groups by tile
    drawn = mates.withColumn("calls", _calls_of("id", "mate", "start", "len", "hap", "indel"))
    dealt = drawn.withColumn("tile", F.explode(tiles)).repartition(tasks, "tile")
    # of an inner explode Spark would infer a filter that draws the letters once more
    laid = dealt.select("*", F.posexplode_outer("calls").alias("i", "call")).withColumn("g", _place(i))
    cells = laid.filter(F.floor(F.col("g") / TILE) == F.col("tile"))
    rev = F.col("rev") != (F.col("mate") == 1)
    pos = F.when(rev, F.col("len") - 1 - i).otherwise(i)
    return cells.select(
        "tile",
        F.col("g").alias("col"),
        F.col("mate").alias("file_id"),
        (F.col("id") * RECORD_BYTES + 16 + pos).alias("pos"),
        F.lit(0).alias("gap"),
        called_base(F.col("call")).alias("base"),
        called_quality(F.col("call").cast("int")).alias("qual"),
        F.when(rev, -1).otherwise(1).alias("strand"),
    )


# --- the same reads in SQL -------------------------------------------------

READS_SQL = """
orders_n as (
  select greatest(cast(floor(count(*) * 20 / 3.0) as bigint), 400) as g, (max(o_orderkey) + 1) * 256 as fb from orders),
placed as (
  select id, id % 2 = 1 as rev, cast('0x' || substr(d, 1, 12) as bigint) % g as st,
         substr(d, 13, 1) <= '7' as hap, substr(d, 14, 1) as indel,
         85 + cast('0x' || substr(d, 15, 1) as bigint) as len,
         100 + cast('0x' || substr(d, 16, 4) as bigint) % 100 as ins
  from (select o_orderkey as id, md5('s' || o_orderkey) as d from orders), orders_n),
mated as (
  select id, rev, hap, indel, len, mate, st + case when mate = 1 then ins else 0 end as start
  from placed, (values (0), (1)) m(mate)),
stepped as (select *, unnest(range(len)) as i from mated),
cells0 as (
  select id, rev, hap, mate, len, i,
         start + i + case when indel = '0' and i >= 50 then 1
                          when indel = '1' and i >= 50 then -1 else 0 end as g,
         md5(id || ':' || mate || ':' || i) as m
  from stepped),
cells1 as (
  select *, md5(cast(g as varchar)) as gm,
         translate(substr(md5(cast(g as varchar)), 1, 1), '0123456789abcdef', 'ACGTACGTACGTACGT') as tb
  from cells0),
cells2 as (
  select *, case when hap and substr(gm, 2, 2) = '00' then translate(tb, 'ACGT', 'GTAC') else tb end as own
  from cells1),
cells as (
  select id, rev, mate, len, i, g,
         case when substr(m, 10, 3) = '000' or substr(m, 13, 3) = '000' or substr(m, 3, 3) = '000' then 'N'
              when substr(m, 1, 2) < '03' then translate(own, 'ACGT', 'CGTA') else own end as b,
         cast(case when substr(m, 3, 3) = '000' then 2 when substr(m, 1, 2) < '03' then 5
              else cast('0x' || substr(m, 6, 2) as bigint) % 30 + 10 end as integer) as q
  from cells2),
packed as (
  select id, mate, rev <> (mate = 1) as rv,
         string_agg(b, '' order by i) as fs, string_agg(chr(q + 33), '' order by i) as fq
  from cells group by all),
reads as materialized (
  select mate * fb + id * 256 + 16 as read_id, mate as file_id, id * 256 as rec_offset,
         id * 256 + 16 as seq_offset, mate * fb + id * 256 + 16 as address, '@order/' || id as name,
         case when rv then reverse(translate(fs, 'ACGT', 'TGCA')) else fs end as seq,
         case when rv then reverse(fq) else fq end as qual
  from packed, orders_n)"""

COLUMNS_SQL = READS_SQL + """,
genome_columns as (
  select g as col, mate as file_id,
         id * 256 + 16 + case when rev <> (mate = 1) then len - 1 - i else i end as pos,
         0 as gap, b as base, q as qual, case when rev <> (mate = 1) then -1 else 1 end as strand
  from cells)"""
