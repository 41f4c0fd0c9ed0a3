"""Token counts through a digest cache: a text is encoded once for each version of a tokenizer.

The key of a count is (SHA-256 of the normalised content, SHA-256 of the vocabulary file). Texts whose key is in
the cache never meet the tokenizer. Of the others one text for each digest is encoded, whatever the number of
copies: copies fall together within each scan task before the shuffle. New counts are appended to the cache as
Parquet, a folder for each tokenizer version; a lost task is run again and nothing half-written is ever read,
since Spark's committer moves files in when the job ends. Two runs that append the same digest agree, and the
reader takes either.

Normalisation is what the tokenizer itself doesn't see; for byte-level vocabularies that is nothing, so content
stays as it is but for null, which counts as empty.

A long text is encoded in pieces cut before white space that follows something else. A byte-level pattern never
joins a character to white space after it, so the counts add up exactly, and memory is bounded by the piece and
not by the text; a text without such a place is encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import by_size, small_batches, text_or_empty, tokenizer, tokenizer_json

PIECE = 1 << 16
_BATCH = 1 << 20
_CUT = re.compile(r"(?<=\S)(?=\s)")
CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType())])


def content(name: str = "text") -> Column:
    """Normalised content: null counts as empty."""
    return text_or_empty(name)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of ``size`` characters or more, each but the first beginning with white space."""
    out, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def version_of(vocabulary: str) -> str:
    """Digest of a vocabulary file's text."""
    return hashlib.sha256(vocabulary.encode()).hexdigest()


def _counter(spark: SparkSession, vocabulary: str):
    small_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = tokenizer(sent.value)
        cut, owner = [], []
        for i, text in enumerate(texts):
            for piece in pieces(text):
                cut.append(piece)
                owner.append(i)
        out, at = [0] * len(texts), 0
        for run in by_size(cut, _BATCH):
            for encoded in encoder.encode_batch_fast(run, add_special_tokens=False):
                out[owner[at]] += len(encoded)
                at += 1
        return pd.Series(out, dtype="int64")

    return count


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a tokenizer version; empty where nothing has been written yet."""
    at = f"{cache}/{version}"
    if not _exists(spark, f"{at}/_SUCCESS"):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, vocabulary: str, cache: str) -> None:
    """Encode the distinct texts of ``docs`` (text) that the cache lacks and append their counts."""
    spark, version = docs.sparkSession, version_of(vocabulary)
    texts = docs.select(content().alias("content")).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    known = cached(spark, cache, version)
    if _exists(spark, f"{cache}/{version}/_SUCCESS"):
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("content").alias("content"))
    counted = misses.select("digest", _counter(spark, vocabulary)("content").alias("n_tokens"))
    counted.write.mode("append").parquet(f"{cache}/{version}")


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text).

    ``path``: vocabulary file of the tokenizers library; ``cache``: a folder all executors share, kept from run to
    run. Rows that repeat each get their row, a null text counts as empty, an empty table gives an empty result.
    """
    spark, vocabulary = docs.sparkSession, tokenizer_json(path)
    docs = docs.select("doc_id", "text")
    fill_cache(docs, vocabulary, cache)
    keyed = docs.select(
        "doc_id",
        F.octet_length(content()).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(content().cast("binary"), 256)).alias("key"),
    )
    # keys of half the length; and both sides come to the join by its own shuffles, so a hot digest can be split there
    counts = cached(spark, cache, version_of(vocabulary)).select(F.unhex("digest").alias("key"), "n_tokens")
    return keyed.join(counts, "key").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
