"""A training corpus from raw documents: quality, language, near copies, mix, tokens.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``docs``. Where rows must be
told apart, they are written once with a number (``_numbered``): a number made in a scan depends on how Spark packs
the files into partitions, which changes with the executors at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe_tree, langid, minhash, mixing, quality, simhash
from readloom.llm.common import materialize, table
from readloom.llm.queries import vocabulary
from readloom.session import ship_code

#: A language is believed from this share on.
LANGUAGE_SCORE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as of quality 1; it learns from the labels outside its held-out fold."""
    model = quality.fit(docs, quality.unheld(table(spark, sf_dir, "labels")))
    score = quality.scorer(spark, model)("text")
    return docs.withColumn("__score", score).filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und``, and believed."""
    held = F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.filter(~held))
    said = docs.withColumn("__said", langid.predictor(spark, model)("text"))
    kept = (F.col("__said.lang_pred") != langid.UNKNOWN) & (F.col("__said.score") >= LANGUAGE_SCORE)
    return said.filter(kept).drop("__said")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number of each row, ``__row``."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id, of repeated ids the first row.

    The fingerprints of op5 group the documents first. Their sets are an exact check: near copies share four fifths of
    their five-word shingles or are connected by such, and those that no two bits of a fingerprint show are found too.
    """
    numbered = _numbered(docs)
    texts = numbered.select(F.struct("doc_id", "__row").alias("doc_id"), "text")
    alike = simhash.near_copies(texts).select("doc_id", "component_id")
    groups = minhash.near_copies(texts, alike)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.__row")
    return numbered.join(kept, "__row", "left_semi").drop("__row")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    numbered = _numbered(docs)
    mixed = mixing.mix(numbered, row="__row").filter("copies > 0")
    copies = mixed.select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))
    repeated = numbered.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their number, and digests of ids and decoded text."""
    return bpe_tree.encode_documents(spark, docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("near-dedup", without_near_copies),
    ("mix", mixed_sources),
    ("BPE", encoded),
]

#: The classifiers can't be expressed in SQL; the tests check each stage against its operator and by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    ship_code(spark, "catalog")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
