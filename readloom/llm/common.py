"""What the operators of this subpackage share: tables, bounded batches, the written steps of a job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.session import discard, materialize, shared_folder, small_batches

__all__ = ["by_size", "discard", "materialize", "shared_folder", "small_batches", "table", "text_or_empty", "tokenizer_json"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def by_size(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Runs of consecutive texts of at most ``most`` characters together; a longer text goes alone."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > most:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def tokenizer_json(path: str) -> str:
    """The vocabulary file; it travels to the executors as text, since they may have no copy at ``path``."""
    with open(path, encoding="utf-8") as file:
        return file.read()


_loaded: dict[int, object] = {}


def tokenizer(text: str):
    """The tokenizer of a vocabulary, loaded once in a worker; nothing is cut or padded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(text)
    if key not in _loaded:
        made = Tokenizer.from_str(text)
        made.no_truncation()
        made.no_padding()
        _loaded[key] = made
    return _loaded[key]
