"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into phrases of phrases, and so on. At each level runs of one name become a
name of their own, so neighbours differ; deterministic coin tossing then gives every place a small label (twice the
lowest bit in which its name differs from the name before, plus that bit, repeated until labels are below six, with
neighbours still different), and a phrase begins wherever a label is a local minimum. Where a phrase begins depends on a
few names around it and on nothing else: equal substrings are cut alike whatever stands before them, but for a few
names at their ends. A phrase's name is a hash of the names in it, the same in every document.

A document's signatures are the names of its phrases on the levels from ``FIRST`` on; its fingerprint keeps, for each of
``BINS`` classes of signatures, the least of its hashes (four hex digits; 0000 for an empty class). The likeness of two
fingerprints is the share of equal classes among those that are not empty in both, an estimate of the share of
signatures they have in common: 1 for equal texts, and for two empty ones.

The next document is the one with the next greater id (after the greatest: the least); of rows with one id the least
text stands for it. Documents are dealt by ranges of ids, so a document and its next meet in one task; the first document
of a range is sent to the range before as well. Rows without id have no next document: they are compared with the empty
text, and nothing replaces their end. Null texts count as empty. Repeated rows each get their row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import by_size, small_batches, text_or_empty

FIRST = 2
MOST_LEVELS = 24
BINS = 128
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0x5851F42D4C957F2D)
_S30, _S27, _S31, _ONE = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(1)
#: Coin tosses from 64-bit names to labels below six: 128, 14, 8, 6.
_TOSSES = 4
_BATCH = 1 << 19
#: A longer text is parsed in stretches, which bounds memory; a stretch's end changes a few phrases a level there.
_STRETCH = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of numbers that are not 0."""
    return np.bitwise_count((x & (~x + _ONE)) - _ONE)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _BASE, np.uint64))


def _collapse(names: np.ndarray, first: np.ndarray):
    """Runs of a name become one name. first: true where a document begins."""
    start = np.empty(len(names), bool)
    start[0] = True
    np.not_equal(names[1:], names[:-1], out=start[1:])
    start |= first
    at = np.flatnonzero(start)
    if len(at) == len(names):
        return names, first
    length = np.diff(at, append=len(names)).astype(np.uint64)
    kept = names[at]
    runs = length > 1
    kept[runs] = _mix(kept[runs] + length[runs] * _BASE)
    return kept, first[at]


def _phrases(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: document starts and local minima of the labels."""
    label = names
    for toss in range(_TOSSES):
        differ = label[1:] ^ label[:-1]
        tossed = np.empty(len(label), np.uint8)
        kind = label.dtype.type
        differ[differ == 0] = 1  # only across documents, or where two names collide
        low = _low_bit(differ) if kind is np.uint64 else np.bitwise_count((differ & (~differ + kind(1))) - kind(1))
        tossed[1:] = (low << 1) | ((label[1:] >> low.astype(label.dtype)) & kind(1)).astype(np.uint8)
        tossed[0] = 0
        tossed[first] = (label[first] & kind(1)).astype(np.uint8)
        label = tossed
    begin = np.zeros(len(names), bool)
    begin[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    near = np.flatnonzero(first)
    # neighbours across documents don't count: a document's second and last place are no minima by what lies outside
    begin[near[near > 0] - 1] = False
    begin[near] = True
    return begin


def parse(texts: list[str]):
    """For each level from 0 on: (names, document of each name) of all texts together."""
    sizes = np.array([len(t) for t in texts])
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    names = _mix(names + _ONE)
    for level in range(MOST_LEVELS):
        yield level, names, owner
        more = np.bincount(owner, minlength=len(texts))[owner] > 1  # a text of one name is done
        names, owner = names[more], owner[more]
        if not len(names):
            return
        first = np.empty(len(names), bool)
        first[0] = True
        np.not_equal(owner[1:], owner[:-1], out=first[1:])
        docs = owner[first]
        names, first = _collapse(names, first)
        begin = _phrases(names, first)
        at = np.flatnonzero(begin)
        length = np.diff(at, append=len(names))
        within = np.arange(len(names)) - np.repeat(at, length)
        power = _powers(int(length.max()))
        owner = docs[np.cumsum(first)[at] - 1]
        names = _mix(np.add.reduceat(names * power[within], at) + length.astype(np.uint64))


def sketches(texts: list[str]) -> np.ndarray:
    """One row of BINS 16-bit numbers a text, 0 for an empty class."""
    owner, cut = [], []
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _STRETCH):
            owner.append(i)
            cut.append(text[at : at + _STRETCH])
    out, done = np.full((len(texts), BINS), 0x10000, np.uint32), 0
    for run in by_size(cut, _BATCH):
        np.minimum.at(out, np.array(owner[done : done + len(run)]), _least(run))
        done += len(run)
    out[out == 0x10000] = 0
    return out.astype(np.uint16)


def _least(texts: list[str]) -> np.ndarray:
    """The least hash of each class, 0x10000 for none, of texts parsed together."""
    out = np.full((len(texts), BINS), 0x10000, np.uint32)
    for level, names, owner in parse(texts):
        # of a text of fewer levels, the name of the whole stands for it
        chosen = slice(None) if level >= FIRST else np.bincount(owner, minlength=len(texts))[owner] == 1
        h = _mix(names[chosen] + _SALT)
        value = ((h >> np.uint64(16)) % np.uint64(0xFFFF)).astype(np.uint32) + np.uint32(1)
        np.minimum.at(out, (owner[chosen], (h & np.uint64(BINS - 1)).astype(np.int64)), value)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal classes among those not empty in both, row by row."""
    used = (a != 0) | (b != 0)
    n = used.sum(1)
    return np.where(n == 0, 1.0, ((a == b) & used).sum(1) / np.maximum(n, 1))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16)


def edited(text: str, following: str) -> str:
    """The last quarter of the text (rounded down) replaced by as many of the first characters of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _result(ids, texts: list[str], others: list[str], own: np.ndarray, of_others: np.ndarray) -> pd.DataFrame:
    changed = [edited(t, o) for t, o in zip(texts, others, strict=True)]
    after = sketches(changed)
    return pd.DataFrame(
        {
            "doc_id": ids,
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [as_text(s) for s in own],
            "edited_fingerprint": [as_text(s) for s in after],
            "near_edited": likeness(own, after),
            "near_next": likeness(own, of_others),
        }
    )


def _with_next(batches):
    """Rows of one range of ids in descending order, those sent ahead first -> their results."""
    group_id = None  # of the rows met last; the least text of theirs, and of the greater id before
    least, before = ("", np.zeros(BINS, np.uint16)), ("", np.zeros(BINS, np.uint16))
    for b in batches:
        texts, own = list(b.text), None
        for start in range(0, len(texts), 512):
            part = texts[start : start + 512]
            own, keep, others, of_others = sketches(part), [], [], []
            for i, (doc_id, ahead) in enumerate(zip(b.doc_id[start : start + 512], b.ahead[start : start + 512], strict=True)):
                if (ahead, doc_id) != group_id:
                    group_id, before, least = (ahead, doc_id), least, (part[i], own[i])
                if not ahead:
                    keep.append(i)
                    others.append(before[0])
                    of_others.append(before[1])
            if keep:
                ids = b.doc_id.to_numpy()[start : start + 512][keep]
                yield _result(ids, [part[i] for i in keep], others, own[keep], np.array(of_others))


def _alone(batches):
    """Rows without id."""
    for b in batches:
        for start in range(0, len(b), 512):
            part = list(b.text[start : start + 512])
            own, none = sketches(part), np.zeros((len(part), BINS), np.uint16)
            yield _result([None] * len(part), part, [""] * len(part), own, none).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row (doc_id, text).

    Texts are shuffled once. The ranges hold about as many rows each; their first ids, one number a shuffle partition,
    are all that the driver sees.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id").filter("doc_id is not null").repartitionByRange(n, "doc_id")
    starts = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("start"))
    first = np.array(sorted(r.start for r in starts.collect()), np.int64)

    @F.pandas_udf("range int, ahead int")
    def range_of(ids: pd.Series) -> pd.DataFrame:
        ids = ids.to_numpy()
        at = np.searchsorted(first, ids, "right") - 1
        ahead = pd.Series((at - 1) % len(first), dtype="Int32").where(first[at] == ids)
        return pd.DataFrame({"range": at.astype(np.int32), "ahead": ahead})

    alone = docs.filter("doc_id is null").mapInPandas(_alone, _RESULT)
    if not len(first):
        return alone
    known = docs.filter("doc_id is not null").withColumn("at", range_of("doc_id"))
    places = F.array(
        F.struct(F.col("at.range").alias("range"), F.lit(False).alias("ahead")),
        F.when(F.col("at.ahead").isNotNull(), F.struct(F.col("at.ahead").alias("range"), F.lit(True).alias("ahead"))),
    )
    rows = known.select("doc_id", "text", F.explode(F.array_compact(places)).alias("to")).select("to.*", "doc_id", "text")
    ordered = rows.repartitionById(len(first), "range").sortWithinPartitions(F.desc("ahead"), F.desc("doc_id"), "text")
    return ordered.mapInPandas(_with_next, _RESULT).unionByName(alone)
