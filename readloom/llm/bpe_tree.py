"""Encoding of long texts as a tree: halves in parallel, then windows around each join until both sides agree.

A text of at most ``leaf`` characters is encoded by the library at once. A longer one is cut in two, and its halves
again, down to leaves that are dealt over all tasks and encoded there. Two neighbours then meet: a window around
their join is encoded, and where its tokens and a neighbour's are the same, place and id, for two tokens running
and away from the window's own ends, the neighbour's tokens stand from there on. The window doubles until both
sides agree, in the worst case to both texts together, so the result is exact without a word boundary in reach.

Why agreement is enough: the pattern that splits words looks ahead by less than ``MARGIN`` characters and never
back, so from a common word end on both scans are one; and inside a word a merge sequence is right if all pairs of
neighbouring tokens are, and these are pairs of one of the encodings.

Short texts are split at ASCII white space, which the vocabulary's normaliser and word pattern drop and never look
across, and a part is encoded and decoded once for as long as a task remembers it. Decoded tokens are joined by
spaces, so the parts' decodings are as well.

Cuts fall before an ASCII character where there is one nearby, so composing normalisation doesn't cross them.

Nulls: a null text counts as empty; it gives no tokens. Repeated rows each get their row.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import by_size, materialize, small_batches, text_or_empty, tokenizer, tokenizer_json

LEAF = 1 << 15
#: Longer than any look-ahead of the word pattern and any special token.
MARGIN = 32
WINDOW = 64
_BATCH = 1 << 20
_NEAR = 4096
#: Leaves sent back at once; with their tokens' places they have some ten bytes a character.
_LEAVES_TOGETHER = 8
_ASCII = re.compile(r"[\x00-\x7f]")
_PIECES = "key long, n_leaves int, leaf int, piece string"
_ENCODED = _PIECES + ", ids binary, spans binary"
_RESULT = "key long, n_tokens long, ids binary, decoded string"


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Start of each leaf: repeated halving until none is longer than ``leaf`` (but for shifts to ASCII)."""
    starts, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        mid = (a + b) // 2
        found = _ASCII.search(text, mid, min(b, mid + min(_NEAR, leaf // 4)))
        if found and found.start() > a:
            mid = found.start()
        todo += [(mid, b), (a, mid)]
    return starts


def encode(encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and (start, end) of each token in the text."""
    made = encoder.encode(text, add_special_tokens=False)
    return np.array(made.ids, np.uint32), np.array(made.offsets, np.int64).reshape(-1, 2)


def _agreement(a, b, least: int, most: int, last: bool) -> tuple[int, int] | None:
    """Places in a and b of two tokens running that are the same and lie between least and most."""
    (ids_a, spans_a), (ids_b, spans_b) = a, b
    at = {(s, e): i for i, (s, e) in enumerate(spans_b.tolist()) if s >= least and e <= most}
    found = None
    low = int(np.searchsorted(spans_a[:, 0], least))
    for i in range(low, len(ids_a) - 1):
        s, e = spans_a[i].tolist()
        if e > most:
            break
        j = at.get((s, e))
        if j is None or j + 1 >= len(ids_b) or spans_b[j + 1, 1] > most:
            continue
        if (ids_a[i : i + 2] == ids_b[j : j + 2]).all() and (spans_a[i + 1] == spans_b[j + 1]).all():
            found = i, j
            if not last:
                break
    return found


def join(encoder, left, right):
    """(text, ids, spans) of two neighbours -> of both together."""
    text, c = left[0] + right[0], len(left[0])
    spans_r = right[2] + c
    n, w = len(text), WINDOW
    while True:
        a, b = max(0, c - w), min(n, c + w)
        ids, spans = encode(encoder, text[a:b])
        spans = spans + a
        if a == 0:
            head = 0, 0
        else:
            head = _agreement((left[1], left[2]), (ids, spans), a + 1, c - MARGIN, False)
        if b == n:
            tail = len(right[1]), len(ids)
        else:
            tail = _agreement((right[1], spans_r), (ids, spans), c + 1, b - MARGIN, True)
        if head and tail and head[1] <= tail[1]:
            (i, j), (k, m) = head, tail
            return (
                text,
                np.concatenate([left[1][:i], ids[j:m], right[1][k:]]),
                np.concatenate([left[2][:i], spans[j:m], spans_r[k:]]),
            )
        w *= 2


def join_all(encoder, parts: list):
    """Neighbours two by two, and their results again, up to the root."""
    while len(parts) > 1:
        parts = [
            join(encoder, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
        ]
    return parts[0]


_MOST_PARTS = 300_000


class Parts:
    """Ids and decoded text of the parts met; what a task remembers between batches.

    Two generations: when the young one is full it becomes the old one, and what is still in use moves back.
    """

    def __init__(self):
        self.young: dict[bytes, tuple[bytes, str]] = {}
        self.old: dict[bytes, tuple[bytes, str]] = {}

    def missing(self, wanted: set[bytes]) -> list[bytes]:
        """Those never met or forgotten; all others are in the young generation afterwards."""
        if len(self.young) > _MOST_PARTS // 2:
            self.young, self.old = {}, self.young
        wanted = wanted.difference(self.young)
        kept = wanted.intersection(self.old)
        self.young.update((p, self.old[p]) for p in kept)
        return list(wanted.difference(kept))


_BEFORE_MARK = re.compile(rb"(?<=[A-Za-z])(?=[,.;:!?])")
_TOGETHER = 2000


def parts_of(text: str) -> list[bytes]:
    """The text cut at ASCII white space and between a letter and a mark; ASCII parts lowered where no special token is near.

    All of these are word ends to the vocabulary, which lowers letters itself, but only after composing them: a capital
    may have no composed form where its small letter has one, so a part with other than ASCII letters stays as it is.
    """
    packed = text.encode("utf-8", "surrogatepass")
    if b"<|" in packed:
        return _BEFORE_MARK.sub(b" ", packed).split()
    if packed.isascii():
        return _BEFORE_MARK.sub(b" ", packed.lower()).split()
    return [p.lower() if p.isascii() else p for p in _BEFORE_MARK.sub(b" ", packed).split()]


def _encode_each(encoder, words: list[str]) -> list[np.ndarray]:
    """Ids of words without white space, encoded some thousands at a time with spaces between."""
    out = []
    runs = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
    for run, made in zip(runs, encoder.encode_batch([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
        ends = np.cumsum([len(w) + 1 for w in run])
        ids, (starts, _) = np.array(made.ids, "<u4"), np.array(made.offsets, np.int64).reshape(-1, 2).T
        out += np.split(ids, np.searchsorted(starts, ends[:-1]))
    return out


def encode_by_parts(encoder, texts: list[str], parts: Parts) -> list[tuple[int, bytes, str]]:
    """(number of tokens, ids, decoded text) of each text, put together from its parts."""
    split = [parts_of(text) for text in texts]
    new = parts.missing(set().union(*split))
    ids = _encode_each(encoder, [p.decode("utf-8", "surrogatepass") for p in new])
    decoded = encoder.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)
    parts.young.update((p, (i.tobytes(), d)) for p, i, d in zip(new, ids, decoded, strict=True))
    rows, known = [], parts.young
    for own in split:
        found = [known[p] for p in own]
        packed = b"".join([i for i, _ in found])
        rows.append((len(packed) // 4, packed, " ".join([d for i, d in found if i])))
    return rows


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """key, n_tokens, ids (little-endian uint32), decoded, and all columns of ``docs`` but its texts.

    ``docs`` has a column text. Short texts are encoded where they are scanned. Long ones are cut into leaves that
    a shuffle deals out, one row a leaf; a text's leaves meet again in one task, which holds no more than that text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(tokenizer_json(path))
    rest = [c for c in docs.columns if c != "text"]
    keyed = docs.withColumn("__text", text_or_empty()).drop("text")
    held: dict[str, Parts] = {}  # a task gets its own copy with the function, and its memory ends with it

    @F.pandas_udf("n_tokens long, ids binary, decoded string")
    def whole(texts: pd.Series) -> pd.DataFrame:
        encoder, rows = tokenizer(sent.value), []
        parts = held.setdefault("parts", Parts())
        for run in by_size(texts, _BATCH):
            rows += encode_by_parts(encoder, run, parts)
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])

    def cut(batches):
        for b in batches:
            for key, text in zip(b.key, b.text, strict=True):
                starts = cuts(text, leaf)
                ends = [*starts[1:], len(text)]
                yield pd.DataFrame(
                    [(key, len(starts), i, text[s:e]) for i, (s, e) in enumerate(zip(starts, ends, strict=True))],
                    columns=["key", "n_leaves", "leaf", "piece"],
                )

    def encode_leaves(batches):
        encoder = tokenizer(sent.value)
        for b in batches:
            for start in range(0, len(b), _LEAVES_TOGETHER):
                part = b.iloc[start : start + _LEAVES_TOGETHER]
                made = [encode(encoder, p) for p in part.piece]
                yield part.assign(
                    ids=[i.tobytes() for i, _ in made], spans=[s.astype(np.int32).tobytes() for _, s in made]
                )

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        encoder, group = tokenizer(sent.value), group.sort_values("leaf")
        parts = [
            (p, np.frombuffer(i, np.uint32), np.frombuffer(s, np.int32).astype(np.int64).reshape(-1, 2))
            for p, i, s in zip(group.piece, group.ids, group.spans, strict=True)
        ]
        ids = join_all(encoder, parts)[1]
        decoded = encoder.decode(ids.tolist(), skip_special_tokens=False)
        row = (int(group.key.iloc[0]), len(ids), ids.astype("<u4").tobytes(), decoded)
        return pd.DataFrame([row], columns=["key", "n_tokens", "ids", "decoded"])

    is_long = F.length("__text") > leaf
    short = keyed.filter(~is_long).withColumn("__made", whole("__text"))
    short = short.select(*rest, "__made.n_tokens", "__made.ids", "__made.decoded")
    # written with their keys, which another scan could number otherwise
    longs = materialize(keyed.filter(is_long).withColumn("__key", F.monotonically_increasing_id()), "long-texts")
    pieces = longs.select(F.col("__key").alias("key"), F.col("__text").alias("text")).mapInPandas(cut, _PIECES)
    # a set number of parts: adaptive execution would size them by bytes and not by work
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = pieces.repartition(n_parts, "key", "leaf").mapInPandas(encode_leaves, _ENCODED)
    grown = encoded.groupBy("key").applyInPandas(grow, _RESULT).withColumnRenamed("key", "__key")
    joined = longs.drop("__text").join(grown, "__key").select(*rest, "n_tokens", "ids", "decoded")
    return short.unionByName(joined)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text)."""
    return digests(encode_decode(docs.select("doc_id", "text"), path, leaf))
