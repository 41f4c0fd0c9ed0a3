"""Alignment of two tokenizers over the same bytes, by interval coalescing.

Tokenizer A is a byte-level vocabulary of the tokenizers library and gets a space and the text; B is a sentencepiece
model and gets the text, before which it puts the space itself. Where the bytes of A's tokens, of B's tokens and of
the text are the same, each token is an interval of bytes. All intervals of A and B are sorted by start
(``lexsort``), their ends run through ``maximum.accumulate``, and a group begins where a start reaches the running
maximum: there tokens of A and of B both end. Tokens of a group overlap, directly or through others, and its links are
all pairs of an A and a B token in it.

Neither tokenizer joins a character to a space after it, so a text falls into words (a space and what follows it, up to
the next space after something else) that both encode one by one. A task remembers the words it has met, and the
intervals are those of its new words, end to end; a bounded number of words is kept. Tests hold this against the
libraries on whole texts.

Counts: the rows of a batch form a block. A block lists each id pair once with the number of its documents, these sums
are the counts of the corpus, and a block asks only for the pairs that it lists, so no (document, pair) rows are
shuffled. A pair is one number, A's id times 2**15 plus B's. Nothing is broadcast but the vocabularies and one row for
each id of A.

Nulls: a null or empty text, or one whose tokens don't give its bytes, has no tokens: its numbers are 0 and its groups
empty. Rows that repeat are documents of their own. Long texts are taken whole; a word is the unit of memory. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import by_size, materialize, small_batches, tokenizer_json

MOST_WORDS = 500_000
MOST_CHARS = 1 << 23
B_BITS = 15
_BATCH = 1 << 20
_GROUP = 500
_CUT = re.compile(r"(?<=\S)(?= +\S)")
_ODD = re.compile(r"\A |\s(?= |\Z)")
_SPACE = "▁"

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = (
    "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<int>, times array<int>, summary boolean"
)


def words_of(text: str) -> list[str]:
    """The words of a text that isn't empty, each without the space that comes before it."""
    if not _ODD.search(text):
        return text.split(" ")
    return [word[1:] for word in _CUT.split(" " + text)]


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others for 256 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, vocabulary: str, model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        if self.b.vocab_size() > 1 << B_BITS or self.a.get_vocab_size() > 1 << (31 - B_BITS):
            raise ValueError("ids of a pair don't fit 31 bits")
        letters = byte_letters()
        of_a = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(map(letters.__getitem__, t)) if set(t) <= set(letters) else t.encode() for t in of_a]
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def encode(self, words: list[str]):
        """Ids of A end to end, how many of each word with its space, the same of B, and which words fit.

        Both give the bytes of a word that fits; others have no ids. Words that neither begin nor end with white space
        are encoded in groups as one text, and the tokens are dealt to them by their bytes.
        """
        ids, sizes = ([], []), (np.zeros(len(words), np.int64), np.zeros(len(words), np.int64))
        plain = [k for k, w in enumerate(words) if w and not w[0].isspace() and not w[-1].isspace()]
        taken = set(plain)
        groups = [plain[i : i + _GROUP] for i in range(0, len(plain), _GROUP)]
        groups += [[k] for k in range(len(words)) if k not in taken]
        texts = [" ".join([words[k] for k in group]) for group in groups]
        at = 0
        for run in by_size(texts, _BATCH):
            a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in run], add_special_tokens=False)]
            b = self.b.encode(run, num_threads=1)
            for text, group, *both in zip(run, groups[at : at + len(run)], a, b, strict=True):
                self._deal(text, group, words, both, ids, sizes)
            at += len(run)
        order = np.argsort(np.concatenate([np.array(g, np.int64) for g in groups]), kind="stable") if groups else []
        flat = []
        for side in (0, 1):
            whole = np.concatenate(ids[side]) if ids[side] else np.empty(0, np.int64)
            given = np.array([k for g in groups for k in g], np.int64)
            ends = np.cumsum(sizes[side][given])
            begin = (ends - sizes[side][given])[order]
            flat.append(whole[np.repeat(begin, sizes[side]) + _runs(sizes[side])])
        fit = (sizes[0] > 0) & (sizes[1] > 0)
        return flat[0], sizes[0], flat[1], sizes[1], fit

    def _deal(self, text: str, group: list[int], words: list[str], both, ids, sizes) -> None:
        """Append the ids of a group of words that make up ``text`` and set their numbers."""
        want = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in both[0]]) == want == b"".join([self.bytes_b[i] for i in both[1]]):
            ascii_only = len(want) == len(text) + 1
            ends = np.cumsum([len(words[k]) + 1 if ascii_only else len(words[k].encode("utf-8", "surrogatepass")) + 1 for k in group])
            for side, size_of in ((0, self.size_a), (1, self.size_b)):
                of = np.array(both[side], np.int64)
                ids[side].append(of)
                sizes[side][group] = np.bincount(np.searchsorted(ends, np.cumsum(size_of[of])), minlength=len(group))
        elif len(group) > 1:  # some word doesn't fit: one by one
            for k in group:
                a = self.a.encode(" " + words[k], add_special_tokens=False).ids
                self._deal(words[k], [k], words, (a, self.b.encode(words[k])), ids, sizes)

    def fits(self, word: str, a: list[int], b: list[int]) -> bool:
        """Whether both give the bytes of the word."""
        want = (" " + word).encode("utf-8", "surrogatepass")
        return b"".join([self.bytes_a[i] for i in a]) == want == b"".join([self.bytes_b[i] for i in b])


def coalesced(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token, from the sizes of tokens that lie end to end over the same bytes."""
    ends = np.concatenate([np.cumsum(size_a), np.cumsum(size_b)])
    starts = ends - np.concatenate([size_a, size_b])
    of_b = np.arange(len(ends)) >= len(size_a)
    order = np.lexsort((of_b, starts))
    upto = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= upto[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(size_a)], group[len(size_a) :]


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(weight[order], first) if len(key) else weight


def links_of(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray):
    """(group, pair, times) of the links, each id pair of a group once."""
    one, times_a = _summed(group_a << 16 | ids_a, np.ones(len(ids_a), np.int64))
    two, times_b = _summed(group_b << 16 | ids_b, np.ones(len(ids_b), np.int64))
    n = int(max(group_a.max(), group_b.max())) + 1 if len(group_a) else 0
    here = np.bincount(two >> 16, minlength=n)  # distinct B ids of each group
    first = np.cumsum(here) - here
    repeats = here[one >> 16]
    left = np.repeat(np.arange(len(one)), repeats)
    right = np.repeat(first[one >> 16], repeats) + _runs(repeats)
    pair = (one[left] & 0xFFFF) << B_BITS | two[right] & 0xFFFF
    return one[left] >> 16, pair, times_a[left] * times_b[right]


class Words(dict):
    """What is known of each word: numbers, groups, links. Words have places from 0 on; the memory is emptied when full."""

    def __init__(self, pair: Pair):
        super().__init__()
        self.pair = pair
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.chars = 0
        self.groups: list[str] = []
        self.fit = np.empty(0, bool)
        self.numbers = np.empty((0, len(NUMBERS)), np.int64)
        self.first = np.zeros(1, np.int64)  # of a word's links, and their end
        self.links, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Add words that are not known."""
        if not words:
            return
        ids_a, n_a, ids_b, n_b, fit = self.pair.encode(words)
        group_a, group_b = coalesced(self.pair.size_a[ids_a], self.pair.size_b[ids_b])
        word_of = np.zeros(int(group_a[-1]) + 1 if len(group_a) else 0, np.int64)
        word_of[group_a] = np.repeat(np.arange(len(words)), n_a)
        n_groups = np.bincount(word_of, minlength=len(words))
        many = np.bincount(group_a, minlength=len(word_of)) * np.bincount(group_b, minlength=len(word_of))
        n_links = np.bincount(word_of, weights=many, minlength=len(words)).astype(np.int64)
        group, pair, times = links_of(group_a, ids_a, group_b, ids_b)
        key, times = _summed(word_of[group] << 31 | pair, times)
        self.groups += self._texts(len(words), ids_a, group_a, ids_b, group_b, word_of)
        self.fit = np.concatenate([self.fit, fit])
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, n_groups, n_links], 1)])
        upto = np.cumsum(np.bincount(key >> 31, minlength=len(words)))
        self.first = np.concatenate([self.first, self.first[-1] + upto])
        self.links = np.concatenate([self.links, key & 0x7FFFFFFF])
        self.times = np.concatenate([self.times, times])
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))
        self.chars += sum(map(len, words))

    @staticmethod
    def _texts(n: int, ids_a, group_a, ids_b, group_b, word_of) -> list[str]:
        """The groups of each word as text: ``a1,a2|b1;a3|b2``; words without tokens have an empty one."""
        out = [""] * n
        if not len(ids_a):
            return out
        side = np.concatenate([group_a * 2, group_b * 2 + 1])  # tokens in order of group, A before B
        order = np.argsort(side, kind="stable")
        names = list(map(str, np.concatenate([ids_a, ids_b])[order].tolist()))
        side = side[order]
        group = side >> 1
        word = word_of[group]
        after = np.full(len(side), 3)  # what comes after a token
        same = group[1:] == group[:-1]
        after[:-1] = np.where(same, (side[1:] != side[:-1]).astype(int), np.where(word[1:] == word[:-1], 2, 3))
        marks = np.array([",", "|", ";", "\n"], object)[after].tolist()
        texts = "".join(chain.from_iterable(zip(names, marks, strict=True))).split("\n")
        for k, text in zip(np.flatnonzero(np.bincount(word, minlength=n)).tolist(), texts[:-1], strict=True):
            out[k] = text
        return out

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _one_text(known: Words, places: np.ndarray, digest: bool):
    """(numbers, groups or their digest) of a text by its words."""
    if not len(places) or not known.fit[places].all():
        return np.zeros(len(NUMBERS), np.int64), ""
    whole = ";".join([known.groups[i] for i in places.tolist()])
    return known.numbers[places].sum(0), hashlib.sha256(whole.encode()).hexdigest() if digest else whole


def _pairs_of(known: Words, owner: np.ndarray, places: np.ndarray):
    """(owner, pair, times): links of texts, each id pair of a text once, from the places of their words."""
    word, often = _summed(owner << 32 | places, np.ones(len(places), np.int64))
    at = word & 0xFFFFFFFF
    many = known.first[at + 1] - known.first[at]
    link = np.repeat(known.first[at], many) + _runs(many)
    key, times = _summed(np.repeat(word >> 32, many) << 31 | known.links[link], known.times[link] * np.repeat(often, many))
    return key >> 31, key & 0x7FFFFFFF, times


def _block(known: Words, ids: list, texts: list[str], digest: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows of a block, and its summary."""
    words = [words_of(t) if t else [] for t in texts]
    wanted = {w for of in words for w in of}
    new = [w for w in wanted if w not in known]
    if len(known) + len(new) > MOST_WORDS or known.chars > MOST_CHARS:
        known.empty()
        new = list(wanted)
    known.learn(new)
    places = [known.places(of) for of in words]
    made = [_one_text(known, p, digest) for p in places]
    places = [p if m[0][0] else p[:0] for p, m in zip(places, made, strict=True)]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    owner, pair, times = _pairs_of(known, owner, np.concatenate(places))
    cuts = np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]
    listed, docs = _summed(pair, np.ones(len(pair), np.int64))
    out = pd.DataFrame([m[0] for m in made], columns=list(NUMBERS))
    out.insert(0, "doc_id", pd.Series(ids, dtype=object))
    out["groups"] = [m[1] for m in made]
    out["pairs"] = np.split(pair.astype(np.int32), cuts)
    out["times"] = np.split(times.astype(np.int32), cuts)
    out["summary"] = False
    last = out.iloc[:1].assign(doc_id=None, groups="", summary=True, **dict.fromkeys(NUMBERS, 0))
    return out, last.assign(pairs=[listed.astype(np.int32)], times=[docs.astype(np.int32)])


_held: dict[int, Words] = {}


def _known(vocabulary: str, model: bytes) -> Words:
    """The memory of a worker, kept from task to task."""
    key = hash((vocabulary, model))
    if key not in _held:
        _held[key] = Words(Pair(vocabulary, model))
    return _held[key]


def blocks(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with their numbers, groups (or SHA-256 of these) and id pairs, in blocks.

    Each block has one more row, its summary: its id pairs, each once, and how many of its documents hold them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path_b, "rb") as file:
        sent = spark.sparkContext.broadcast((tokenizer_json(path_a), file.read()))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, number = _known(*sent.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, start = batch.doc_id.tolist(), 0
            texts = [t or "" for t in batch.text]
            for run in by_size(texts, _BATCH):
                for made in _block(known, ids[start : start + len(run)], run, digest):
                    made.insert(0, "block", number)
                    yield made
                start, number = start + len(run), number + 1

    # ids as text: pandas has no nulls beside numbers of 64 bits
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(aligned, _SCHEMA)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold an id pair linked, and whether that is the most of its A id."""
    listed = made.filter("summary").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    counts = materialize(counts, "aligned-pairs")
    a = F.shiftright("pair", B_BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    # broadcast: one row for each id of A, which is at most its vocabulary
    met = counts.withColumn("a", a).join(F.broadcast(most), "a")
    return met.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _answered(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the documents of a block."""
    asked = asked.sort_values("pair")
    known, count, best = (asked[c].to_numpy() for c in ("pair", "count", "best"))
    sums, bests = [], []
    for pairs, times in zip(docs.pairs, docs.times, strict=True):
        at = np.searchsorted(known, pairs)
        t = np.asarray(times, np.int64)
        sums.append(int((t * count[at]).sum()) if len(t) else 0)
        bests.append(int(t[best[at]].sum()) if len(t) else 0)
    out = docs[["doc_id", *NUMBERS, "groups"]].copy()
    return out.assign(n_best=bests, count_sum=sums)


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum for each row of ``docs`` (doc_id, text).

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B of each group; with ``digest`` the lower-case hex SHA-256 of it.
    ``n_best``: links whose pair has the highest count of its A id; ``count_sum``: counts over the links.
    """
    made = materialize(blocks(docs, path_a, path_b, digest), "aligned-blocks")
    asked = made.filter("summary").select(F.col("block").alias("by"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(made), "pair")
    rows = made.filter("not summary").drop("summary")
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    answered = rows.groupBy("block").cogroup(answers.groupBy("by")).applyInPandas(_answered, schema)
    return answered.withColumn("doc_id", F.col("doc_id").cast("long"))
