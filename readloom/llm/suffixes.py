"""Repeated passages by suffix arrays: every byte that a string of ``LENGTH`` bytes covers which starts elsewhere too.

Windows are the strings of ``LENGTH`` bytes of a text. Each window has a key, the least hash of the strings of ``GRAM``
bytes in it; equal windows have equal keys, wherever they stand. Consecutive windows with one key form a piece (their
common text, ``LENGTH`` bytes and more). So only pieces whose key stands in another piece, or in two places of its own,
can repeat anything:

1. Keys are counted over all pieces; pieces with a key of their own are done. Of the others equal ones (by key and
   digest) are counted together: all their windows repeat, and one of them goes on for the comparison with different ones.
2. Pieces of a key that has several different ones are dealt to shards by key. A shard lays its pieces end to end and
   sorts their suffixes by Larsson-Sadakane refinement: groups of equal beginnings of h bytes are refined by the
   groups h bytes on, h doubles, and only groups that are still open are touched again. Kasai's pass gives the common
   prefixes of neighbours, in lockstep over all pieces; windows with a neighbour of ``LENGTH`` common bytes repeat.
3. A key with more than ``MOST_PIECES`` different pieces is dealt to several shards. Each gives the digests of its
   different windows in order; digests of all shards of a key are merged by binary search, in ranges of digests, and a
   window that stands once in its shard but in another one too repeats as well.

The pieces of a text are found in stretches, so memory does not grow with a text. Nothing is dropped: keys that many
texts share are counted with map-side sums, and their pieces are split among shards. Texts that take part in a join are
found by a broadcast of their ids where these are few (``MOST_IDS``); otherwise all texts go through the shuffle.

Nulls: a null text is empty; a null doc_id is an id. Rows that repeat are texts of their own, so all their windows
repeat. Texts shorter than ``LENGTH`` bytes keep everything. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialize, small_batches, text_or_empty

LENGTH = 400
GRAM = 200
SEED = 42
MOST_PIECES = 2000
MOST_IDS = 1_000_000
_STRETCH = 1 << 20
_RUN = 1024
_BLOCK = 1 << 20
_END = 0xFF  # no byte of UTF-8
_ODD = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 22) - 1)
_BYTES = np.array([1 << 8 * i for i in range(1, 8)], np.uint64)


class _Powers:
    """Powers of the base of the rolling hash and of its inverse, modulo 2**64, and a number for each byte."""

    def __init__(self, n: int):
        self.of_byte = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)
        self.up = self._powers(_ODD, n)
        self.down = self._powers(pow(_ODD, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_powers: list[_Powers] = []


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on."""
    if not _powers or len(_powers[0].up) < len(data):
        _powers[:] = [_Powers(max(len(data), 2 * _STRETCH))]
    p, n = _powers[0], len(data)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(p.of_byte[data] * p.up[:n], out=upto[1:])
    h = (upto[gram:] - upto[:-gram]) * p.down[: n + 1 - gram]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on, by running minima from both ends of blocks."""
    if len(x) < width:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - width + 1], forth[width - 1 : len(x)])


def pieces_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(key, places, first window, number of windows) of the pieces of texts that lie end to end, each of ``length`` or more.

    ``places`` is in how many places the strings with the key's hash were first in their windows. Hashes are compared
    by their higher bits and then by place, which is the same in equal windows.
    """
    hashes = _gram_hashes(data, gram)
    least = sliding_min(hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & _PLACE
    own = np.ones(len(least), bool)  # windows that stay in one text
    for e in ends[:-1]:
        own[e - length + 1 : e] = False
    at = np.flatnonzero(own)
    place = least[at].astype(np.int64)
    apart = np.ones(len(at), bool)
    apart[1:] = at[1:] != at[:-1] + 1
    moved = apart.copy()
    moved[1:] |= place[1:] != place[:-1]
    keys = hashes[place]
    fresh = apart.copy()
    fresh[1:] |= keys[1:] != keys[:-1]
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(at)))
    places = np.add.reduceat(moved.astype(np.int64), first)
    parts = -(-sizes // _RUN)  # long runs of one key (text that repeats itself) are cut
    step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at[first], parts) + step * _RUN
    windows = np.minimum(np.repeat(sizes, parts) - step * _RUN, _RUN)
    return np.repeat(keys[first], parts), np.repeat(places, parts), start, windows


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (text, place in it, bytes) of about a stretch; long texts are cut so that no window is lost or doubled."""
    run, held = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - LENGTH + 1, 0), _STRETCH):
            part = text[start : start + _STRETCH + LENGTH - 1]
            if run and held + len(part) > _STRETCH:
                yield run
                run, held = [], 0
            run.append((i, start, part))
            held += len(part)
    if run:
        yield run


def _found(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pieces of a batch of texts."""
    import xxhash

    texts = [t.encode("utf-8", "surrogatepass") for t in batch.text]
    for run in _segments(texts):
        whole = b"".join([part for _, _, part in run])
        ends = np.cumsum([len(part) for _, _, part in run])
        key, places, start, windows = pieces_of(np.frombuffer(whole, np.uint8), ends)
        owner = np.searchsorted(ends, start, side="right")
        row = np.array([i for i, _, _ in run])[owner]
        shift = np.array([s for _, s, _ in run]) - np.concatenate([[0], ends[:-1]])
        size = windows + LENGTH - 1
        of = memoryview(whole)
        digests = [xxhash.xxh3_64_intdigest(of[a:b], SEED) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]
        yield pd.DataFrame({
            "id": batch.id.to_numpy()[row], "t": batch.t.to_numpy()[row], "key": key.view(np.int64),
            "digest": np.array(digests, np.uint64).view(np.int64), "at": start + shift[owner], "size": size.astype(np.int32), "places": places,
        })


def pieces(docs: DataFrame) -> DataFrame:
    """id, t (a hash of the text), key, digest, at, size, places of the pieces of ``docs`` (id, t, text)."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _found(batch)

    long_enough = docs.filter(F.octet_length("text") >= LENGTH)
    return long_enough.mapInPandas(cut, "id long, t long, key long, digest long, at long, size int, places long")


def beginnings(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts like them; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` bytes (or more) from them on, equal ones in order of place.

    Larsson-Sadakane refinement: ``rank`` of a place is the first slot of its group.
    """
    n = len(data)
    first = beginnings(data)
    order = np.argsort(first, kind="stable")
    rank = np.zeros(n + depth, np.int64)  # past the end all are least
    slots, key, h = np.arange(n), first[order], 8
    sa = order.copy()
    while True:
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))
        rank[order] = slots[group] + 1
        last = np.append(head[1:], True)
        still = ~(head & last)
        if h >= depth or not still.any():
            return sa
        slots, places = slots[still], order[still]
        key = rank[places] << 32 | rank[places + h]
        by = np.argsort(key, kind="stable")
        order, key = places[by], key[by]
        sa[slots] = order
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each place, how many bytes (``most`` at most) its suffix shares with the one before it in ``sa``.

    Kasai's pass, a step for all parts ``starts[i]`` to ``ends[i]`` at once: what a suffix shares with its neighbour,
    less one, the next suffix shares with the next place of that neighbour. Since ``sa`` is in order to a certain depth
    only, that is carried on where the neighbour moves along, and counted anew elsewhere, eight bytes at a time.
    """
    n, words = len(data), np.concatenate([beginnings(data), np.zeros(most + 8, np.uint64)])
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out, shared, last = np.zeros(n, np.int32), np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
    lanes = np.arange(len(starts))
    for step in range(int((ends - starts).max()) if len(starts) else 0):
        lanes = lanes[starts[lanes] + step < ends[lanes]]
        i = starts[lanes] + step
        j = before[i]
        have = np.where(j == last[lanes] + 1, np.maximum(shared[lanes] - 1, 0), 0)
        last[lanes] = np.where(j < 0, -2, j)
        going = np.flatnonzero((j >= 0) & (have < most))
        while len(going):
            differ = words[i[going] + have[going]] ^ words[j[going] + have[going]]
            same = differ == 0
            have[going[same]] += 8
            rest = going[~same]
            have[rest] += 7 - np.searchsorted(_BYTES, differ[~same], side="right")  # leading equal bytes
            going = going[same]
            going = going[have[going] < most]
        shared[lanes] = have
        out[i] = np.minimum(have, most)
    return out


def repeats(parts: list[bytes], length: int = LENGTH):
    """(data, starts, ends, hit, first): ``hit`` places whose window stands elsewhere too, ``first`` of each different window."""
    data = np.frombuffer(b"".join([p + bytes([_END]) for p in parts]), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    sa = suffix_array(data, length)
    shared = common_prefixes(data, sa, starts, ends, length)
    window = np.zeros(len(data) + 1, np.int64)
    np.add.at(window, starts, 1)
    np.add.at(window, np.maximum(ends - length + 1, starts), -1)
    window = np.cumsum(window[:-1]) > 0
    like = shared[sa] >= length  # as the one before
    hit = np.zeros(len(data), bool)
    hit[sa[like]] = True
    hit[sa[np.flatnonzero(like) - 1]] = True
    first = np.zeros(len(data), bool)
    first[sa[~like]] = True
    return data, starts, ends, hit & window, first & window


_SPANS = "id long, t long, start long, stop long, key long, part int, shard long, digests binary, open binary"


def _shard(rows: list, out: list) -> None:
    """Spans of the pieces of whole groups, and the digests of their windows where a key has several shards."""
    import xxhash

    data, starts, ends, hit, first = repeats([r.bytes for r in rows])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + LENGTH
    owner = np.searchsorted(ends, begin, side="right")
    for a, b, k in zip(begin.tolist(), stop.tolist(), owner.tolist(), strict=True):
        r = rows[k]
        if r.n == 1:  # else all of its windows are known to repeat
            out.append((r.id, r.t, r.at + a - int(starts[k]), r.at + b - int(starts[k]), None, None, None, None, None))
    of = memoryview(data.tobytes())
    spread = [k for k, r in enumerate(rows) if r.shards > 1]
    groups: dict[tuple, list] = {}
    for k in spread:
        groups.setdefault((rows[k].key, rows[k].shard, rows[k].shards), []).append(k)
    for (key, shard, shards), members in groups.items():
        parts: dict[int, tuple[list, list]] = {}
        for k in members:
            for p in range(int(starts[k]), int(ends[k]) - LENGTH + 1):
                if first[p]:
                    d = xxhash.xxh3_128_digest(of[p : p + LENGTH], SEED)
                    listed, undecided = parts.setdefault(int.from_bytes(d[:8]) % (4 * shards), ([], []))
                    listed.append(d)
                    if not hit[p] and rows[k].n == 1:
                        place = np.array([rows[k].id, rows[k].t, rows[k].at + p - int(starts[k])], "<i8")
                        undecided.append(d + place.tobytes())
        for part, (listed, undecided) in parts.items():
            out.append((None, None, None, None, key, part, shard, b"".join(sorted(listed)), b"".join(undecided)))


def _sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups (key, shard), which come one after the other, together up to a block."""
    columns = [c.split()[0] for c in _SPANS.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        out: list[tuple] = []
        _shard(rows, out)
        made = pd.DataFrame(out, columns=columns, dtype=object)  # numbers of 64 bits beside nulls
        return made.astype({c: "Int64" for c in ("id", "t", "start", "stop", "key", "shard")} | {"part": "Int32"})

    held, size, now, seen = [], 0, None, set()
    for batch in batches:
        for r in batch.itertuples(index=False):
            if (r.key, r.shard) != now:
                if size > _BLOCK:
                    yield frame(held)
                    held, size = [], 0
                now, seen = (r.key, r.shard), set()
            if (r.id, r.t, r.at) not in seen:  # rows that repeat have the same pieces
                seen.add((r.id, r.t, r.at))
                held.append(r)
                size += len(r.bytes)
    if held:
        yield frame(held)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of one shard of a key that stand in another shard: each shard's digests are looked up in all together."""
    lists = [np.frombuffer(d, "S16") for d in rows.digests]
    every = np.sort(np.concatenate(lists))
    out = []
    for undecided in rows.open:
        at = np.frombuffer(undecided, np.dtype([("d", "S16"), ("id", "<i8"), ("t", "<i8"), ("at", "<i8")]))
        often = np.searchsorted(every, at["d"], "right") - np.searchsorted(every, at["d"], "left")
        at = at[often > 1]
        out += zip(at["id"].tolist(), at["t"].tolist(), at["at"].tolist(), strict=True)
    made = pd.DataFrame(out, columns=["id", "t", "start"], dtype="int64")
    return made.assign(stop=made.start + LENGTH)


def _few(keys: DataFrame) -> bool:
    return keys.count() <= MOST_IDS


def _wanted_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, t, at, size, ...) with ``bytes``."""
    rest = [c for c in wanted.columns if c not in ("id", "t")]
    lists = materialize(wanted.groupBy("id", "t").agg(F.collect_list(F.struct(*rest)).alias("w")), "wanted-pieces")
    if _few(lists):  # broadcast: MOST_IDS pairs of numbers at most
        docs = docs.join(F.broadcast(lists.select("id", "t")), ["id", "t"], "left_semi")
    each = docs.join(lists, ["id", "t"]).select("id", "t", F.col("text").cast("binary").alias("whole"), F.explode("w").alias("w"))
    return each.select("id", "t", "w.*", F.substring("whole", F.col("w.at").cast("int") + 1, F.col("w.size")).alias("bytes"))


def spans(docs: DataFrame) -> DataFrame:
    """(id, t, start, stop) of ``docs`` (id, t, text): bytes that windows cover which stand elsewhere too."""
    every = materialize(pieces(docs), "pieces")
    common = every.groupBy("key").agg(F.sum("places").alias("c")).filter("c > 1").select("key")
    shared = materialize(every.join(common, "key", "left_semi"), "shared-pieces")
    discard(every)
    place = F.struct("id", "t", "at", "size")
    alike = shared.groupBy("key", "digest").agg(F.count("*").alias("n"), F.max("places").alias("places"), F.min(place).alias("one"))
    kinds = materialize(alike, "piece-kinds")
    several = kinds.filter("n > 1").select("key", "digest")
    solved = shared.join(several, ["key", "digest"], "left_semi").select(
        "id", "t", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop")
    )
    counted = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.max("places").alias("places"))
    mixed = counted.filter("kinds > 1 or (most = 1 and places > 1)").select("key", "kinds")
    shards = F.ceil(F.col("kinds") / MOST_PIECES)
    dealt = kinds.join(mixed, "key").select(
        "one.*", "key", "n", shards.alias("shards"), F.pmod(F.xxhash64("digest"), shards).alias("shard")
    )
    ready = _wanted_bytes(docs, dealt)
    ordered = ready.repartition("key", "shard").sortWithinPartitions("key", "shard")
    made = materialize(ordered.mapInPandas(_sharded, _SPANS), "shard-spans")
    across = made.filter("key is not null").select("key", "part", "digests", "open")
    merged = across.groupBy("key", "part").applyInPandas(_merged, "id long, t long, start long, stop long")
    found = made.filter("key is null").select("id", "t", "start", "stop")
    return solved.unionByName(found).unionByName(merged)


def _united(found) -> list[dict]:
    """Maximal runs of spans that overlap or touch."""
    out: list[dict] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in found):
        if out and start <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], stop)
        else:
            out.append({"start": start, "stop": stop})
    return out


def removed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with their text as bytes (``whole``) and ``runs``, the maximal runs to remove."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # a null id counts as the least number: rows of one number and one text have the same runs
    docs = texts.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("t"), "text")
    found = spans(docs.drop("doc_id")).groupBy("id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("found"))

    @F.pandas_udf("array<struct<start:long,stop:long>>")
    def united(of: pd.Series) -> pd.Series:
        return of.map(_united)

    runs = materialize(found.select("id", "t", united("found").alias("runs")), "removed-runs")
    columns = ["doc_id", F.col("text").cast("binary").alias("whole"), "runs"]
    if not _few(runs):
        return docs.join(runs, ["id", "t"], "left").select(columns)
    known = F.broadcast(runs.select("id", "t"))  # MOST_IDS pairs of numbers at most
    touched = docs.join(known, ["id", "t"], "left_semi").join(runs, ["id", "t"])
    whole = docs.join(known, ["id", "t"], "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    return touched.select(columns).unionByName(whole.select(columns))


def kept_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs`` (doc_id, text)."""

    @F.pandas_udf("string")
    def rest(whole: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, cut in zip(whole, runs, strict=True):
            digest, at = hashlib.sha256(), 0
            for run in () if cut is None else cut:
                digest.update(text[at : run["start"]])
                at = run["stop"]
            digest.update(text[at:])
            out.append(digest.hexdigest())
        return pd.Series(out, dtype=object)

    lengths = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return removed(docs).select(
        "doc_id", F.octet_length("whole").cast("long").alias("n_bytes"), F.coalesce(lengths, F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"), rest("whole", "runs").alias("kept_sha256"),
    )
