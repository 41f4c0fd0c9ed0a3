"""Near copies by the true similarity of their word shingles; MinHash bands propose the pairs, sets verify them.

Two texts are near copies if the sets of their shingles (``SHINGLE`` words running) have a Jaccard similarity of
``SIMILAR`` or more. ``BANDS`` keys of a text are each hashed from ``ROWS`` minima of its shingles under random hashes;
two texts of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: all but 5 in a million at 0.8, fewer
above. Whatever shares a key is a candidate, and the sets of both are compared before a link is made.

Texts of one set fall together first (by a digest of 128 bits). Groups of candidates are then worked off without their
pairs. In a first round each text meets one other that shares a key, and what is linked becomes one component; keys whose
texts are all in one component are done. Of the other keys, small ones (``SMALL`` texts) let all texts of different
components meet. A crowded one has a pivot, the text that most of its texts know as the one with most open keys, and all
its texts meet it. Two texts of which one is no near copy of a pivot are only similar if they differ from it in common
shingles, and of the shingles in which a text differs, in one order, a prefix is enough to find a common one
(``differing``). Each shingle of the prefix is a key of the next round for the texts of that pivot. Where such keys are
crowded again (four times ``SMALL``), their pivot serves in the same way if it is nearer to them than the one before;
otherwise their texts are told apart by a second common shingle, a third, and so on, as long as they must have so many.
Nothing is lost: what shares a crowded key and is similar meets in some round, or is in one component before. A text
makes a quarter of its shingles as keys for each of its pivots at most, and texts that share a long passage and are
yet dissimilar differ from their pivot in shingles of their own. What is crowded after ``ROUNDS`` rounds meets as it is.

Nulls: a null text counts as empty; empty texts have no shingle and are copies of each other. Repeated rows each get
their row, where their ids differ. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialize, small_batches, text_or_empty
from readloom.llm.components import components

SEED = 42
SHINGLE = 5
#: As a fraction, so that the comparison is one of whole numbers.
SIMILAR = (4, 5)
BANDS = 40
ROWS = 6
SMALL = 16
ROUNDS = 10
_STRETCH = 1 << 9


def shingles_of(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words are split at ASCII white space, A-Z lowered."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], np.uint64))


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd, add = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return odd | np.uint64(1), add


def bands_of(shingles: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The keys of a set, none if it is empty."""
    import xxhash

    if not len(shingles):
        return []
    odd, add = hashes
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _STRETCH):
        np.minimum(least, (shingles[i : i + _STRETCH] * odd + add).min(axis=1), out=least)
    packed = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(packed)]


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets (sorted, eight bytes a shingle) are near copies."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0]


def differing(text: np.ndarray, pivot: np.ndarray) -> tuple:
    """near, d, common, plain, most, prefix: how a set differs from a pivot, by d shingles that only one of them has.

    Let e be the number of another text's differences, n and m the sizes of text and pivot. If the other text is similar
    to this one, their differences have at least (d + e - (n + other n) / 9) / 2 shingles in common. That is more than
    (d + (m - n) / 9) / 2 if the other is not near the pivot: at least ``common``, so that one of them is among the
    first ``plain`` of both. Since e is no less than what is common, it is also d - (n + other n) / 9 at least, and a
    similar text has 5 / 4 of the shingles at most: the first ``most``, n / 4 and one more, are enough against any text.
    Texts near the pivot are in its component and only need what is plain. The prefix has ``ROUNDS`` shingles more.
    """
    num, den = SIMILAR
    added = np.setdiff1d(text, pivot, assume_unique=True)
    removed = np.setdiff1d(pivot, text, assume_unique=True)
    n, m, d = len(text), len(pivot), len(added) + len(removed)
    near = (n - len(added)) * den >= (n + len(removed)) * num
    common = (d * (den + num) + (m - n) * (den - num)) // (2 * (den + num)) + 1
    most = min(d, n * (den - num) // num + 1)
    plain = min(max(d - common + 1, 0), most)
    most = plain if near else most
    return near, d, common, plain, most, np.concatenate([added, removed])[: most + ROUNDS if most else 0]


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, high and low (a digest of the set), n shingles, keys."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("high long, low long, n long, keys array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        hashes, rows = _hashes(), []
        for text in texts:
            s = shingles_of(text)
            high, low = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), SEED), ">i8").tolist()
            rows.append((high, low, len(s), bands_of(s, hashes)))
        return pd.DataFrame(rows, columns=["high", "low", "n", "keys"])

    return docs.select("doc_id", sketch(text_or_empty()).alias("__s")).select("doc_id", "__s.*")


def _sets(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t).astype("<u8").tobytes() for t in texts])

    return docs.select("node", packed(text_or_empty()).alias("shingles"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> a, b, near."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", near("of_a", "of_b").alias("near"))


def _ordered(a, b) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with label and size (plain ones) of their key; keys whose members are all in one component are left out."""
    members = members.drop("label", "size")
    known = members.join(found, "node", "left").select(*members.columns, F.coalesce("least", "node").alias("label"))
    plain = F.count_if(~F.col("extra")).alias("size")
    sums = known.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), plain)
    return known.join(sums.filter("l < m and size > 0").select("key", "size"), "key")


def _sized(n, m):
    """Sets of such sizes can be similar enough."""
    return F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each member with one other of another component, the least by a hash of all that its keys offer."""
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("l"))
    offered = members.groupBy("key").agg(F.min(order).alias("best"))
    each = members.join(offered, "key").select("node", "n", "label", "best")
    sized = _sized(F.col("n"), F.col("best.m")) & (F.col("label") != F.col("best.l"))
    met = each.filter(sized).groupBy("node").agg(F.min("best").alias("best"))
    return met.select(*_ordered(F.col("node"), F.col("best.other"))).distinct()


def _crowded():
    """Keys of more than so many texts; a further difference makes more rows of a text than ``4 * SMALL`` pairs cost."""
    return F.col("size") > F.when(F.col("level").isNull(), SMALL).otherwise(4 * SMALL)


def _all_met(members: DataFrame, last: bool) -> DataFrame:
    """(a, b): plain members of keys that are not crowded (or ``last``), with all members of other components of the key.

    In crowded keys only those meet all others that need not agree in a further shingle.
    """
    small = F.lit(True) if last else ~_crowded()
    stays = F.coalesce(F.col("common") <= F.col("level"), F.lit(False))
    flagged = members.withColumn("meets", ~F.col("extra") & (small | stays)).select("key", "node", "n", "label", "meets")
    offers = flagged.filter("meets").select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("l"))
    met = flagged.join(offers, "key").filter((F.col("label") != F.col("l")) & (~F.col("meets") | (F.col("node") < F.col("other"))))
    return met.filter(_sized(F.col("n"), F.col("m"))).select(*_ordered(F.col("node"), F.col("other"))).distinct()


def _pivots(crowded: DataFrame) -> DataFrame:
    """key, by: the pivot of each key, which most of its members have as the one with most keys of all theirs offer."""
    central = crowded.groupBy("node").agg(F.count("*").alias("keys"))
    order = F.struct("keys", F.xxhash64("node").alias("h"), F.col("node").alias("by"))
    offered = crowded.join(central, "node").groupBy("key").agg(F.max(order).alias("best"))
    chosen = crowded.join(offered, "key").groupBy("node").agg(F.max("best").alias("best"))
    votes = crowded.join(chosen, "node").groupBy("key", "best").agg(F.count("*").alias("votes"))
    return votes.groupBy("key").agg(F.max(F.struct("votes", "best")).getField("best").getField("by").alias("by"))


def _measured(met: DataFrame, sets: DataFrame) -> DataFrame:
    """pivot, node, n and how the node differs from the pivot (``differing``)."""

    @F.pandas_udf("near boolean, d int, common int, plain int, most int, shingles array<long>")
    def against(text: pd.Series, pivot: pd.Series) -> pd.DataFrame:
        rows = []
        for x, p in zip(text, pivot, strict=True):
            *numbers, prefix = differing(np.frombuffer(x, "<u8"), np.frombuffer(p, "<u8"))
            rows.append((*numbers, prefix.view(np.int64)))
        return pd.DataFrame(rows, columns=["near", "d", "common", "plain", "most", "shingles"])

    of_pivot = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of_pivot"))
    both = met.join(sets, "node").join(of_pivot, "pivot")
    return both.select("pivot", "node", "n", against("shingles", "of_pivot").alias("__m")).select("pivot", "node", "n", "__m.*")


def _differences(rows: DataFrame) -> DataFrame:
    """Members of the next keys, for rows that agree in the shingles of ``key`` and have ``shingles`` after place ``at``."""
    level = (F.col("level") + 1).alias("level")
    last = F.col("most") + F.col("level") - 1
    places = F.when(F.col("at") < last, F.sequence(F.col("at") + 1, last)).otherwise(F.array().cast("array<int>"))
    each = rows.withColumn("at", F.explode(places)).withColumn("shingle", F.get("shingles", F.col("at"))).filter("shingle is not null")
    key = F.xxhash64("key", "shingle").alias("key")
    extra = (F.col("at") >= F.col("plain") + F.col("level")).alias("extra")
    return _with_company(each.select(key, "node", "n", extra, "pivot", "d", "common", "at", level))


def _narrower(crowded: DataFrame, pivots: DataFrame, measured: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """Members under narrower keys: of a key whose pivot is nearer than the one before, by their difference from it.

    Otherwise by one more shingle in which they differ from the pivot before. ``known`` has all that was measured.
    """
    dealt = crowded.join(pivots, "key")
    now = measured.select(F.col("pivot").alias("by"), "node", F.col("d").alias("now"))
    gap = F.sum(F.coalesce("now", F.lit(0))) < F.sum("d")
    nearer = dealt.join(now, ["by", "node"], "left").groupBy("key").agg(F.coalesce(gap, F.lit(True)).alias("nearer"))
    dealt = dealt.join(nearer, "key")
    anew = dealt.filter("nearer").select(F.col("by").alias("pivot"), "node").distinct()
    start = {"key": F.col("pivot"), "extra": F.lit(False), "at": F.lit(-1), "level": F.lit(0)}
    fresh = _differences(_labelled(measured.join(anew, ["pivot", "node"]).withColumns(start), found))
    more = known.dropDuplicates(["pivot", "node"]).select("pivot", "node", "plain", "most", "shingles")
    further = dealt.filter(~F.col("nearer") & (F.col("extra") | (F.col("common") > F.col("level"))))
    return fresh.unionByName(_differences(further.join(more, ["pivot", "node"])))


def _with_company(members: DataFrame) -> DataFrame:
    """Members of keys that have more than one."""
    shared = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return members.join(shared, "key", "left_semi")


def near_copies(docs: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """doc_id and component_id, the least doc_id reachable, for each row of ``docs`` (doc_id, text).

    No doc_id may repeat, and ``docs`` is a scan of written files: the ids tell which texts are read again. ``proposed``
    (doc_id, component_id) are groups found otherwise: the sets of each text and of the one that names its group are
    compared first, and what is near starts as one component. Null means none; the result is the same.
    """
    spark = docs.sparkSession
    rows = materialize(_sketches(docs), "sketches")
    first = rows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"))
    first = materialize(first.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    named = first.select(F.col("first").alias("doc_id"), "node")
    own = rows.join(named, "doc_id").select("node", "n", F.explode("keys").alias("key"))
    keyed = own.withColumn("extra", F.lit(False)).withColumn("pivot", F.lit(None).cast("long"))
    keyed = materialize(keyed.withColumns({c: F.lit(None).cast("int") for c in ("d", "common", "at", "level")}), "keys")
    members = materialize(_with_company(keyed), "members")
    discard(keyed)
    wanted = members.select("node")
    if proposed is not None:
        of = rows.join(first, ["high", "low"]).select("doc_id", "node")
        ends = proposed.join(of, "doc_id").select(F.col("component_id").alias("doc_id"), F.col("node").alias("x")).join(of, "doc_id")
        stars = ends.filter("x <> node").select(*_ordered(F.col("x"), F.col("node"))).distinct()
        stars = materialize(stars, "proposed")
        wanted = wanted.unionByName(stars.select(F.explode(F.array("a", "b")).alias("node")))
    wanted = wanted.distinct().join(named, "node")
    sets = materialize(_sets(docs.join(wanted, "doc_id")), "sets")
    compared = spark.createDataFrame([], "a long, b long, near boolean")
    found = spark.createDataFrame([], "node long, least long")
    if proposed is not None:
        compared = materialize(_compared(stars, sets), "compared")
        discard(stars)
        if not compared.filter("near").isEmpty():
            found = components(compared.filter("near").select("a", "b"))
    turn, known = 0, None
    while not members.isEmpty():
        open_now = materialize(_labelled(members, found), "open-members")
        discard(members)
        # in the first round all keys are crowded: most texts that are alike fall together
        pairs = _all_met(open_now, turn == ROUNDS) if turn else _stars(open_now)
        new = materialize(_compared(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), sets), "compared")
        compared = compared.unionByName(new)
        linked, crowded = not new.filter("near").isEmpty(), open_now.filter(_crowded())
        if not turn:
            found = components(compared.filter("near").select("a", "b")) if linked else found
            members, turn = open_now, 1
            continue
        if turn == ROUNDS or crowded.isEmpty():
            found = components(compared.filter("near").select("a", "b")) if linked else found
            discard(open_now)
            break
        pivots = materialize(_pivots(crowded), "pivots")
        met = crowded.join(pivots, "key").filter("node <> by").select(F.col("by").alias("pivot"), "node", "n").distinct()
        measured = materialize(_measured(met, sets), "compared")
        known = measured if known is None else known.unionByName(measured)
        compared = compared.unionByName(measured.select(*_ordered(F.col("pivot"), F.col("node")), "near").distinct())
        if linked or not measured.filter("near").isEmpty():
            found = components(compared.filter("near").select("a", "b"))
        members = materialize(_narrower(crowded, pivots, measured, known, found), "members")
        discard(open_now)
        discard(pivots)
        turn += 1
    discard(sets)
    labelled = first.join(found, "node", "left").select("high", "low", "first", F.coalesce("least", "node").alias("least"))
    least = labelled.groupBy("least").agg(F.min("first").alias("component_id"))
    return rows.join(labelled.join(least, "least").select("high", "low", "component_id"), ["high", "low"]).select("doc_id", "component_id")
