"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document of size x in source s gets a rate between 0 and ``MOST`` (how often the mix takes it). Of all rates
that bring the source's taken words to its target, those nearest to 1 in relative entropy (of a rate and its rest
up to ``MOST``) are exponential tilts: rate / (MOST - rate) = exp(tilt * x / scale). The one tilt of a source is the
root of the derivative of a convex dual, and Newton's method finds it for all sources at once. The rates depend on a
document only through its source and size, so an iteration aggregates over distinct (source, size) pairs; a bracket
around each root keeps steps that would leave it, and the state of one row a source is written between iterations.

Rates then become copies. Within a source, sizes are taken in descending order and copies rounded so that their running
number stays within a half of the running sum of rates; the words this misses are then made up with the largest sizes
that fit, ``REPAIRS`` times, so that what remains is of the order of the smallest documents. The copies of a (source,
size) pair are dealt to its documents in order of a hash of their ids and texts: pairs are split into ``SPLITS`` parts by that
hash, a part gets its share by running counts, so that not even a pair that holds a third of all rows meets in one task.

Targets: sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and share ``SHARE`` of all sizes; a target
stops at ``MOST`` times its source's size, and the excess goes to the others by weight until none is above.

Nulls: a null text has size 0, a document of size 0 takes 0 words; a null source is a source. Rows that repeat are rows
of their own: each has its place by an id of the row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SPLITS = 256
REPAIRS = 3
TOLERANCE = 1e-6
MOST_ROUNDS = 40
_STEPS = 2


def size_of(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) -> source, source_size, target.

    A source's target is the lesser of its limit and a common level times its weight. In order of limit over weight,
    the level that the sources before leave to the others rises while sources are limited and falls after, so the
    level is its maximum. One row a source in the windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    limited = weighed.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    before = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = limited.withColumn("level", left / open_weight)
    return levels.select(
        "source",
        "source_size",
        F.least("limit", F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def _rate(tilt: Column, most: float) -> Column:
    """Rate of a document by its tilt exponent, without overflow."""
    bounded = F.greatest(F.least(tilt, F.lit(700.0)), F.lit(-700.0))
    return F.lit(float(most)) / (1 + F.exp(-bounded))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def solve(pairs: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """Newton's method on the dual: goals (source, source_size, target) with the tilt of each source.

    ``pairs``: source, size, n (documents of that source and size).
    """
    spread = pairs.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    spread = spread.withColumnRenamed("source", "of")
    state = goals.join(spread, _same(F.col("source"), F.col("of"))).select(
        "source", "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"),
        F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
        F.lit(False).alias("done"),
    )
    state = materialize(state.coalesce(1), "mix-state")  # one row a source: one file
    for _ in range(MOST_ROUNDS):
        after = state
        for _ in range(_STEPS):
            after = _newton(pairs, after, most)
        state = materialize(after.coalesce(1), "mix-state")
        if state.filter("not done").isEmpty():
            break
    # sums of doubles end in other last digits where partitions come in another order
    return state.drop("low", "high", "done").withColumn("tilt", F.round("tilt", 9))


def _newton(pairs: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """One safeguarded step of every source that has not settled."""
    known = state.select(F.col("source").alias("of"), "tilt", "scale")
    x = F.col("size") / F.col("scale")
    rate = _rate(F.col("tilt") * x, most)
    sums = (
        pairs.join(known, _same(F.col("source"), F.col("of")))
        .groupBy("of")
        .agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"),
        )
    )
    met = state.join(sums, _same(F.col("source"), F.col("of")))
    miss = F.col("taken") - F.col("target")
    close = F.abs(miss) <= F.col("target") * TOLERANCE
    high = F.when(miss > 0, F.least("high", "tilt")).otherwise(F.col("high"))
    low = F.when(miss < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
    step = F.col("tilt") - miss / F.col("slope")
    inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (step > low) & (step < high)
    # out of the bracket: its middle, or twice as far where it is open
    away = F.greatest(F.abs("tilt") * 2, F.lit(1.0))
    fallback = (
        F.when(high == float("inf"), low + F.when(low > 0, low).otherwise(away))
        .when(low == float("-inf"), high - F.when(high < 0, -high).otherwise(away))
        .otherwise((low + high) / 2)
    )
    full = F.col("target") >= F.col("source_size") * float(most)  # every rate is at its bound
    settled = F.col("done") | close | full | (F.abs("tilt") > 1e12)
    tilt = F.when(full, F.lit(1e300)).when(settled, F.col("tilt")).when(inside, step).otherwise(fallback)
    return met.select(
        "source", "source_size", "target", "scale", tilt.alias("tilt"), low.alias("low"), high.alias("high"),
        settled.alias("done"),
    )


def _copies_of_pairs(pairs: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """source, size, n, copies: whole copies of each pair, near the rates and together near the target.

    A source's windows see one row for each distinct size of its documents.
    """
    known = solved.select(F.col("source").alias("of"), "source_size", "target", "tilt", "scale")
    rate = F.when(F.col("size") == 0, 0.0).otherwise(_rate(F.col("tilt") * F.col("size") / F.col("scale"), most))
    down = W.partitionBy("source").orderBy(F.desc("size"))
    running = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(W.unboundedPreceding, 0))
    rounded = pairs.join(known, _same(F.col("source"), F.col("of"))).drop("of").withColumn("rate", rate)
    rounded = rounded.withColumn("upto", F.floor(running + 0.5)).withColumn(
        "copies", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))
    )
    rounded = rounded.withColumn("copies", F.greatest(F.least("copies", F.col("n") * most), F.lit(0)))
    all_of = W.partitionBy("source")
    for _ in range(REPAIRS):
        missing = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(all_of)
        rounded = rounded.withColumn("missing", missing)
        up = F.col("missing") > 0
        room = F.when(up, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("missing"))
        rounded = rounded.withColumn("room", F.when(fits, room).otherwise(0))
        before = F.coalesce(
            F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        )
        left = F.floor((F.abs("missing") - before) / F.greatest("size", F.lit(1)))
        change = F.greatest(F.least("room", left), F.lit(0))
        rounded = rounded.withColumn("copies", F.col("copies") + F.when(up, change).otherwise(-change))
    return rounded.select("source", "size", "n", "copies", "rate", "source_size", "target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, row: str | None = None) -> DataFrame:
    """row, doc_id, source, size, source_size, target, rate, copies, taken for each row of ``docs`` (doc_id, text, source).

    ``row`` is the column of that name, which numbers the rows. Without one they are numbered in the scan; another scan
    may number them otherwise, so what is to be joined back needs a column that is written.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    # by the document alone: another scan may number rows otherwise, and copies must not change with that
    order = F.xxhash64("doc_id", "text").alias("order")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), number.alias("row"), order)
    sized = materialize(sized, "mix-sizes")
    pairs = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-pairs")
    goals = materialize(targets(pairs.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most), "mix-targets")
    dealt = materialize(_copies_of_pairs(pairs, solve(pairs, goals, most), most), "mix-copies")
    # the copies of a pair over its parts: base for all of its documents, one more for the first in each part
    part = F.pmod("order", F.lit(SPLITS)).alias("part")
    parts = sized.groupBy("source", "size", part).agg(F.count("*").alias("here"))
    known = dealt.select(F.col("source").alias("of"), F.col("size").alias("of_size"), "n", "copies", "rate", "source_size", "target")
    same = _same(F.col("source"), F.col("of")) & (F.col("size") == F.col("of_size"))
    base = F.floor(F.col("copies") / F.col("n"))
    more = F.col("copies") - base * F.col("n")
    upto = F.sum("here").over(W.partitionBy("source", "size").orderBy("part"))  # SPLITS rows at most
    share_of = lambda k: F.floor(more * k / F.col("n"))
    quotas = (
        parts.join(known, same)
        .withColumn("upto", upto)
        .select(
            F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("part").alias("of_part"), base.alias("base"),
            (share_of(F.col("upto")) - share_of(F.col("upto") - F.col("here"))).alias("extra"),
            "rate", "source_size", "target",
        )
    )
    numbered = sized.select("*", part).withColumn(
        "place", F.row_number().over(W.partitionBy("source", "size", "part").orderBy("order", "row"))
    )
    same_part = same & (F.col("part") == F.col("of_part"))
    copies = F.col("base") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    return numbered.join(quotas, same_part).select(
        "row", "doc_id", "source", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )
