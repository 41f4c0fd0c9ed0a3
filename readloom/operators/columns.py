"""Votes and error tests on alignment columns, and weighted consensus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from readloom.functions.dna import ALPHABET, error_probability
from readloom.functions.stats import QUANTILE_MASS, binomial_quantile

# An N adds no quality to its column.
NO_CALL = "N"
GAP = "-"
# Sums this many standard deviations (and so many bases) from the mean don't count in a double.
_DEVIATIONS, _STEPS = 12.0, 20
# Cells of distributions that are worked out at a time, and what their sums may be off by.
_CELLS, _ROUNDING = 1 << 20, 1e-11


def base_tallies(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, base, n, sum_q, sum_e): combined before the shuffle, so a deep column costs no more than a shallow one."""
    return members.groupBy(*by, "base").agg(
        F.count("*").alias("n"),
        F.sum("qual").alias("sum_q"),
        F.sum(error_probability(F.col("qual"))).alias("sum_e"),
    )


def column_profile(members: DataFrame, by: list[str]) -> DataFrame:
    """One wide row per column: n_<base>, q_<base> for each base of the alphabet, depth, sum_e."""
    parts = [F.sum("n").alias("depth"), F.sum("sum_e").alias("sum_e")]
    for b in ALPHABET:
        here = F.col("base") == b
        parts.append(F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"n_{b}"))
        if b != NO_CALL:
            parts.append(F.sum(F.when(here, F.col("sum_q")).otherwise(0)).alias(f"q_{b}"))
    wide = base_tallies(members, by).groupBy(*by).agg(*parts)
    return wide.withColumn(f"q_{NO_CALL}", F.lit(0).cast("bigint"))


def _n(b: str) -> Column:
    return F.col(f"`n_{b}`")


def _q(b: str) -> Column:
    return F.col(f"`q_{b}`")


def heaviest_base(exclude: str = "") -> Column:
    """Base with the largest quality sum of a profile row; the lowest character on a tie."""
    runners = [
        F.when(_n(b) > 0, F.struct(_q(b).alias("q"), F.lit(-ord(b)).alias("tie"), F.lit(b).alias("base")))
        for b in ALPHABET
        if b not in exclude
    ]
    return F.greatest(*runners)["base"]


def majority_base() -> Column:
    """Most frequent base of a profile row; the lowest character on a tie."""
    runners = [
        F.when(_n(b) > 0, F.struct(_n(b).alias("n"), F.lit(-ord(b)).alias("tie"), F.lit(b).alias("base")))
        for b in ALPHABET
    ]
    return F.greatest(*runners)["base"]


def _votes(profile: DataFrame, keep: list[str]) -> DataFrame:
    """Wide profile rows -> one row per base present."""
    cells = F.array(
        *(F.struct(F.lit(b).alias("base"), _n(b).alias("n"), _q(b).alias("sum_q")) for b in ALPHABET)
    )
    return (
        profile.select(*keep, F.explode(cells).alias("cell"))
        .select(*keep, "cell.base", "cell.n", "cell.sum_q")
        .filter("n > 0")
    )


def column_votes(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, base, n, sum_q) for each base of each column."""
    counted = F.when(F.col("base") == NO_CALL, 0).otherwise(F.col("sum_q"))
    return base_tallies(members, by).select(*by, "base", "n", counted.alias("sum_q"))


def reference_bases(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, ref): the base with the largest quality sum."""
    return column_profile(members, by).select(*by, heaviest_base().alias("ref"))


def error_test_of_profile(
    profile: DataFrame, by: list[str], cap: int | None, margin_fold: float, fold: float
) -> DataFrame:
    ref_n = F.lit(0)
    for b in ALPHABET:
        ref_n = F.when(F.col("ref") == b, _n(b)).otherwise(ref_n)
    rows = profile.withColumn("ref", heaviest_base()).withColumn("ref_n", ref_n)
    rows = rows.withColumn("e", F.col("sum_e") / F.col("depth"))
    votes = _votes(rows, [*by, "ref", "ref_n", "e"])
    support = F.col("ref_n") if cap is None else F.least(F.col("ref_n"), F.lit(cap))
    quantile = F.coalesce(binomial_quantile(F.col("n") + support, 1 - F.col("e")), F.lit(0.0))
    unit = F.lit(-10.0) * F.log10("e")
    limit = F.lit(float(margin_fold)) * unit + F.lit(float(fold)) * quantile * unit
    is_error = F.when(F.col("base") != F.col("ref"), F.col("sum_q") <= limit).otherwise(F.lit(False))
    return votes.select(*by, "base", "n", "sum_q", "ref", is_error.alias("is_error"))


def column_error_test(
    members: DataFrame,
    by: list[str],
    cap: int | None = None,
    margin_fold: float = 0.0,
    fold: float = 1.0,
) -> DataFrame:
    """(by, base, n, sum_q, ref, is_error): which bases of a column are sequencing errors.

    A base other than the reference base is an error if its quality sum is
    within what a binomial with the mean error rate of the column explains.
    """
    return error_test_of_profile(column_profile(members, by), by, cap, margin_fold, fold)


def _quality_sum_quantiles(quals: pd.Series, counts: pd.Series) -> np.ndarray:
    """Least t of each column with P(sum of the qualities of wrong bases <= t) >= 0.9999, bases independent.

    ``quals`` and ``counts`` list the qualities of a column and how many bases have them; null: no bases. The sum of
    independent bases has the product of their characteristic functions, one factor a quality to the power of its count:
    worked out for all columns of a batch at once, then turned into distributions. A distribution is cut to a window
    about its mean, so memory grows with the square root of the depth.
    """
    lens = quals.map(lambda q: 0 if q is None else len(q)).to_numpy(np.int64)
    limits = np.zeros(len(lens), np.int64)
    if not lens.sum():
        return limits
    flat_q, flat_n = (np.concatenate([x for x in side if x is not None]).astype(np.int64) for side in (quals, counts))
    levels, at = np.unique(flat_q, return_inverse=True)
    depth = np.zeros((len(lens), len(levels)))
    np.add.at(depth, (np.repeat(np.arange(len(lens)), lens), at), flat_n)
    depth, levels = depth[:, levels > 0], levels[levels > 0]  # quality 0 adds nothing to the sum
    error = 10.0 ** (-levels / 10.0)
    total = depth @ levels
    mean, spread = depth @ (levels * error), np.sqrt(depth @ (levels**2 * error * (1 - error)))
    reach = np.ceil(_DEVIATIONS * spread + _STEPS * levels.max(initial=0))
    width = 1 << np.ceil(np.log2(np.minimum(total, 2 * reach) + 1)).astype(np.int64)
    low = np.where(total < width, 0, np.maximum(np.floor(mean - reach), 0)).astype(np.int64)
    for size in np.unique(width[total > 0]).tolist():
        roots, turns = np.exp(-2j * np.pi * np.arange(size) / size), np.arange(size // 2 + 1)
        alike = np.flatnonzero((width == size) & (total > 0))
        for rows in np.array_split(alike, -(-len(alike) * size // _CELLS)):
            logs = np.zeros((len(rows), len(turns)), complex)
            for n, q, e in zip(depth[rows].T, levels, error):
                logs += n[:, None] * np.log(1 - e + e * roots[turns * q % size])
            mass = np.fft.irfft(np.exp(logs), size, axis=1)
            places = (low[rows, None] + np.arange(size)) % size
            reached = np.cumsum(np.take_along_axis(mass, places, axis=1), axis=1) >= QUANTILE_MASS - _ROUNDING
            limits[rows] = low[rows] + reached.argmax(axis=1)
    return limits


@F.pandas_udf(LongType())
def _quantile_of(quals: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series(_quality_sum_quantiles(quals, counts))


def column_error_test_exact(members: DataFrame, by: list[str], cap: int | None = None) -> DataFrame:
    """(by, base, n, sum_q, is_error) by the exact distribution of the quality sum of a column.

    Bases are errors, lightest first, while their running quality sum stays
    within its 0.9999 quantile. With ``cap`` only that many lowest qualities of
    a base count. There is no limit on the depth of a column: it travels as a
    histogram of at most bases x qualities entries.
    """
    histogram = members.groupBy(*by, "base", "qual").agg(F.count("*").alias("n"))
    lowest = Window.partitionBy(*by, "base").orderBy("qual").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(lowest), F.lit(0))
    kept = F.col("n") if cap is None else F.greatest(F.least(F.col("n"), cap - before), F.lit(0))
    counted = histogram.withColumn("kept", kept).withColumn("called", F.col("base") != NO_CALL)
    level = F.when(F.col("called") & (F.col("kept") > 0), F.struct("qual", "kept"))
    per_base = counted.groupBy(*by, "base").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("called"), F.col("qual") * F.col("kept")).otherwise(0)).alias("sum_q"),
        F.collect_list(level).alias("levels"),
    )
    # the histogram is read once; a quality may stand once for each base
    votes = per_base.groupBy(*by).agg(
        F.collect_list(F.struct("base", "n", "sum_q")).alias("votes"), F.flatten(F.collect_list("levels")).alias("levels")
    )
    rows = votes.select(
        *by,
        _quantile_of("levels.qual", "levels.kept").alias("limit"),
        F.inline("votes"),
    )
    lightest = Window.partitionBy(*by).orderBy("sum_q", "base")
    running = rows.withColumn(
        "running", F.sum("sum_q").over(lightest.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("heaviest", F.sum("sum_q").over(Window.partitionBy(*by)))
    exact = F.when(F.col("heaviest") > F.col("limit"), F.col("running") <= F.col("limit")).otherwise(
        F.col("sum_q") == 0
    )
    return running.withColumn("is_error", exact).select(*by, "base", "n", "sum_q", "is_error")


def weighted_consensus(df: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """(by, value, weight): the value with the largest total weight, the lowest value on a tie."""
    votes = df.groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    best = votes.groupBy(*by).agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col(value))).alias("best"))
    return best.select(*by, F.col(f"best.{value}").alias(value), (-F.col("best.w")).alias("weight"))


def consensus_sequence(members: DataFrame, group: list[str], column: str, keep_gaps: bool = False) -> DataFrame:
    """(group, consensus): majority base of each column, in column order.

    A group is one alignment; its columns are at most a few read lengths.
    """
    voted = column_profile(members, [*group, column]).select(*group, column, majority_base().alias("base"))
    if not keep_gaps:
        voted = voted.filter(F.col("base") != GAP)
    cells = F.array_sort(F.collect_list(F.struct(column, "base")))
    return voted.groupBy(*group).agg(cells.alias("cells")).select(
        *group, F.array_join(F.col("cells.base"), "").alias("consensus")
    )
