"""Connected components of links between numbers, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialize

_MOST_ROUNDS = 60


def _sum_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, least): each linked node with the least node it reaches.

    Every step writes its edges to the shared folder, so the lineage stays one step long. The least neighbour of a
    node is a sum with map-side combining; the join back to a hub's many edges is an ordinary join, which adaptive
    execution splits where one node holds a large share.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    for _ in range(_MOST_ROUNDS):
        now = _sum_of(edges)
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        discard(edges)  # its successor is written
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        both_ends = F.explode(F.array("a", "b")).alias("a")  # each hangs on the least of them
        small = large.join(least, "a").select(both_ends, F.col("m").alias("b")).filter("a <> b").distinct()
        edges = materialize(small, "small-star")
        discard(large)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct()
    )
