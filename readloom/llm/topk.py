"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Components become integers. Vectors are dealt into blocks by a hash of their id, queries into blocks likewise; every
query block meets every vector block in one task, and both are bounded, so memory is too. In a task each dimension's
list of its block is sorted once. A query reads the lists of its non-zero dimensions in parallel, from the top where
its component is positive and from the bottom where it is negative, ``DEPTH`` entries further in each round; every
vector met for the first time is scored whole. What no list has shown yet scores at most the inner product of the
query and the entries just read. Once the k-th best score is above that bound the block is done; a score that only
equals the bound may still be matched by an unseen vector with a lesser id, so reading goes on.

The k best of each block then meet in a window by query that sees k rows a block.

Nulls: vectors that are null or hold null or non-finite components take no part, as query or candidate, nor do rows
without id. Shorter vectors count as padded with zeros. Ties go to the lesser id; a row that repeats is a candidate
of its own (but never for its own id), while of a repeated query id the least vector asks. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import materialize

SCALE = 1024
BLOCK = 4096
QUERY_BLOCK = 1024
DEPTH = 24


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Lists:
    """A block of vectors, and for each dimension its rows in ascending order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], np.ascontiguousarray(rows[by_id])
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.rows, self.order.T, axis=0).T.copy()

    def top(self, query: np.ndarray, own: int, k: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first, without the query's own id."""
        n, width = self.rows.shape
        query = np.concatenate([query, np.zeros(max(0, width - len(query)), np.int64)])[:width]
        dims = np.nonzero(query)[0]
        seen = np.zeros(n, bool)
        best_at, best = np.empty(0, np.int64), np.empty(0, np.int64)
        at = 0
        while True:
            to = min(n, at + depth)
            if len(dims):
                up = query[dims] > 0
                picks = np.concatenate([self.order[dims[~up], at:to].ravel(), self.order[dims[up], n - to : n - at].ravel()])
                fresh = np.zeros(n, bool)
                fresh[picks] = True
                fresh &= ~seen
            else:  # every score is 0
                to, fresh = n, ~seen
            seen |= fresh
            new = np.nonzero(fresh)[0]
            new = new[self.ids[new] != own]
            best_at = np.concatenate([best_at, new])
            best = np.concatenate([best, self.rows[new] @ query])
            keep = np.lexsort((best_at, -best))[:k]  # rows stand in order of their ids
            best_at, best = best_at[keep], best[keep]
            if to >= n:
                break
            if len(best) == k:
                edge = np.where(up, self.sorted[dims, n - to], self.sorted[dims, to - 1])
                if best[-1] > query[dims] @ edge:
                    break
            at, depth = to, depth * 2
        return self.ids[best_at], best


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding. The number of blocks follows from the numbers of rows.
    """
    ready = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", integers(F.col("embedding")).alias("v")
    )
    vectors, queries = materialize(ready(vectors), "vectors"), materialize(
        ready(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries"
    )
    n_blocks = max(1, math.ceil(vectors.count() / BLOCK))
    n_parts = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", "v", block(n_blocks).alias("block"), each(n_parts).alias("part"))
    right = queries.select("vec_id", "v", block(n_parts).alias("part"), each(n_blocks).alias("block"))

    def meet(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asked):
            lists = Lists(found.vec_id.to_numpy(), _matrix(found.v))
            for own, q in zip(asked.vec_id, asked.v, strict=True):
                ids, scores = lists.top(np.asarray(q, np.int64), own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(out)

    keys = ["block", "part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
