"""Near copies by SimHash: fingerprints meet in a grid of segment popcounts, where distance bounds theirs from below.

A 64-bit fingerprint is mapped to the numbers of set bits of its ``SEGMENTS`` segments. A differing bit changes one
count by one, so the Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints.
Pairs within ``DISTANCE`` bits therefore lie in cells of the grid that are at most so far apart: each fingerprint
probes those cells (one of each two opposite offsets), an equi-join on the cell's number, and the join's condition
verifies the true distance.

Copies fall together first: the join runs over distinct fingerprints, so a group of copies of any size is one row.
Cells that hold more than ``most_in_cell`` distinct fingerprints would make many candidate pairs. Their
fingerprints, and all fingerprints near enough to such a cell, take an exact way whose work is linear: two
fingerprints within two bits have a point within one bit of both, so each sends itself to the 65 points around it,
and whatever meets at a point is linked. No point can gather more than 65. The two ways together find every link:
a pair with no end in such a cell in the grid, any other at its common point.

Nulls: a null text counts as empty; empty texts have fingerprint 0 and link like any other. Null ids are ignored
where the least id is sought. Repeated rows each get their row.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, small_batches, text_or_empty
from readloom.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 8
MOST_IN_CELL = 24
_WIDTH = 64 // SEGMENTS
_STRETCH = 1 << 16


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half the hashes of the word shingles; words are split at ASCII white space, A-Z lowered."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    h, n, counts = xxhash.xxh64_intdigest, len(stops), np.zeros(64, np.int64)
    for i in range(0, n, _STRETCH):
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[i : i + _STRETCH], stops[i : i + _STRETCH], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint, a signed 64-bit number."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", fingerprint(text_or_empty()).alias("fingerprint"))


def cell_of(fingerprint: Column) -> Column:
    """The popcounts of all segments, four bits each."""
    mask = (1 << _WIDTH) - 1
    cell = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        part = F.bit_count(F.shiftrightunsigned(fingerprint, i * _WIDTH).bitwiseAND(F.lit(mask).cast("long")))
        cell = cell + F.shiftleft(part.cast("long"), 4 * i)
    return cell


def offsets(distance: int = DISTANCE) -> list[int]:
    """All differences of cells within the distance, the zero first; a borrow never ends in a cell that exists."""
    found = {(0,) * SEGMENTS}
    for k in range(1, distance + 1):
        for at in combinations(range(SEGMENTS), k):
            for steps in product(range(-distance, distance + 1), repeat=k):
                if sum(map(abs, steps)) <= distance:
                    found.add(tuple(dict(zip(at, steps, strict=True)).get(i, 0) for i in range(SEGMENTS)))
    return [sum(s << (4 * i) for i, s in enumerate(o)) for o in sorted(found, key=lambda o: (any(o), o))]


def _each(numbers: list[int]) -> Column:
    return F.array(*[F.lit(n).cast("long") for n in numbers])


def links(prints: DataFrame, most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """(fingerprint) distinct -> links (a, b) that connect exactly what is within ``DISTANCE`` bits."""
    cells = prints.select("fingerprint", cell_of(F.col("fingerprint")).alias("cell"))
    every = offsets()
    full = materialize(
        cells.groupBy("cell").count().filter(F.col("count") > most_in_cell).select("cell"), "full-cells"
    )
    sparse = cells.join(full, "cell", "left_anti")
    half = [o for o in every if o >= 0]  # of two opposite offsets the positive number
    probes = sparse.select(F.col("fingerprint").alias("a"), F.explode(_each(half)).alias("o"), "cell").select(
        "a", (F.col("cell") + F.col("o")).alias("cell"), (F.col("o") == 0).alias("own")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    base = sparse.select(F.col("fingerprint").alias("b"), F.col("cell").alias("at"))
    # Spark sizes what an explode makes like a row of its input, so it might broadcast the probes: sort-merge joins
    in_grid = probes.join(base.hint("merge"), (F.col("cell") == F.col("at")) & near & once).select("a", "b")
    # around full cells: through the points within one bit
    around = full.select(F.explode(_each(every)).alias("o"), "cell").select((F.col("cell") + F.col("o")).alias("cell"))
    flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    points = cells.join(around.distinct().hint("merge"), "cell", "left_semi").select(
        "fingerprint", F.explode(_each(flips)).alias("flip")
    )
    met = (
        points.groupBy(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("point"))
        .agg(F.collect_list("fingerprint").alias("all"))  # 65 at most
        .filter(F.size("all") > 1)
    )
    at_points = met.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).filter("a <> b")
    return in_grid.unionByName(at_points)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """doc_id, fingerprint (a number) and component_id, the least doc_id reachable, for each row of ``docs``."""
    prints = materialize(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    first = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = components(links(first.select("fingerprint"), most_in_cell))
    labelled = first.join(linked, first.fingerprint == linked.node, "left").select(
        "fingerprint", "first", F.coalesce("least", "fingerprint").alias("least")
    )
    least = labelled.groupBy("least").agg(F.min("first").alias("component_id"))
    return prints.join(labelled.join(least, "least").select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
