"""A Merkle manifest of a dataset with a proof for each row, by pointer jumping over the tree.

Leaves are digests of rows. The leaves of a source stand in order of doc_id; every ``ARITY`` consecutive nodes (a run)
become their digest, level by level, until one node is left, the subroot. The subroots, in order of their sources, are
the leaves of a last tree, whose root is the digest of the dataset.

Places: rows are range-partitioned by (source, doc_id, digest), so a hot source lies in many partitions, and a place is
a row's place in its partition plus what earlier partitions hold of its source. Levels are groupings by run, of
``ARITY`` rows at most.

Proofs: each inner node starts with a pointer to its parent and one segment, the digests of its siblings left and right
of it. A round joins the nodes with the nodes that they point to: the pointer becomes that node's pointer, and its
segments are appended. So the distance doubles and a tree of depth d takes log2(d) rounds. From distance 4 on, many
nodes point to one; each pointed-to row is then copied for parts of its subtree, so that at most ``ARITY ** 2`` rows
share a key. The leaves of a run share the segments of their parent, so they never take part in the rounds: a run meets
its parent's segments in one last join and its leaves get their own siblings from the run.

Nulls: a null field enters the digest as ``-``; a null source is a source, before all others; a null doc_id comes first
in its source and is never tampered with. Ties of doc_id stand in order of the digest; rows that repeat are leaves of
their own, which of them gets which place is left open. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialize

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = "top"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MOST_COPIES = 4096


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field with its length in UTF-8 bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**replaced: Column) -> Column:
    return digest(*[framed(replaced.get(f, F.col(f))) for f in FIELDS])


def lowered(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def _tree_of(source: Column) -> Column:
    """Name of a source's tree: never null, in the order of the sources, a null one first; ``top`` is after all."""
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


def _joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (tree, leaf, ...) with ``idx``, the place of each in its tree by ``order``, and ``n``, the tree's size."""
    by = ["tree", *order, "leaf"]
    ties = F.xxhash64(F.monotonically_increasing_id()).alias("__tie")  # parts a row that repeats
    dealt = leaves.select("*", ties).repartitionByRange(*by, "__tie").sortWithinPartitions(*by, "__tie")
    dealt = materialize(
        dealt.drop("__tie").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
        "merkle-leaves",
    )
    parts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    before = F.sum("here").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select(
        "tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"),
        F.sum("here").over(W.partitionBy("tree")).alias("n"),
    )
    kept = [c for c in leaves.columns]
    return dealt.join(starts, ["tree", "part"]).select(*kept, (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n")


def _depth(n: int) -> int:
    """Levels between that many nodes and the one left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _run() -> Column:
    return F.floor(F.col("idx") / ARITY)


def _id(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def _tower(nodes: DataFrame) -> DataFrame:
    """nodes (tree, level, idx, hash, n) of the lowest level -> those and all above; ``n``: nodes of a tree's level."""
    biggest = nodes.agg(F.max("n")).first()[0] or 0  # one number
    every = now = nodes
    for _ in range(_depth(biggest)):
        runs = now.filter("n > 1").groupBy("tree", "level", "n", _run().alias("run"))
        kids = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"))  # ARITY at most
        now = materialize(
            kids.select(
                "tree", (F.col("level") + 1).alias("level"), F.col("run").alias("idx"),
                digest(_joined(F.col("kids.hash"))).alias("hash"), F.ceil(F.col("n") / ARITY).alias("n"),
            ),
            "merkle-level",
        )
        every = every.unionByName(now)
    return every


def _segment(hashes: Column, at: Column) -> Column:
    """Siblings of the node at place ``at`` (from 0) of a run."""
    after = F.greatest(F.size(hashes) - at - 1, F.lit(0))
    return F.struct(
        _joined(F.slice(hashes, F.lit(1), at)).alias("left"), _joined(F.slice(hashes, at + 2, after)).alias("right")
    )


def _pointers(nodes: DataFrame) -> DataFrame:
    """(id, up, path) of all nodes but those that end a tree: the parent, and the segment towards it."""
    runs = nodes.filter("n > 1").groupBy("tree", "level", _run().alias("run"))
    kids = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"))  # ARITY at most
    each = kids.select("*", F.posexplode("kids").alias("at", "kid"))
    return each.select(
        _id(F.col("tree"), F.col("level"), F.col("kid.idx")).alias("id"),
        _id(F.col("tree"), F.col("level") + 1, F.col("run")).alias("up"),
        F.array(_segment(F.col("kids.hash"), F.col("at"))).alias("path"),
    )


def _jump(table: DataFrame, distance: int) -> DataFrame:
    """One round: pointers over ``distance`` levels come to span twice as many; null where the root is reached."""
    copies = min(ARITY ** max(distance - 2, 0), _MOST_COPIES)
    part = F.pmod(F.xxhash64("id.tree", "id.level", F.floor(F.col("id.idx") / ARITY**2)), F.lit(copies))
    can_be_met = (F.col("id.tree") == _TOP) | (F.col("id.level") > distance)
    above = table.filter(can_be_met).select(
        F.col("id").alias("up"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("part"),
        F.col("up").alias("further"), F.col("path").alias("more"), F.col("subroot").alias("of_above"),
    )
    met = table.withColumn("part", part).join(above, ["up", "part"], "left")
    path = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more"))
    return met.select("id", F.col("further").alias("up"), path.alias("path"), F.coalesce("subroot", "of_above").alias("subroot"))


def _paths(nodes: DataFrame) -> tuple[DataFrame, str | None]:
    """nodes of the source trees -> (id, path to the root, subroot) for each of them, and the root."""
    crowns = nodes.filter("n = 1").select(
        F.lit(_TOP).alias("tree"), F.col("tree").alias("of"), _id(F.col("tree"), F.col("level"), F.col("idx")).alias("id"),
        F.col("hash").alias("leaf"),
    )
    top = materialize(placed(crowns, "of").withColumn("level", F.lit(0)), "merkle-top")
    tower = _tower(top.select("tree", "level", "idx", F.col("leaf").alias("hash"), "n"))
    ends = tower.filter("n = 1").select("hash").take(1)
    none = F.lit(None).cast("string").alias("subroot")
    links = _pointers(tower)
    # the end of the last tree is no row: who points to it has arrived
    last = tower.filter("n = 1").select(_id(F.col("tree"), F.col("level"), F.col("idx")).alias("up"), F.lit(True).alias("ends"))
    links = links.join(F.broadcast(last), "up", "left").select("id", F.when(F.col("ends").isNull(), F.col("up")).alias("up"), "path")
    # a subroot keeps the name it has in its own tree
    first = links.filter("id.level = 0").select(F.col("id.idx").alias("idx"), "up", "path")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    crowned = top.join(first, "idx", "left").select("id", "up", F.coalesce("path", empty).alias("path"), F.col("leaf").alias("subroot"))
    table = _pointers(nodes).select("*", none).unionByName(crowned)
    table = materialize(table.unionByName(links.filter("id.level > 0").select("*", none)), "merkle-paths")
    distance = 1
    while not table.filter("up is not null").isEmpty():
        further = materialize(_jump(table, distance), "merkle-paths")
        discard(table)
        table, distance = further, distance * 2
    return table.select("id", "path", "subroot"), ends[0][0] if ends else None


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path and tampered for each row of ``docs``.

    ``path`` lists the siblings (left, right) of the leaf and of each node above it, as concatenated digests.
    ``tampered`` is the leaf of the row with its text in lower case where 5 divides the CRC-32 of doc_id, else null.
    """
    doc = docs.select(*FIELDS)
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").isNotNull()
    leaves = doc.select(
        "doc_id", _tree_of(F.col("source")).alias("tree"), leaf_of().alias("leaf"),
        F.when(changed, leaf_of(text=lowered(F.col("text")))).alias("tampered"),
    )
    rows = placed(leaves, "doc_id").groupBy("tree", "n", _run().alias("idx"))
    runs = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), "leaf", "doc_id", "tampered"))).alias("rows"))
    lone = F.col("n") == 1
    runs = materialize(
        runs.select(
            "tree", F.when(lone, 0).otherwise(1).alias("level"), "idx", "rows", F.ceil(F.col("n") / ARITY).alias("n"),
            F.when(lone, F.col("rows")[0]["leaf"]).otherwise(digest(_joined(F.col("rows.leaf")))).alias("hash"),
        ),
        "merkle-runs",
    )
    nodes = _tower(runs.select("tree", "level", "idx", "hash", "n"))
    paths, root = _paths(nodes)
    known = runs.withColumn("id", _id(F.col("tree"), F.col("level"), F.col("idx"))).join(paths, "id")
    each = known.select("*", F.posexplode("rows").alias("at", "row"))
    own = F.array(_segment(F.col("rows.leaf"), F.col("at")))
    return each.select(
        "row.doc_id", "row.leaf", "subroot", F.lit(root).alias("root"),
        F.when(F.col("level") == 0, F.col("path")).otherwise(F.concat(own, F.col("path"))).alias("path"), "row.tampered",
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(_joined(F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``."""
    made = manifest(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
