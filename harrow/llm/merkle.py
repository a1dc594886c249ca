"""Merkle manifest of a dataset: leaves, trees, proofs and their verification.

Every ``tree`` (a group of rows, or all groups' roots) has nodes numbered from 0.
A level is one equi-join of the nodes with themselves by computed sibling indices
(XOR for two a run, slot offsets for more); of the joined rows those in slot zero
emit the parents. Each level is written once, so that the next reads files and a
lost executor costs a reread. Levels shrink by the arity, so all of them together
cost about as much as the first; once a level's number of rows, which is known by
arithmetic, is small enough, its siblings are broadcast instead of shuffled.

Proofs go the other way: a node's path is its own siblings, then its parent's
path. A row carries the siblings of its own path only, so nothing grows with a
group's size but by the number of levels.

Numbering is a range sort by tree and order, with a salt that splits rows of
equal order; counts per part and tree give the numbers, so no tree, however
large, meets in one task.

Defined results: a null value is ``-`` in its leaf; a null group comes before all
others; a lone leaf is its tree's root; repeated rows are leaves of their own,
equal ones in any order; an empty table gives no rows; other columns, whatever
their names, take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import materialize

#: Bytes of a level that are broadcast at most; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20
#: Columns that a leaf is made of, in order (fixed values).
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(*digests: Column) -> Column:
    """Binary digest of the digests' hex texts, one after another; a null one is nothing."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(hexed(d), F.lit("")) for d in digests]).cast("binary"), 256))


def leaf_of(*values: Column) -> Column:
    """Binary digest of a row: each value with its length in bytes before it, ``-`` for null."""
    texts = [v.cast("string") for v in values]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*sized).cast("binary"), 256))


def tree_of(group: Column) -> Column:
    """A group's name as a tree: ordered as the group bytewise, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in their tree by ``order``, and ``size``, the number of the tree's rows."""
    salted = materialize(rows.withColumn("_salt", F.monotonically_increasing_id()), "merkle-rows")
    keys = ["tree", *order, "_salt"]
    parts = materialize(salted.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "merkle-parts")
    counts = parts.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as parts and trees together
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "_part", before.alias("_before"), F.sum("_n").over(tree).alias("size"))
    inside = F.row_number().over(Window.partitionBy("_part", "tree").orderBy(*order, "_salt"))
    return parts.withColumn("_i", inside).join(offsets, ["tree", "_part"]).withColumn("idx", F.col("_before") + F.col("_i") - 1).drop("_part", "_salt", "_i", "_before")


def held(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` to be broadcast if its ``rows`` fit the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def with_siblings(nodes: DataFrame, rows: int, arity: int) -> DataFrame:
    """``nodes`` with ``others``: the digests of the run's other nodes, one after another by slot; null for a tree's last node."""
    slot = F.col("idx") % arity
    joined, found = nodes, []
    for offset in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + offset) % arity
        at = nodes.where(F.col("size") > 1).select("tree", sibling.alias("idx"), F.col("digest").alias(f"_d{offset}"), slot.alias(f"_s{offset}"))
        joined = joined.join(held(at, rows, 128), ["tree", "idx"], "left")
        found.append(F.struct(F.col(f"_s{offset}").alias("slot"), F.col(f"_d{offset}").alias("digest")))
    by_slot = F.array_sort(F.filter(F.array(*found), lambda s: s["digest"].isNotNull()))
    every = F.aggregate(by_slot, F.lit(b""), lambda all_, s: F.concat(all_, s["digest"]))
    return joined.withColumn("others", F.when(F.col("size") > 1, every)).drop(*[f"_{c}{o}" for o in range(1, arity) for c in "ds"])


def parents(level: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, size, digest) of the next level: what the rows in slot zero emit."""
    first = level.where((F.col("size") > 1) & (F.col("idx") % arity == 0))
    return first.select("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), hashed(F.col("digest"), F.col("others")).alias("digest"))


def grow(leaves: DataFrame, arity: int = 2) -> tuple[list[DataFrame], list[int]]:
    """All levels of all trees, each written, and a bound of each level's rows. ``leaves``: tree, idx, size, digest and what should be kept beside them."""
    sizes = leaves.groupBy("tree").agg(F.max("size").alias("n")).agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()  # one row
    rows, longest, trees = sizes[0] or 0, sizes[1] or 0, sizes[2]
    levels, bounds, nodes = [], [], leaves
    while True:
        levels.append(materialize(with_siblings(nodes, rows, arity), "merkle-level"))
        bounds.append(rows)
        if longest <= 1:
            return levels, bounds
        nodes = parents(levels[-1], arity)
        rows, longest = min(rows, -(-rows // arity) + trees), -(-longest // arity)


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, height, digest): each tree's last node, and the number of levels under it."""
    ends = [level.where("size = 1").select("tree", F.lit(height).alias("height"), "digest") for height, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, ends)


def paths(levels: list[DataFrame], bounds: list[int], arity: int = 2, above: DataFrame | None = None) -> DataFrame:
    """The first level's rows with ``path``: per level, from the leaf up, the siblings' digests one after another; then, if ``above`` (tree, path: a row per tree) is given, what stands over the tree."""
    nothing = F.array().cast("array<binary>")

    def ends(level: DataFrame) -> DataFrame:
        last = level.where("size = 1")
        if above is None:
            return last.withColumn("path", nothing)
        return last.join(held(above, bounds[-1], 128 * len(levels)), "tree").withColumn("path", F.col("path"))

    out = ends(levels[-1])
    for height in range(len(levels) - 2, -1, -1):
        upper = out.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_path"))
        inner = levels[height].where("size > 1").withColumn("_up", F.expr(f"idx div {arity}"))
        joined = inner.join(held(upper, bounds[height + 1], 64 + 48 * (len(levels) + 40)), ["tree", "_up"])
        out = joined.withColumn("path", F.concat(F.array("others"), "_path")).drop("_up", "_path").unionByName(ends(levels[height]))
        if height:
            out = materialize(out.select("tree", "idx", "path"), "merkle-paths")
    return out


def folded(digest: Column, path: Column, idx: Column, height: Column, above: Column, arity: int = 2) -> Column:
    """Binary root that a leaf and its path give: ``idx`` is the leaf's place, ``height`` the levels of its tree, ``above`` the tree's own place over them."""

    def step(state: Column, others: Column) -> Column:
        at = F.when(state["level"] == height, above).otherwise(state["at"])
        left = (at % arity * 32).cast("int")
        run = F.concat(F.substring(others, F.lit(1), left), state["digest"], F.substring(others, left + 1, F.length(others)))
        return F.struct((state["level"] + 1).alias("level"), F.floor(at / arity).alias("at"), F.unhex(F.sha2(hexed(run).cast("binary"), 256)).alias("digest"))

    start = F.struct(F.lit(0).alias("level"), idx.alias("at"), digest.alias("digest"))
    return F.aggregate(path, start, step)["digest"]


def manifest(rows: DataFrame, order: list[str], arity: int = 2) -> DataFrame:
    """Rows (tree, digest, and others that are kept) with subroot, root, path, height, idx and top: a tree per group, and one over all groups' roots.

    ``order`` names columns beside ``digest`` that order a tree's leaves; equal ones are ordered by digest.
    """
    levels, bounds = grow(numbered(rows, [*order, "digest"]), arity)
    subroots = materialize(roots(levels), "merkle-subroots")
    tops = numbered(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"), "height"), ["name"])
    top_levels, top_bounds = grow(tops, arity)
    over = paths(top_levels, top_bounds, arity)
    root = roots(top_levels).select(F.lit("").alias("tree"), F.col("digest").alias("root"))
    over = over.join(F.broadcast(root), "tree")  # one row
    over = materialize(over.select(F.col("name").alias("tree"), F.col("idx").alias("top"), "height", F.col("digest").alias("subroot"), "root", "path"), "merkle-tops")
    found = paths(levels, bounds, arity, over.select("tree", "path"))
    return found.join(held(over.drop("path"), top_bounds[0], 256), "tree").drop("others", "size")
