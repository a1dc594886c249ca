"""Connected components of an edge table, by contraction.

Each round every node points to its smallest smaller neighbour, pointers are
doubled until they end in roots, and edges are rewritten between roots. Labels
end at the smallest node of a component. All steps are joins and map-side
combined aggregates on tables written to the shared folder, so a node with very
many edges is only a skewed join, and a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.sources.scratch import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) to (node, root), one row per node that is not itself its component's smallest."""
    name = "components"
    edges = materialize(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), name
    )
    labels = None
    while True:
        parent = materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), name)
        while not parent.isEmpty():
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            parent = materialize(
                parent.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), name
            )
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        parent = parent.select("node", "root")
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(parent)
        of_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(of_b, "b").join(of_a, "a", "left").select(F.coalesce("ra", "a").alias("a"), F.col("rb").alias("b"))
        edges = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
        labels = materialize(labels, name)
        if edges.isEmpty():
            return labels
