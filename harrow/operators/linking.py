"""Entity linking: soft edges, guarded merges, campaigns, chains, walks.

Campaigns group sources by hard edges (a shared identity value), then by soft
edges (similar rare shapes) under a guard, then leave claims (values named
together) for sources that have no group. Output depends on addresses only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from harrow.operators.graph import components
from harrow.operators.joins import RARE_CAP
from harrow.operators.stats import DAY, beside, keep_top
from harrow.sources.scratch import materialize

#: Soft edge: least score alone, with support, shared rare shapes, days between, shapes for an order, untied pairs for an order.
ALONE, SUPPORTED, SHARED, APART, ORDER_SHAPES, ORDER_PAIRS = 0.60, 0.45, 3, 30, 8, 28
#: An order at or above the first supports a pair, at or below the second it forbids the edge; rarest shared shapes that it looks at.
ORDER, VETO, ORDER_MOST = 0.5, -0.3, 500
#: Newest shapes of a source, and joiner values of a source, that are considered.
SHAPES_PER_SOURCE, JOINERS_PER_SOURCE = 2000, 16
#: Soft links that two groups of two or more need to merge.
GUARD = 2


def shape_weights(source_shapes: DataFrame) -> DataFrame:
    """(shape, df, weight): ln(1 + N / df)."""
    n = source_shapes.select(F.countDistinct("ip").alias("n"))
    by = source_shapes.groupBy("shape").agg(F.countDistinct("ip").alias("df"))
    return beside(by, n).select("shape", "df", F.round(F.log1p(F.col("n") / F.col("df")), 9).alias("weight"))


def newest_shapes(source_shapes: DataFrame, most: int = SHAPES_PER_SOURCE) -> DataFrame:
    """(ip, shape, first, last): each source's newest shapes."""
    own = source_shapes.groupBy("ip", "shape").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return keep_top(own, ["ip"], [F.desc("last"), F.col("shape")], most)


def left_out(rows: DataFrame, value: str, most: int) -> DataFrame:
    """(ip, left_out): sources with more values than are considered, and by how many."""
    by = rows.select("ip", value).distinct().groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    return by.where(F.col("n") > most).select("ip", (F.col("n") - most).alias("left_out"))


def _shared(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, shape, ta, tb, df, weight): the shapes that both ends of each pair asked for."""
    a, b = own.select(F.col("ip").alias("a"), "shape", F.col("first").alias("ta"), "df", "weight"), own.select(F.col("ip").alias("b"), "shape", F.col("first").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, ["b", "shape"])


def concordance(pair: np.ndarray, place: np.ndarray, ta: np.ndarray, tb: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per pair, over all two of its shapes: how many more agree in order than disagree, and how many are tied at neither end.

    ``place`` is a shape's place in its pair. Disagreements are inversions, which
    merging counts: of two halves of a block, what stands left of a smaller value.
    All pairs are merged at once, so the work is rows times the logarithm squared.
    """
    twos = lambda n: n * (n - 1) // 2

    def tied(*keys: np.ndarray) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        at = np.flatnonzero(new)
        return np.bincount(keys[0][order][at], weights=twos(np.diff([*at, len(order)])), minlength=pairs).astype(np.int64)

    size = np.bincount(pair, minlength=pairs)
    untied = twos(size) - tied(pair, ta) - tied(pair, tb) + tied(pair, ta, tb)
    order = np.lexsort((tb, ta, pair))
    pair, place, tb = pair[order], place, tb[order]
    turned, width = np.zeros(pairs, np.int64), 1
    while width < size.max(initial=0):
        half = place // width
        merged = np.lexsort((half % 2, tb, half // 2, pair))
        left = half[merged] % 2 == 0
        # left ones up to here, less those of earlier blocks; and all left ones of the block
        block = np.ones(len(merged), bool)
        block[1:] = (pair[merged][1:] != pair[merged][:-1]) | ((half // 2)[merged][1:] != (half // 2)[merged][:-1])
        at = np.cumsum(block) - 1
        lefts = np.bincount(at, weights=left).astype(np.int64)
        upto = np.cumsum(left) - (np.cumsum(lefts) - lefts)[at]
        more = (lefts[at] - upto)[~left]
        turned += np.bincount(pair[merged][~left], weights=more, minlength=pairs).astype(np.int64)
        width *= 2
    return untied - 2 * turned, untied


@F.pandas_udf(StructType([StructField("s", LongType()), StructField("n", LongType())]))
def agreement(shapes: pd.Series) -> pd.DataFrame:
    """Concordance of each pair's array<struct<ta, tb>>."""
    sizes = np.array([len(x) for x in shapes], np.int64)
    rows = [(r["ta"], r["tb"]) for x in shapes for r in x]
    ta, tb = np.array(rows, np.int64).reshape(-1, 2).T
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    s, n = concordance(np.repeat(np.arange(len(sizes)), sizes), place, ta, tb, len(sizes))
    return pd.DataFrame({"s": s, "n": n})


def _order(shared: DataFrame, most: int) -> DataFrame:
    rows = keep_top(shared, ["a", "b"], [F.col("df"), F.col("shape")], most)  # ``most`` at most in an array
    counts = rows.groupBy("a", "b").agg(F.collect_list(F.struct("ta", "tb")).alias("x")).where(F.size("x") > 1).select("a", "b", agreement("x").alias("c"))
    shapes = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shapes"))
    enough = (F.col("c.n") >= ORDER_PAIRS) & (F.col("shapes") >= ORDER_SHAPES)
    return counts.join(shapes, ["a", "b"]).select("a", "b", F.when(enough, F.col("c.s") / F.col("c.n")).alias("order"))


def order_agreement(pairs: DataFrame, source_shapes: DataFrame, most: int = ORDER_MOST) -> DataFrame:
    """(a, b, order): concordance of first-asked order over the rarest shared shapes; ties count for nothing; null for too few."""
    own = newest_shapes(source_shapes).join(shape_weights(source_shapes), "shape")
    return _order(_shared(pairs, own), most)


def scored_pairs(source_shapes: DataFrame, fingerprints: DataFrame, supported: float = SUPPORTED, shared: int = SHARED, cap: int = RARE_CAP) -> DataFrame:
    """(a, b, score, shared, tls, order): the candidates, pairs that share enough rare shapes and score ``supported`` or more.

    The score is the weighted Jaccard of all shapes; the union's weight is
    wa + wb - shared. Pairs come from rare shapes only; common ones weigh in the
    score. ``tls`` is true for a shared fingerprint, else null.
    """
    own = newest_shapes(source_shapes)
    own = materialize(own.join(shape_weights(own.select("ip", "shape")), "shape"), "source-shapes")
    rare = own.where(F.col("df").between(2, cap))
    pairs = rare.select(F.col("ip").alias("a"), "shape").join(rare.select(F.col("ip").alias("b"), "shape"), "shape").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("rare")).where(F.col("rare") >= shared)
    total = own.groupBy("ip").agg(F.sum("weight").alias("w"), F.min("first").alias("first"), F.max("last").alias("last"))
    side = lambda c: total.select(F.col("ip").alias(c), F.col("w").alias(f"w{c}"), F.col("first").alias(f"f{c}"), F.col("last").alias(f"l{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.greatest("fa", "fb") - F.least("la", "lb") <= APART * DAY)
    weight = _shared(near, own).groupBy("a", "b").agg(F.sum("weight").alias("ws"), F.count(F.lit(1)).alias("shared"))
    scored = near.join(weight, ["a", "b"]).withColumn("score", F.col("ws") / (F.col("wa") + F.col("wb") - F.col("ws"))).where(F.col("score") >= supported)
    scored = materialize(scored.select("a", "b", "score", "shared"), "soft-pairs")
    prints = fingerprints.select("ip", "fingerprint").distinct()
    same = scored.select("a", "b").join(prints.withColumnRenamed("ip", "a"), "a").join(prints.withColumnRenamed("ip", "b"), ["b", "fingerprint"], "left_semi").select("a", "b").distinct().withColumn("tls", F.lit(True))
    return scored.join(same, ["a", "b"], "left").join(_order(_shared(scored, own), ORDER_MOST), ["a", "b"], "left")


def is_soft_edge(alone: float = ALONE, veto: float | None = VETO):
    """Whether a candidate is an edge: an order that is turned round forbids it (``veto``; None: never); an equal one, or a shared fingerprint, supports it."""
    support = F.coalesce("tls", F.lit(False)) | (F.coalesce("order", F.lit(0.0)) >= ORDER)
    edge = (F.col("score") >= alone) | support
    return edge if veto is None else edge & F.coalesce(F.col("order") > veto, F.lit(True))


def soft_edges(
    source_shapes: DataFrame, fingerprints: DataFrame, alone: float = ALONE, supported: float = SUPPORTED, shared: int = SHARED, cap: int = RARE_CAP, veto: float | None = VETO
) -> DataFrame:
    """(a, b, score, shared) of the candidates that are edges."""
    return scored_pairs(source_shapes, fingerprints, supported, shared, cap).where(is_soft_edge(alone, veto)).select("a", "b", "score", "shared")


def groups_of(edges: DataFrame) -> DataFrame:
    """(ip, grp) of all sources on an edge; grp is the smallest address."""
    labels = components(edges)
    roots = labels.select(F.col("root").alias("ip"), F.col("root").alias("grp")).distinct()
    return labels.select(F.col("node").alias("ip"), F.col("root").alias("grp")).unionByName(roots)


def merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: each round merges the two groups with most soft links that reach min(size, size, GUARD); ties by name.

    A heap holds the pairs that are able to merge; a pair is put there again
    when its links change, and what is outdated is passed over. Nearly linear in
    the block's links.
    """
    size = {g: n for g, n in zip([*pdf.ga, *pdf.gb], [*pdf.na, *pdf.nb])}
    near: dict = {g: {} for g in size}
    for a, b, n in zip(pdf.ga, pdf.gb, pdf.links):
        near[a][b] = near[b][a] = near[a].get(b, 0) + n
    heap = [(-n, a, b) for a, of in near.items() for b, n in of.items() if a < b]
    heapq.heapify(heap)
    to: dict = {}
    while heap:
        n, a, b = heapq.heappop(heap)
        if near.get(a, {}).get(b) != -n or -n < min(size[a], size[b], GUARD):
            continue
        to[b] = a
        size[a] += size.pop(b)
        del near[a][b]
        for x, links in near.pop(b).items():
            if x != a:
                del near[x][b]
                near[a][x] = near[x][a] = near[a].get(x, 0) + links
                heapq.heappush(heap, (-near[a][x], *sorted((a, x))))

    def end(g):
        while g in to:
            g = to[g]
        return g

    groups = sorted({*pdf.ga, *pdf.gb})
    return pd.DataFrame({"grp": groups, "merged": [end(g) for g in groups]})


def guarded_merge(hard_groups: DataFrame, soft: DataFrame) -> DataFrame:
    """(ip, grp): groups joined over soft links under the guard. Sources without a hard group are groups of one.

    The rule merges one pair a round, the one with most links. Two groups with
    GUARD or more links between them merge under it in any order, as their links
    only grow, so those are contracted by joins, all at once and until none is
    left. What remains are single links; what they do not connect is independent,
    so each of these blocks runs the sequential rule by itself.
    """
    soft, hard_groups = materialize(soft.select("a", "b"), "soft-edges"), materialize(hard_groups, "hard-groups")
    ends = soft.select(F.col("a").alias("ip")).union(soft.select("b")).distinct()
    every = ends.join(hard_groups, "ip", "full").select("ip", F.coalesce("grp", "ip").alias("grp"))
    rename = lambda df, to, c: df.join(to.select(F.col("ip").alias(c), F.col("grp").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    links = rename(rename(soft.select(F.col("a").alias("ga"), F.col("b").alias("gb")).withColumn("links", F.lit(1)), every, "ga"), every, "gb")
    add = lambda df: df.where("ga <> gb").groupBy(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).agg(F.sum("links").alias("links"))
    every, between = materialize(every, "group-members"), materialize(add(links), "group-links")
    while not (strong := between.where(F.col("links") >= GUARD)).isEmpty():
        to = materialize(groups_of(strong.select(F.col("ga").alias("a"), F.col("gb").alias("b"))), "group-merges")
        every, between = materialize(rename(every, to, "grp"), "group-members"), materialize(add(rename(rename(between, to, "ga"), to, "gb")), "group-links")
    size = every.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    block = groups_of(between.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    rows = between.join(size.select(F.col("grp").alias("ga"), F.col("n").alias("na")), "ga").join(size.select(F.col("grp").alias("gb"), F.col("n").alias("nb")), "gb").join(block.select(F.col("ip").alias("ga"), F.col("grp").alias("block")), "ga")
    kind = dict(every.dtypes)["grp"]
    merged = rows.groupBy("block").applyInPandas(merge_block, f"grp {kind}, merged {kind}")
    return every.join(merged, "grp", "left").select("ip", F.coalesce("merged", "grp").alias("grp"))


def group_loose(sightings: DataFrame, grouped: DataFrame, least: int = GUARD, per_source: int = JOINERS_PER_SOURCE) -> DataFrame:
    """(ip, grp): ungrouped sources by the values that they name.

    Of each source the values that others name too count, the newest
    ``per_source`` (``left_out`` tells what is not considered). Two values
    connect when ``least`` sources and a tenth of the larger's name both.
    Connected values are a cloud; clouds of the same sources are one. A source
    in several goes to the largest, ties to the one with the smallest source.
    In a cloud, sources that share one of its values are a group.
    """
    own = sightings.groupBy("ip", "value").agg(F.max("t").alias("t")).join(grouped.select("ip"), "ip", "left_anti")
    shared = own.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = materialize(keep_top(own.join(shared.select("value"), "value"), ["ip"], [F.desc("t"), F.col("value")], per_source).select("ip", "value"), "loose-values")
    n = own.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    pairs = own.select("ip", F.col("value").alias("a")).join(own.select("ip", F.col("value").alias("b")), "ip").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    both = pairs.join(n.select(F.col("value").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("value").alias("b"), F.col("n").alias("nb")), "b")
    tied = groups_of(both.where(F.col("both") >= F.greatest(F.lit(least), F.ceil(F.greatest("na", "nb") / 10))).select("a", "b")).select(F.col("ip").alias("value"), F.col("grp").alias("c"))
    clouds = own.join(tied, "value", "left").select("ip", "value", F.coalesce("c", "value").alias("c"))
    members = clouds.select("c", "ip").distinct()
    seen = members.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.min("ip").alias("low"), F.sum(F.xxhash64("ip").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("ip", F.lit(1))).alias("x"))
    same = seen.groupBy("size", "low", "h", "x").agg(F.min("c").alias("cloud"))  # equal sets of sources by two hashes of the whole set
    names = seen.join(same, ["size", "low", "h", "x"]).select("c", "cloud", "size", "low")
    owner = keep_top(members.join(names, "c").select("ip", "cloud", "size", "low").distinct(), ["ip"], [F.desc("size"), F.col("low"), F.col("cloud")], 1).select("ip", "cloud")
    kept = clouds.join(names.select("c", "cloud"), "c").join(owner, ["ip", "cloud"]).select("cloud", "value", "ip").distinct()
    anchor = kept.groupBy("cloud", "value").agg(F.min("ip").alias("a"))
    return groups_of(kept.join(anchor, ["cloud", "value"]).where("ip <> a").select("a", F.col("ip").alias("b")))


def joiner_star_edges(sightings: DataFrame, grouped: DataFrame) -> DataFrame:
    """n - 1 claim edges from the oldest source of each value and group."""
    own = sightings.groupBy("value", "ip").agg(F.min("t").alias("t")).join(grouped, "ip")
    anchor = own.groupBy("value", "grp").agg(F.min_by("ip", F.struct("t", "ip")).alias("anchor"))
    return own.join(anchor, ["value", "grp"]).where("ip <> anchor").select("value", "grp", F.col("anchor").alias("a"), F.col("ip").alias("b"))


def campaigns(grouped: DataFrame, rollup: DataFrame) -> DataFrame:
    """Per group: key (its earliest source), number by (first seen, key), size and span."""
    rows = grouped.join(rollup.select("ip", "first_seen", "last_seen"), "ip")
    by = rows.groupBy("grp").agg(F.min_by("ip", F.struct("first_seen", "ip")).alias("key"), F.count(F.lit(1)).alias("size"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return numbered(by, ["first_seen", "key"], "number")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Dense numbers from 1 in a global order: a range sort, counts per part, then numbers inside each part. The parts are written once, as both passes must see the same."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_i", inside).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def campaign_report(hard: DataFrame, candidates: DataFrame, excluded: DataFrame, alone: float = ALONE, veto: float | None = VETO) -> DataFrame:
    """(class, edges, withheld): what a pass over the campaigns did; a class that has nothing has no row.

    ``hard`` and ``soft`` count edges; withheld are those between groups that the
    guarded merge left apart. ``candidate``: scored pairs, withheld if they are no
    edge. ``ordered``: those with an order, withheld if it is turned round.
    ``excluded``: values on too many sources, all withheld. ``candidates`` is a
    written table (``scored_pairs``), as it is read several times.
    """
    edge = is_soft_edge(alone, veto)
    soft = candidates.where(edge).select("a", "b")
    grouped = materialize(guarded_merge(groups_of(hard), soft), "report-groups")
    of = lambda c: grouped.select(F.col("ip").alias(c), F.col("grp").alias(f"g{c}"))
    every = hard.select("a", "b", F.lit("hard").alias("class")).unionByName(soft.withColumn("class", F.lit("soft")))
    rows = every.join(of("a"), "a", "left").join(of("b"), "b", "left").select("class", (~F.col("ga").eqNullSafe(F.col("gb"))).alias("withheld"))
    turned = F.lit(False) if veto is None else F.col("order") <= veto
    rows = rows.unionByName(candidates.select(F.lit("candidate").alias("class"), (~edge).alias("withheld")))
    rows = rows.unionByName(candidates.where(F.col("order").isNotNull()).select(F.lit("ordered").alias("class"), turned.alias("withheld")))
    rows = rows.unionByName(excluded.select(F.lit("excluded").alias("class"), F.lit(True).alias("withheld")))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("edges"), F.count_if("withheld").alias("withheld"))


def campaign_tuning(source_shapes: DataFrame, fingerprints: DataFrame, hard: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """The same job for every (alone, supported): soft edges, groups and members."""
    groups = materialize(groups_of(hard), "hard-groups")
    out = None
    for alone, supported in grid:
        soft = soft_edges(source_shapes, fingerprints, alone, supported)
        merged = guarded_merge(groups, soft)
        row = merged.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"), F.max("n").alias("largest")).select(F.lit(alone).alias("alone"), F.lit(supported).alias("supported"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def chains(pairs: DataFrame, sightings: DataFrame, least: int = 2) -> DataFrame:
    """Components of values that max(2, ceil(max / 10)) sources name together: sources, inputs and span; key is the oldest value."""
    n = sightings.groupBy("value").agg(F.countDistinct("ip").alias("n"))
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both")).join(n.select(F.col("value").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("value").alias("b"), F.col("n").alias("nb")), "b")
    edges = both.where(F.col("both") >= F.greatest(F.lit(least), F.ceil(F.greatest("na", "nb") / 10))).select("a", "b")
    members = groups_of(edges).select(F.col("ip").alias("value"), F.col("grp").alias("chain"))
    rows = sightings.join(members, "value")
    return rows.groupBy("chain").agg(F.min_by("value", F.struct("t", "value")).alias("key"), F.countDistinct("value").alias("pieces"), F.countDistinct("ip").alias("sources"), F.countDistinct("source_uid").alias("inputs"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


def chains_list(found: DataFrame, chain_sources: DataFrame, members: DataFrame) -> DataFrame:
    """Chains with how many campaigns their sources are in."""
    by = chain_sources.join(members, "ip").groupBy("chain").agg(F.countDistinct("campaign").alias("campaigns"))
    return found.join(by, "chain", "left").na.fill(0, ["campaigns"])


#: Sources from which a value is a hub, and nodes of a walk at most (fixed values).
GROUP_AT, GRAPH_MOST = 25, 400


def neighbourhood(sightings: DataFrame, focus, depth: int = 3, hub: int = GROUP_AT, most: int = GRAPH_MOST) -> DataFrame:
    """(kind, node, hops): a walk over sources and values from one source, ``depth`` hops, each from a source to its values or from a value to its sources.

    A value on more than ``hub`` sources is not walked through: it leads to one
    ``group`` node that stands for them. The walk ends at ``most`` nodes; within
    a hop, groups come before sources before values, each by their text. What a
    hop leads to is at most that many rows, so every join meets a small table.
    """
    own = materialize(sightings.where("value IS NOT NULL AND ip IS NOT NULL").select(F.col("ip").cast("string").alias("ip"), F.col("value").cast("string").alias("value")).distinct(), "sighted")
    start = own.where(F.col("ip") == str(focus)).select(F.lit("ip").alias("kind"), F.col("ip").alias("node"), F.lit(0).alias("hops")).limit(1)
    seen = frontier = materialize(start, "walk")
    for hop in range(1, depth + 1):
        values = frontier.where("kind = 'item'").select(F.col("node").alias("value"))
        held = own.join(F.broadcast(values), "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))  # ``most`` rows at most
        through = own.join(F.broadcast(held.where(F.col("n") <= hub).select("value")), "value").select(F.lit("ip").alias("kind"), F.col("ip").alias("node"))
        groups = held.where(F.col("n") > hub).select(F.lit("group").alias("kind"), F.col("value").alias("node"))
        sources = frontier.where("kind = 'ip'").select(F.col("node").alias("ip"))
        items = own.join(F.broadcast(sources), "ip").select(F.lit("item").alias("kind"), F.col("value").alias("node"))
        found = groups.unionByName(through).unionByName(items).distinct().join(F.broadcast(seen.select("kind", "node")), ["kind", "node"], "left_anti")
        frontier = materialize(found.orderBy("kind", "node").limit(most - seen.count()).withColumn("hops", F.lit(hop)), "walk")
        seen = seen.unionByName(frontier)
    return seen


def campaign_graph(edges: DataFrame, grouped: DataFrame, cap: int = 2000) -> DataFrame:
    """Edges inside groups, the best scored of each group."""
    of = lambda c: grouped.select(F.col("ip").alias(c), F.col("grp").alias(f"g{c}"))
    inside = edges.join(of("a"), "a").join(of("b"), "b").where("ga = gb").select("a", "b", "score", F.col("ga").alias("grp"))
    return keep_top(inside, ["grp"], [F.desc("score"), F.col("a"), F.col("b")], cap)


def edge_detail(edges: DataFrame, source_shapes: DataFrame, n: int = 100) -> DataFrame:
    """The rarest shared shapes of each edge."""
    weights = shape_weights(source_shapes)
    own = source_shapes.select("ip", "shape").distinct()
    shared = edges.select("a", "b").join(own.select(F.col("ip").alias("a"), "shape"), "a").join(own.select(F.col("ip").alias("b"), "shape"), ["b", "shape"]).join(weights.select("shape", "df"), "shape")
    return keep_top(shared, ["a", "b"], [F.col("df"), F.col("shape")], n)


#: How far something is confirmed, the furthest first (fixed values).
MARKS = ("seen", "external", "claimed", "gap", "dead end")


def chain_stages(chain_values: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(chain, stage, label, requests, mark): each stage is a table of (value, label, id, mark); of several marks the furthest is given, one that is not known is none."""
    out, place = None, F.array_position(F.array(*map(F.lit, MARKS)), F.col("mark"))
    for stage, rows in stages.items():
        furthest = F.min(F.when(place > 0, place))
        part = chain_values.join(rows, "value").groupBy("chain", F.lit(stage).alias("stage"), "label").agg(F.countDistinct("id").alias("requests"), furthest.alias("mark"))
        part = part.withColumn("mark", F.get(F.array(*map(F.lit, MARKS)), F.col("mark").cast("int") - 1))
        out = part if out is None else out.unionByName(part)
    return out
