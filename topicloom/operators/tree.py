"""Dendrograms as node tables ``(cluster_id, size, density, parent_id, left_id, right_id)``.

A singleton has size 1 and its point id as ``cluster_id``. Nodes do not hold their points: what lies on a
path to the root is folded by pointer doubling, in log2(depth) joins of one row per node whatever the
shape of the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.scale import checkpoint

# Fixed value: the score of a child with density 0, the smallest positive double.
SMALLEST = 4.9e-324

# Fixed value: the last cut of a sweep, above every distance of normalised vectors.
LAST_CUT = 2.0

LABELLED_TOPICS = 10

PATH_BLOCK = 256  # levels of a path that meet the nodes below it in one task

RADIX = 8  # leaves are summed in aligned blocks of RADIX, RADIX^2, ... places


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's child."""
    children = nodes.filter("size > 1").select(F.explode(F.array("left_id", "right_id")).alias("cluster_id"))
    return nodes.join(children, "cluster_id", "left_anti")


def singletons(nodes: DataFrame) -> DataFrame:
    return nodes.filter("size = 1")


def wire_parents(nodes: DataFrame) -> DataFrame:
    """Fill ``parent_id`` from the children's side."""
    edges = nodes.filter("size > 1").select(
        F.col("cluster_id").alias("parent_id"), F.explode(F.array("left_id", "right_id")).alias("cluster_id")
    )
    return nodes.drop("parent_id").join(edges, "cluster_id", "left").select(
        "cluster_id", "size", "density", "parent_id", "left_id", "right_id"
    )


def fold_to_root(state: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """``state(node, ptr, acc, leaf)`` -> ``(node, acc)`` with ``acc`` combined along the path of ``ptr`` to the root.

    Each round doubles the distance that ``ptr`` spans. Finished rows leave the join. Leaves, half of a tree, are nobody's
    ``ptr`` and join once at the end.
    """
    whole = checkpoint(state)
    state = whole.where("not leaf").drop("leaf")
    while not (going := state.filter("ptr is not null")).isEmpty():
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("acc").alias("_acc"))
        moved = going.join(ahead, "ptr", "left").select(
            "node", F.col("_ptr").alias("ptr"), combine(F.col("acc"), F.col("_acc")).alias("acc")
        )
        state = checkpoint(moved.unionByName(state.filter("ptr is null")))
    above = state.select(F.col("node").alias("ptr"), F.col("acc").alias("_acc"))
    leaves = whole.where("leaf")
    low = leaves.where("ptr is not null").join(above, "ptr", "left").select("node", combine(F.col("acc"), F.col("_acc")).alias("acc"))
    return state.select("node", "acc").unionByName(low).unionByName(leaves.where("ptr is null").select("node", "acc"))


def _leaf() -> Column:
    return F.coalesce(F.col("size") == 1, F.lit(False)).alias("leaf")


def heavy_paths(nodes: DataFrame) -> DataFrame:
    """``(cluster_id, path, down)``: every node lies on one path, ``down`` levels below the path's head ``path``.

    A path goes on to the larger child (the left one of two equals), so the way from any node to the root touches at most
    log2(n) paths, whatever the shape of the tree. One row per node; the table is built once per tree.
    """
    children = nodes.select("cluster_id", "parent_id", "size")
    sides = nodes.where("size > 1").select(F.col("cluster_id").alias("parent_id"), "left_id", F.col("size").alias("_whole"))
    both = children.join(sides, "parent_id", "left")
    half = F.col("size") * 2
    heavy = (half > F.col("_whole")) | ((half == F.col("_whole")) & (F.col("cluster_id") == F.col("left_id")))
    own = F.struct(F.lit(0).cast("long").alias("down"), F.col("cluster_id").alias("path"))
    up = F.struct(F.lit(1).cast("long").alias("down"), F.col("parent_id").alias("path"))
    state = both.select(
        F.col("cluster_id").alias("node"), F.when(heavy, F.col("parent_id")).alias("ptr"), F.when(heavy, up).otherwise(own).alias("acc"), _leaf()
    )
    found = fold_to_root(state, lambda a, b: F.struct((a["down"] + b["down"]).alias("down"), b["path"].alias("path")))
    return checkpoint(found.select(F.col("node").alias("cluster_id"), "acc.path", "acc.down"))


def stretches(nodes: DataFrame, start: DataFrame, paths: DataFrame) -> DataFrame:
    """``(node, path, down, least, hops, child, had)``: the way up from ``start(cluster_id[, top])``, one row per path it touches.

    The node's ancestors on a path are those from ``down`` to ``least`` levels below the path's head, the first of them
    ``hops`` levels above the node; ``child`` of size ``had`` is below that one on the way, null at the node itself. With ``top``, an ancestor, the way ends there. At most log2(n) rows per start node.
    """
    # where a path ends, its head's parent lies on the next one
    heads = paths.where("down = 0").select("cluster_id").join(nodes.select("cluster_id", "parent_id", "size"), "cluster_id")
    above = paths.select(F.col("cluster_id").alias("parent_id"), F.col("path").alias("_path"), F.col("down").alias("_down"))
    next_ = checkpoint(heads.join(above, "parent_id").select(F.col("cluster_id").alias("path"), "_path", "_down", F.col("size").alias("_had")))
    layer = start.select(F.col("cluster_id").alias("node"), "cluster_id", F.col("top") if "top" in start.columns else F.lit(None).cast("long").alias("top"))
    ends = paths.select(F.col("cluster_id").alias("top"), F.col("path").alias("_end"), F.col("down").alias("_least"))
    layer = layer.join(paths, "cluster_id").join(ends, "top", "left")
    layer = checkpoint(layer.select("node", "path", "down", F.lit(0).cast("long").alias("hops"), "_end", "_least", *(F.lit(None).cast("long").alias(c) for c in ("child", "had"))))
    done = []
    while True:
        last = F.coalesce(F.col("path") == F.col("_end"), F.lit(False))
        done.append(layer.select("node", "path", "down", F.when(last, F.col("_least")).otherwise(0).cast("long").alias("least"), "hops", "child", "had"))
        going = layer.where(~last).join(next_, "path")
        layer = checkpoint(
            going.select(
                "node", F.col("_path").alias("path"), F.col("_down").alias("down"), (F.col("hops") + F.col("down") + 1).alias("hops"), "_end", "_least",
                F.col("path").alias("child"), F.col("_had").cast("long").alias("had"),
            )
        )
        if layer.isEmpty():
            return reduce(DataFrame.unionByName, done)


def ancestors(nodes: DataFrame, start: DataFrame | None = None, paths: DataFrame | None = None, told: Sequence[str] = (), steps: bool = False) -> DataFrame:
    """``(node, ancestor, hops, *told)`` of the start nodes ``(cluster_id[, top])`` (default: singletons), the node itself at 0 hops.

    Only :func:`stretches` are written; their nodes are laid out in the last join, for the nodes asked for. A long
    path is cut into blocks, so that its nodes meet the stretches in many tasks. Columns ``told`` of the ancestors, and with
    ``steps`` the node below on the way and its size (``child, had``), lie beside the paths, so that the
    laid out rows, points x depth, need not be shuffled for them.
    """
    given = paths if paths is not None else heavy_paths(nodes)
    ways = stretches(nodes, singletons(nodes) if start is None else start, given)
    block = F.explode(F.sequence(F.floor(F.col("least") / PATH_BLOCK), F.floor(F.col("down") / PATH_BLOCK))).alias("_block")
    asked = ways.select("node", "path", F.col("down").alias("_from"), "least", "hops", "child", "had", block)
    there = given.join(nodes.select("cluster_id", *told), "cluster_id") if told else given
    if steps:
        inside = given.where("down > 0").join(nodes.select("cluster_id", "parent_id", F.col("size").alias("_size")), "cluster_id")
        below = inside.select(F.col("parent_id").alias("_ancestor"), F.col("cluster_id").alias("_below"), "_size")
        there = there.join(below, F.col("cluster_id") == F.col("_ancestor"), "left").drop("_ancestor")
    there = there.withColumnRenamed("cluster_id", "ancestor").withColumn("_block", F.floor(F.col("down") / PATH_BLOCK))
    met = asked.join(there, ["path", "_block"]).where((F.col("down") <= F.col("_from")) & (F.col("down") >= F.col("least")))
    lower = F.col("down") < F.col("_from")
    way = [F.when(lower, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("child", "_below"), ("had", "_size"))] if steps else []
    return met.select("node", "ancestor", (F.col("hops") + F.col("_from") - F.col("down")).cast("int").alias("hops"), *told, *way)


def with_parent(nodes: DataFrame) -> DataFrame:
    """Add ``parent_size`` and ``parent_density``; null for the root."""
    parent = nodes.filter("size > 1").select(
        F.col("cluster_id").alias("parent_id"), F.col("size").alias("parent_size"), F.col("density").alias("parent_density")
    )
    return nodes.join(parent, "parent_id", "left")


def _is_cut(g: Column) -> Column:
    inner = (F.col("density") < g) & (F.col("size") > 1) & (F.col("parent_density") >= g)
    return F.when(F.col("parent_id").isNull(), F.col("density") < g).otherwise(inner)


def cut(nodes: DataFrame, g: float) -> DataFrame:
    """Largest nodes of density below ``g``: their parent is at ``g`` or above, or they are the root."""
    return with_parent(nodes).filter(_is_cut(F.lit(g))).select("cluster_id", "size", "density")


def by_size(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("size"), "cluster_id")


def sweep(step: float = 0.05, until: float = 0.5, last: float = LAST_CUT) -> list[float]:
    """Cuts step, 2 step, ... below ``until``, then the last."""
    cuts, g = [], step
    while g < until:
        cuts.append(g)
        g += step
    return [*cuts, last]


def cut_sweep(nodes: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """``(cut, cluster_id, size, density)`` of all cuts in one pass over the nodes."""
    hit = F.filter(F.array(*[F.lit(float(g)) for g in cuts]), _is_cut)
    return with_parent(nodes).select(F.explode(hit).alias("cut"), "cluster_id", "size", "density")


def _cut_above(nodes: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """``(node, acc)``: for every cut the nearest ancestor that is cut there, as an array in cut order."""
    marks = with_parent(nodes).select(
        F.col("cluster_id").alias("ptr"), F.array(*[_is_cut(F.lit(float(g))) for g in cuts]).alias("_marks")
    )
    state = (
        nodes.select(F.col("cluster_id").alias("node"), F.col("parent_id").alias("ptr"), _leaf())
        .join(marks, "ptr", "left")
        .select("node", "ptr", "leaf", F.transform("_marks", lambda m: F.when(m, F.col("ptr"))).alias("acc"))
    )
    none = F.array(*[F.lit(None).cast("long") for _ in cuts])
    state = state.withColumn("acc", F.coalesce("acc", none))
    return fold_to_root(
        state, lambda a, b: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)))
    )


def _unpacked(found: DataFrame, cuts: Sequence[float]) -> DataFrame:
    at = F.arrays_zip(F.array(*[F.lit(float(g)) for g in cuts]).alias("cut"), F.col("acc").alias("cluster_id"))
    return found.select("node", F.inline(at)).filter("cluster_id is not null")


def under_cuts(nodes: DataFrame, cuts: Sequence[float], only_points: bool = True) -> DataFrame:
    """``(cut, cluster_id, node)``: the points (or all nodes) below each cut node.

    Where densities fall towards the root cut nodes can be nested; those are followed upwards too.
    """
    above = _cut_above(nodes, cuts)
    wanted = above.join(singletons(nodes).select(F.col("cluster_id").alias("node")), "node", "left_semi") if only_points else above
    reached = _unpacked(wanted, cuts)
    step = _unpacked(above, cuts).select("cut", F.col("node").alias("cluster_id"), F.col("cluster_id").alias("_next"))
    cut_nodes = cut_sweep(nodes, cuts).select("cut", "cluster_id")
    step = checkpoint(step.join(cut_nodes, ["cut", "cluster_id"], "left_semi"))
    result = reached
    while not step.isEmpty():
        reached = checkpoint(
            reached.join(step, ["cut", "cluster_id"]).select("node", "cut", F.col("_next").alias("cluster_id"))
        )
        if reached.isEmpty():
            break
        result = result.unionByName(reached)
    if not only_points:
        result = result.unionByName(cut_nodes.withColumn("node", F.col("cluster_id")))
    return result.select("cut", "cluster_id", "node")


def subtree(nodes: DataFrame, start: DataFrame | None = None, depth: int = 5) -> DataFrame:
    """Nodes at most ``depth`` levels below the start nodes (default: the root), with their ``level``."""
    layer = (roots(nodes) if start is None else nodes.join(start.select("cluster_id"), "cluster_id", "left_semi")).withColumn(
        "level", F.lit(0)
    )
    result = layer
    for level in range(1, depth + 1):
        above = layer.select(F.col("cluster_id").alias("parent_id"))
        layer = checkpoint(nodes.join(above, "parent_id", "left_semi").withColumn("level", F.lit(level)).select(*result.columns))
        result = result.unionByName(layer)
    return result


def edges(tree: DataFrame) -> DataFrame:
    """``(parent_id, cluster_id)`` among the given nodes."""
    inside = tree.select(F.col("cluster_id").alias("parent_id"))
    return tree.select("parent_id", "cluster_id").join(inside, "parent_id", "left_semi")


def density_trend(nodes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """``(point, cluster_id, size, density)`` of every cluster that holds the point; of all points, or of ``points(point)``."""
    start = None if points is None else _asked(nodes, points)
    chain = ancestors(nodes, start, told=["size", "density"])
    return chain.select(F.col("node").alias("point"), F.col("ancestor").alias("cluster_id"), "size", "density")


def _asked(nodes: DataFrame, points: DataFrame) -> DataFrame:
    return singletons(nodes).join(points.select(F.col("point").alias("cluster_id")).distinct(), "cluster_id", "left_semi")


def best_clusters(nodes: DataFrame) -> DataFrame:
    """``(point, cluster_id, size)``: the cluster just below the largest jump in size; the higher one on a tie."""
    jump = F.struct(
        (F.col("parent_size") - F.col("size")).alias("jump"), F.col("size").alias("size"), F.col("cluster_id").alias("id")
    )
    state = with_parent(nodes).select(
        F.col("cluster_id").alias("node"),
        F.col("parent_id").alias("ptr"),
        F.when(F.col("parent_id").isNotNull(), jump).alias("acc"),
        _leaf(),
    )
    best = fold_to_root(state, lambda a, b: F.greatest(a, b))
    points = singletons(nodes).select(F.col("cluster_id").alias("node"))
    return best.join(points, "node", "left_semi").filter("acc is not null").select(
        F.col("node").alias("point"), F.col("acc.id").alias("cluster_id"), F.col("acc.size").alias("size")
    )


def incremental_chain(nodes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """``(point, level, cluster_id, size, density, added_id, added)`` from the point to its best cluster.

    ``added_id`` is the branch that joined at this level and ``added`` its number of points: the new points
    of a level are the points below that branch (see :func:`points_below`). ``points(point)`` restricts the
    report to the points asked for.
    """
    best = best_clusters(nodes)
    if points is not None:
        best = best.join(points.select("point").distinct(), "point", "left_semi")
    start = best.select(F.col("point").alias("cluster_id"), F.col("cluster_id").alias("top"))
    chain = ancestors(nodes, start, told=["size", "density", "left_id", "right_id"], steps=True)
    joined = chain.withColumnsRenamed({"node": "point", "ancestor": "cluster_id", "hops": "level"})
    # the child on the chain is one level below; the other child is what joined
    other = F.when(F.col("child").isNull(), F.col("cluster_id")).when(
        F.col("child") == F.col("left_id"), F.col("right_id")
    ).otherwise(F.col("left_id"))
    return joined.select(
        "point",
        "level",
        "cluster_id",
        "size",
        "density",
        other.alias("added_id"),
        (F.col("size") - F.coalesce("had", F.lit(0))).alias("added"),
    )


def leaf_intervals(nodes: DataFrame) -> DataFrame:
    """``(cluster_id, lo, hi)``: leaves numbered left to right, so a node's points are the places lo <= i < hi."""
    left_size = nodes.select(F.col("cluster_id").alias("left_id"), F.col("size").alias("_shift"))
    shifts = (
        nodes.filter("size > 1")
        .join(left_size, "left_id")
        .select(F.col("right_id").alias("cluster_id"), "_shift")
    )
    state = nodes.join(shifts, "cluster_id", "left").select(
        F.col("cluster_id").alias("node"), F.col("parent_id").alias("ptr"), F.coalesce("_shift", F.lit(0)).alias("acc"), _leaf()
    )
    low = fold_to_root(state, lambda a, b: a + F.coalesce(b, F.lit(0)))
    return nodes.join(low.withColumnRenamed("node", "cluster_id"), "cluster_id").select(
        "cluster_id", F.col("acc").alias("lo"), (F.col("acc") + F.col("size")).alias("hi")
    )


def points_below(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(cluster_id, point)`` of the wanted clusters, by place: each interval is joined block by block."""
    spans = leaf_intervals(nodes)
    places = spans.join(singletons(nodes).select("cluster_id"), "cluster_id", "left_semi").select(
        F.col("cluster_id").alias("point"), F.col("lo").alias("_place")
    )
    asked = wanted.select("cluster_id").distinct().join(spans, "cluster_id")
    exact = asked.select("cluster_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("_place"))
    return exact.join(places, "_place").select("cluster_id", "point")


def _aligned_blocks(lo: Column, hi: Column, depth: int) -> Column:
    """Split [lo, hi) into aligned blocks of sizes RADIX^k, as an array of ``struct(level, block)``."""

    def run(level: int, start: Column, stop: Column) -> Column:
        size = RADIX**level
        return F.when(
            start < stop,
            F.transform(
                F.sequence(F.floor(start / size), F.floor(stop / size) - 1),
                lambda block: F.struct(F.lit(level).alias("level"), block.alias("block")),
            ),
        ).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

    found = []
    for level in range(depth + 1):
        size, above = RADIX**level, RADIX ** (level + 1)
        start, stop = F.ceil(lo / size) * size, F.floor(hi / size) * size
        # what larger blocks cover begins and ends at a multiple of the larger size
        inner_start, inner_stop = F.ceil(lo / above) * above, F.floor(hi / above) * above
        split = inner_start <= inner_stop
        found.append(run(level, start, F.when(split, inner_start).otherwise(stop)))
        found.append(F.when(split, run(level, inner_stop, stop)).otherwise(F.array().cast("array<struct<level:int,block:bigint>>")))
    return F.concat(*found)


def node_centroids(nodes: DataFrame, points: DataFrame, labels: DataFrame | None = None, top: int = LABELLED_TOPICS) -> DataFrame:
    """``(cluster_id, topics)``: the strongest topics of every node's mean vector, strongest first.

    ``points(point, v)``. Sums of aligned blocks of leaves are built level by level, and every node adds up
    the blocks of its interval: O(n log n) rows for any tree, where one row per node and point could be O(n^2).
    """
    spans = checkpoint(leaf_intervals(nodes))
    placed = checkpoint(
        spans.join(points, spans["cluster_id"] == points["point"]).select(
            F.lit(0).alias("level"), F.col("lo").alias("block"), array_to_vector(V.doubles(F.col("v"))).alias("s")
        )
    )
    n = nodes.filter("size = 1").count()
    depth = 0
    while RADIX**depth < n:
        depth += 1
    layers = layer = placed
    for level in range(1, depth + 1):
        layer = checkpoint(
            layer.groupBy(F.floor(F.col("block") / RADIX).alias("block"))
            .agg(Summarizer.sum(F.col("s")).alias("s"))
            .select(F.lit(level).alias("level"), "block", "s")
        )
        layers = layers.unionByName(layer)
    cover = spans.select("cluster_id", F.inline(_aligned_blocks(F.col("lo"), F.col("hi"), depth)))
    sums = cover.join(layers, ["level", "block"]).groupBy("cluster_id").agg(Summarizer.sum(F.col("s")).alias("s"))
    mean = sums.join(nodes.select("cluster_id", "size"), "cluster_id").select(
        "cluster_id", F.posexplode(vector_to_array("s")).alias("topic", "s"), "size"
    ).select("cluster_id", "topic", (F.col("s") / F.col("size")).alias("p"))
    from topicloom.operators.topics import top_n

    best = top_n(mean, ["cluster_id"], "p", "topic", top, non_zero=True)
    if labels is not None:
        best = best.join(labels, "topic", "left").withColumn("label", F.coalesce("label", F.col("topic").cast("string")))
        return best.select("cluster_id", "rank", "topic", "label", "p")
    return best.select("cluster_id", "rank", "topic", "p")


def child_scores(nodes: DataFrame) -> DataFrame:
    """Scores of every child against its parent: density drop, relative, relative weighted by size."""
    largest = nodes.agg(F.max("size")).scalar()
    drop = F.col("density") - F.col("parent_density")
    relative = F.when(F.col("density") == 0, F.lit(SMALLEST)).otherwise(drop / F.col("density"))
    weighted = F.when(F.col("density") == 0, F.lit(SMALLEST)).otherwise(
        F.col("parent_size") / largest * drop / F.col("density")
    )
    return (
        with_parent(nodes)
        .filter("parent_id is not null")
        .select(
            "cluster_id",
            "parent_id",
            (F.col("parent_density") - F.col("density")).alias("drop"),
            relative.alias("relative"),
            weighted.alias("weighted"),
        )
        .orderBy(F.desc("drop"), "cluster_id")
    )
