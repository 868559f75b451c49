"""Tree operators on a binary tree over the orders, which SQL can build too."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from topicloom.checks import table
from topicloom.operators import tree as G
from topicloom.scale import checkpoint, ship_with_tasks

ship_with_tasks(__name__)

SHIFT = 1 << 40  # cluster id = level * SHIFT + key, so a leaf has its own key
BLOCK_BITS = 16  # levels that one task merges, of at most as many leaves as these bits count
CUTS = [1_000.0, 20_000.0, 100_000.0, 300_000.0, 400_000.0, 450_000.0, 1_000_000.0]


def _merged(base: int):
    """Task that merges the nodes of one aligned block of keys level by level; what is left is the block's top."""

    def task(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        key, at = rows["key"].to_numpy(), {c: rows[c].to_numpy().copy() for c in _STATE}
        told = []

        def emit(places: np.ndarray, parents: np.ndarray, keys: np.ndarray, top: bool) -> None:
            told.append({"key": keys, **{c: at[c][places] for c in _STATE}, "parent_id": parents, "top": np.full(len(places), top)})

        for level in range(base + 1, base + BLOCK_BITS + 1):
            key = key >> 1
            left = np.flatnonzero(key[1:] == key[:-1])  # keys were unique, so at most two meet
            if not len(left):
                continue
            right, made = left + 1, level * SHIFT + key[left]
            for side in (left, right):
                emit(side, made, key[side], False)
            joined = {
                "cluster_id": made, "size": at["size"][left] + at["size"][right], "lo": np.fmin(at["lo"][left], at["lo"][right]),
                "hi": np.maximum(at["hi"][left], at["hi"][right]), "left_id": at["cluster_id"][left], "right_id": at["cluster_id"][right],
            }
            for c in _STATE:
                at[c][left] = joined[c]
                at[c] = np.delete(at[c], right)
            key = np.delete(key, right)
        emit(np.arange(len(key)), np.full(len(key), -1), key, True)
        return pa.table({f.name: np.concatenate([t[f.name] for t in told]) for f in _MERGED}, schema=_MERGED)

    return task


_MERGED = pa.schema(
    [("key", pa.int64()), ("cluster_id", pa.int64()), ("size", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())]
    + [(c, pa.int64()) for c in ("left_id", "right_id", "parent_id")]
    + [("top", pa.bool_())]
)
_STATE = ("cluster_id", "size", "lo", "hi", "left_id", "right_id")


def order_tree(spark, sf):
    """Nodes of equal leading key bits that both halves reach; density is the range of prices below the node.

    Aligned blocks of keys are merged in one task each and give back their top, which is a leaf of the next round: an
    order is shuffled once, whatever the number of levels.
    """
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    ranges = [
        F.count("*").alias("size"),
        F.coalesce(F.min("v"), F.lit(float("inf"))).alias("lo"),
        F.coalesce(F.max("v"), F.lit(float("-inf"))).alias("hi"),
    ]
    none = F.lit(-1).cast("long")
    bits = orders.agg(F.max(F.length(F.bin("id")))).first()[0] or 0
    layer = orders.where("id is not null").groupBy(F.col("id").alias("key")).agg(*ranges)
    layer = layer.select("key", F.col("key").alias("cluster_id"), "size", "lo", "hi", none.alias("left_id"), none.alias("right_id"))
    nodes = orders.where("id is null").groupBy(F.col("id").alias("cluster_id")).agg(*ranges)
    nodes = nodes.select(*_STATE[:4], *[none.alias(c) for c in ("left_id", "right_id", "parent_id")])
    schema = "key long, cluster_id long, size long, lo double, hi double, left_id long, right_id long, parent_id long, top boolean"
    for base in range(0, max(1, bits), BLOCK_BITS):
        blocks = layer.groupBy(F.shiftright("key", BLOCK_BITS).alias("block"))
        merged = checkpoint(blocks.applyInArrow(_merged(base), schema))
        nodes = nodes.unionByName(merged.where("not top").drop("key", "top"))
        layer = merged.where("top").drop("parent_id", "top")
    nodes = nodes.unionByName(layer.withColumn("parent_id", none).drop("key"))
    ids = [F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("parent_id", "left_id", "right_id")]
    return nodes.select("cluster_id", "size", F.when(F.col("hi") >= F.col("lo"), F.col("hi") - F.col("lo")).alias("density"), *ids)


SQL_TREE = f"""
top as (select max(length(bin(o_orderkey))) as t from orders),
spread as (select o_orderkey as id, o_totalprice as v, unnest(range(t + 1)) as level from orders, top),
bits as (select id, v, level, id >> level as key, case when level > 0 then (id >> (level - 1)) & 1 else 0 end as bit from spread),
real_ as (select level, key, count(*) as size, max(v) - min(v) as density from bits group by level, key
          having level = 0 or min(bit) < max(bit)),
up as (select level, key, unnest(range(level + 1, t + 1)) as plevel from real_, top),
linked as (select u.level, u.key, min(u.plevel) as plevel from up u join real_ r on r.level = u.plevel and r.key = (u.key >> (u.plevel - u.level))
           group by u.level, u.key),
par as (select level * {SHIFT} + key as cluster_id, plevel * {SHIFT} + (key >> (plevel - level)) as parent_id,
               (key >> (plevel - 1 - level)) & 1 as side from linked),
kids as (select parent_id as cluster_id, max(cluster_id) filter (side = 0) as left_id, max(cluster_id) filter (side = 1) as right_id
         from par group by parent_id),
nodes as materialized (select r.level * {SHIFT} + r.key as cluster_id, r.size, r.density, p.parent_id, k.left_id, k.right_id
          from real_ r left join par p on p.cluster_id = r.level * {SHIFT} + r.key left join kids k on k.cluster_id = r.level * {SHIFT} + r.key),
wp as (select n.*, p.size as parent_size, p.density as parent_density from nodes n left join nodes p on p.cluster_id = n.parent_id),
chain as (select cluster_id as point, cluster_id, parent_id, 0 as level from nodes where size = 1
          union all select c.point, n.cluster_id, n.parent_id, c.level + 1 from chain c join nodes n on n.cluster_id = c.parent_id),
cuts as (select unnest([{', '.join(str(c) for c in CUTS)}]) as cut),
cutn as (select cut, cluster_id, size, density from wp, cuts
         where density < cut and (parent_id is null or (size > 1 and parent_density >= cut))),
jumps as (select c.point, n.cluster_id, n.size, n.parent_size - n.size as jump from chain c join wp n using (cluster_id) where n.parent_id is not null),
best as (select point, cluster_id, size from (select *, row_number() over (partition by point order by jump desc, size desc, cluster_id desc) as rn from jumps)
         where rn = 1)
"""


def tree_nodes(spark, sf):
    nodes = order_tree(spark, sf)
    return G.wire_parents(nodes)


def tree_root(spark, sf):
    return G.roots(order_tree(spark, sf)).select("cluster_id", "size")


def tree_cut(spark, sf):
    return G.by_size(G.cut(order_tree(spark, sf), 400_000.0))


def cut_sweep(spark, sf):
    return G.cut_sweep(order_tree(spark, sf), CUTS)


def cut_members(spark, sf):
    return G.under_cuts(order_tree(spark, sf), CUTS).withColumnRenamed("node", "point")


def cut_subtrees(spark, sf):
    return G.under_cuts(order_tree(spark, sf), [400_000.0], only_points=False)


def tree_top_levels(spark, sf):
    return G.subtree(order_tree(spark, sf), depth=5).select("cluster_id", "parent_id", "level")


def tree_edges(spark, sf):
    return G.edges(G.subtree(order_tree(spark, sf), depth=3))


def density_trend(spark, sf):
    return G.density_trend(order_tree(spark, sf)).withColumn("density", F.round("density", 6))


def best_cluster(spark, sf):
    return G.best_clusters(order_tree(spark, sf))


def new_points(spark, sf):
    return G.incremental_chain(order_tree(spark, sf)).select("point", "level", "cluster_id", "added_id", "added")


def leaf_places(spark, sf):
    return G.leaf_intervals(order_tree(spark, sf))


def child_scores(spark, sf):
    s = G.child_scores(order_tree(spark, sf))
    return s.select("cluster_id", *[F.round(c, 6).alias(c) for c in ("drop", "relative", "weighted")])


def node_centroids(spark, sf):
    """Mean price root, status and priority of every node, two strongest columns."""
    line = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("point"),
        F.array(
            F.sqrt("o_totalprice"),
            F.when(F.col("o_orderstatus") == "F", 2 * F.sqrt("o_totalprice")).otherwise(0.0),
            F.when(F.startswith("o_orderpriority", F.lit("1")), 3 * F.sqrt("o_totalprice")).otherwise(0.0),
        ).alias("v"),
    )
    top = G.node_centroids(order_tree(spark, sf), line, top=2)
    return top.select("cluster_id", "rank", "topic", F.round("p", 6).alias("p"))


_SQL_PLAIN = "with " + SQL_TREE[: SQL_TREE.index("chain as (")].rstrip().rstrip(",")


def _sql(body: str) -> str:
    return "with recursive " + SQL_TREE + body


QUERIES = {
    "tree_nodes": (tree_nodes, _sql("select * from nodes")),
    "tree_root": (tree_root, _sql("select cluster_id, size from nodes where parent_id is null")),
    "tree_cut": (
        tree_cut,
        _sql("""select cluster_id, size, density from wp where density < 400000
and (parent_id is null or (size > 1 and parent_density >= 400000))"""),
    ),
    "cut_sweep": (cut_sweep, _sql("select cast(cut as double) as cut, cluster_id, size, density from cutn")),
    "cut_members": (
        cut_members,
        _sql("select cast(cut as double) as cut, cluster_id, c.point from cutn join chain c using (cluster_id)"),
    ),
    "cut_subtrees": (
        cut_subtrees,
        _sql(f"""select distinct cast(cut as double) as cut, k.cluster_id, c2.cluster_id as node
from cutn k join chain c using (cluster_id) join chain c2 on c2.point = c.point and c2.level <= c.level where cut = 400000"""),
    ),
    "tree_top_levels": (
        tree_top_levels,
        _sql(""", down as (select cluster_id, parent_id, 0 as level from nodes where parent_id is null
union all select n.cluster_id, n.parent_id, d.level + 1 from nodes n join down d on n.parent_id = d.cluster_id where d.level < 5)
select * from down"""),
    ),
    "tree_edges": (
        tree_edges,
        _sql(""", down as (select cluster_id, parent_id, 0 as level from nodes where parent_id is null
union all select n.cluster_id, n.parent_id, d.level + 1 from nodes n join down d on n.parent_id = d.cluster_id where d.level < 3)
select parent_id, cluster_id from down where parent_id is not null"""),
    ),
    "density_trend": (
        density_trend,
        _sql("select c.point, cluster_id, n.size, round(n.density, 6) as density from chain c join nodes n using (cluster_id)"),
    ),
    "best_cluster": (best_cluster, _sql("select point, cluster_id, size from best")),
    "new_points": (
        new_points,
        # a leaf's ancestors are the real nodes with its leading bits: no recursion, all else by windows over a leaf's chain
        _SQL_PLAIN
        + f""", way as (select b.id as point, level * {SHIFT} + key as cluster_id, real_.size from bits b join real_ using (level, key)),
jump as (select *, coalesce(lead(size) over w - size, -1) as jump, cast(row_number() over w - 1 as int) as level, lag(cluster_id) over w as child, lag(size) over w as had
  from way window w as (partition by point order by size)),
upto as (select *, max(struct_pack(jump := jump, size := size)) over (partition by point) as top from jump)
select point, level, cluster_id, case when child is null then cluster_id when child = left_id then right_id else left_id end as added_id,
  upto.size - coalesce(had, 0) as added from upto join nodes using (cluster_id) where top.jump > 0 and upto.size <= top.size""",
    ),
    "leaf_places": (
        leaf_places,
        _sql("select cluster_id, (cluster_id % 1099511627776) << (cluster_id // 1099511627776) as lo, "
             "((cluster_id % 1099511627776) << (cluster_id // 1099511627776)) + size as hi from nodes"),
    ),
    "child_scores": (
        child_scores,
        _sql("""select cluster_id, round(parent_density - density, 6) as "drop",
  case when density = 0 then 0.0 else round((density - parent_density) / density, 6) end as relative,
  case when density = 0 then 0.0 else round(parent_size / (select max(size) from nodes) * (density - parent_density) / density, 6) end as weighted
from wp where parent_id is not null"""),
    ),
    "node_centroids": (
        node_centroids,
        _sql(""", m as (select c.cluster_id, avg(sqrt(o_totalprice)) as p0, avg(case when o_orderstatus = 'F' then 2 * sqrt(o_totalprice) else 0.0 end) as p1,
  avg(case when starts_with(o_orderpriority, '1') then 3 * sqrt(o_totalprice) else 0.0 end) as p2 from chain c join orders on o_orderkey = point group by c.cluster_id),
l as (select cluster_id, unnest([p0, p1, p2]) as p, unnest([0, 1, 2]) as topic from m),
r as (select *, row_number() over (partition by cluster_id order by p desc, topic) as rank from l where p <> 0)
select cluster_id, cast(rank as int) as rank, topic, round(p, 6) as p from r where rank <= 2"""),
    ),
}
QUERIES = {name: (q, sql.replace("\n, ", ",\n", 1) if "\n, " in sql else sql) for name, (q, sql) in QUERIES.items()}
