"""Tree operators on small trees, also chains and trees with falling densities."""

import pytest

from topicloom.checks import tree as T
from topicloom.operators import tree as G

NODES = "cluster_id long, size long, density double, parent_id long, left_id long, right_id long"


def make(spark, points, inner):
    """``inner``: rows (id, left, right, density), children first."""
    size, parent = {p: 1 for p in range(points)}, {}
    for c, left, right, _ in inner:
        size[c] = size[left] + size[right]
        parent[left] = parent[right] = c
    rows = [(p, 1, 0.0, parent.get(p), None, None) for p in range(points)]
    rows += [(c, size[c], float(d), parent.get(c), left, right) for c, left, right, d in inner]
    return spark.createDataFrame(rows, NODES)


@pytest.fixture(scope="module")
def grid(spark):
    return make(spark, 6, [(6, 1, 0, 2), (7, 3, 2, 2), (8, 5, 4, 2), (9, 7, 6, 4), (10, 8, 9, 6)])


@pytest.fixture(scope="module")
def chain(spark):
    """One point joins at a time, 9 levels deep."""
    return make(spark, 10, [(10 + k, 9 + k if k else 1, k + 1 if k else 0, k + 1) for k in range(9)])


def test_grid_cuts(grid):
    assert G.roots(grid).first()["cluster_id"] == 10
    assert {r["cluster_id"] for r in G.cut(grid, 3.0).collect()} == {6, 7, 8}
    assert {r["cluster_id"] for r in G.cut(grid, 5.0).collect()} == {8, 9}
    members = {(r["cut"], r["cluster_id"], r["node"]) for r in G.under_cuts(grid, [3.0, 5.0, 7.0]).collect()}
    assert len(members) == 18
    assert {m for m in members if m[0] == 5.0} == {(5.0, 9, p) for p in range(4)} | {(5.0, 8, p) for p in (4, 5)}


def test_best_cluster_takes_the_higher_on_a_tie(grid):
    best = {r["point"]: r["cluster_id"] for r in G.best_clusters(grid).collect()}
    assert best[0] == 9 and best[4] == 8
    steps = sorted((r["level"], r["cluster_id"], r["added_id"], r["added"]) for r in G.incremental_chain(grid).collect() if r["point"] == 0)
    assert steps == [(0, 0, 0, 1), (1, 6, 1, 1), (2, 9, 7, 2)]


def test_chain_is_as_deep_as_its_points(chain, spark):
    trend = G.density_trend(chain).filter("point = 0").orderBy("size").collect()
    assert [r["size"] for r in trend] == list(range(1, 11))
    spans = {r["cluster_id"]: (r["lo"], r["hi"]) for r in G.leaf_intervals(chain).collect()}
    assert sorted(spans[p][0] for p in range(10)) == list(range(10))
    below = G.points_below(chain, spark.createDataFrame([(13,)], "cluster_id long"))
    assert {r["point"] for r in below.collect()} == {0, 1, 2, 3, 4}


def test_nested_cuts_when_density_falls(spark):
    nodes = make(spark, 4, [(4, 1, 0, 1), (5, 4, 2, 5), (6, 5, 3, 2)])
    got = {(r["cluster_id"], r["node"]) for r in G.under_cuts(nodes, [3.0]).collect()}
    # node 4 lies below 3 and under a parent above it; the root lies below 3 too
    assert got == {(4, 0), (4, 1)} | {(6, p) for p in range(4)}


def test_subtree_and_edges(grid, spark):
    shown = G.subtree(grid, depth=1)
    assert {r["cluster_id"] for r in shown.collect()} == {10, 9, 8}
    start = spark.createDataFrame([(9,)], "cluster_id long")
    assert {(r["parent_id"], r["cluster_id"]) for r in G.edges(G.subtree(grid, start, 1)).collect()} == {(9, 6), (9, 7)}


def test_child_scores(grid):
    scores = {r["cluster_id"]: r for r in G.child_scores(grid).collect()}
    assert scores[9]["drop"] == 2.0 and scores[9]["relative"] == (4 - 6) / 4
    assert scores[6]["weighted"] == pytest.approx(4 / 6 * (2 - 4) / 2)
    assert scores[0]["relative"] == 4.9e-324


def test_sweep():
    # steps add up in doubles, so the tenth lies just below 0.5
    cuts = G.sweep(0.05, 0.5)
    assert len(cuts) == 11 and cuts[-1] == 2.0 and cuts[0] == 0.05 and 0.49 < cuts[9] < 0.5


def _order_nodes(orders):
    """The same tree by brute force over all levels."""
    keys = {}
    for key, price in orders:
        keys.setdefault(key, []).append(price)
    top = max(k for k in keys if k is not None).bit_length()
    groups = {(0, k): [k] for k in keys}
    for level in range(1, top + 1):
        for prefix in {k >> level for k in keys if k is not None}:
            below = [k for k in keys if k is not None and k >> level == prefix]
            if len({(k >> (level - 1)) & 1 for k in below}) == 2:
                groups[level, prefix] = below
    nodes = {}
    for (level, prefix), below in groups.items():
        prices = [p for k in below for p in keys[k] if p is not None]
        up = [] if prefix is None else [at for at in range(level + 1, top + 1) if (at, prefix >> (at - level)) in groups]
        parent = up[0] * T.SHIFT + (prefix >> (up[0] - level)) if up else None
        nodes[None if prefix is None else level * T.SHIFT + prefix] = (
            sum(len(keys[k]) for k in below), max(prices) - min(prices) if prices else None, parent
        )
    return nodes


def test_order_tree_merges_blocks_without_a_row_per_level(spark, tmp_path, monkeypatch):
    orders = [(k, float(k % 7)) for k in (0, 1, 2, 3, 5, 8, 9, 64, 65, 200, 201, 203, 1000, 4095)]
    orders += [(5, 50.0), (9, None), (70, None), (None, 1.0), (None, 4.0)]
    path = str(tmp_path)
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    plans, write = [], T.checkpoint
    monkeypatch.setattr(T, "checkpoint", lambda df: (plans.append(df._jdf.queryExecution().toString()), write(df))[1])
    for bits in (3, 16):
        monkeypatch.setattr(T, "BLOCK_BITS", bits, raising=False)
        nodes = T.order_tree(spark, path).collect()
        got = {r["cluster_id"]: (r["size"], r["density"], r["parent_id"]) for r in nodes}
        assert len(nodes) == len(got) and got == _order_nodes(orders)
        for r in nodes:
            if r["left_id"] is not None:
                assert got[r["left_id"]][2] == got[r["right_id"]][2] == r["cluster_id"]
    assert plans and not any("Generate" in p for p in plans)


def test_chains_are_not_shuffled(spark, grid):
    # the rows of all chains, points x depth, were shuffled to get sizes and the child below
    import re

    for made in (G.density_trend(grid), G.incremental_chain(grid)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        top = plan[: plan.index("_block")]  # above the join that lays the chains out
        assert len(re.findall(r"Join|Window|Aggregate", top)) <= 1
