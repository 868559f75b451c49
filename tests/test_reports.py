"""Reports on cut clusters next to their SQL, on lines whose original ids clash or are large."""

from datetime import datetime

import duckdb
import pytest

from check_queries import normal
from topicloom.checks import clustering, reports

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reports"))
    huge = 600_000_000_000
    # lines of orders 1 and 2 share the id 20000001, and the ids of the huge keys add up to more than 64 bits
    lines = [(1, 100_000, 7, 1, 3.0, "A", 1), (2, 0, 8, 1, 4.0, "R", 2), (2, 0, 8, 1, 4.0, "N", 3), (3, 5, 9, 2, 1.0, "N", 40)]
    lines += [(huge + k, 1, 7, 1, 2.0, "A", 1) for k in range(4)]
    orders = [(1, 10.0), (2, 15.0), (3, 500.0), *((huge + k, 30.0 * k) for k in range(4))]
    spark.createDataFrame([(*r[:6], datetime(2024, 1 + r[6] // 31, 1 + r[6] % 28)) for r in lines], LINES).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    vectors = [(k, k // 6, [1.0 + k, 2.0, (7.0 * k) % 5]) for k in range(12)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def same_as_sql(spark, path, queries, name, tables):
    query, sql = queries[name]
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    cur = con.execute(sql)
    made = query(spark, path)
    assert normal(made.columns, [tuple(r) for r in made.collect()]) == normal([d[0] for d in cur.description], cur.fetchall())
    return made


@pytest.mark.parametrize("name", ["cluster_versions", "cluster_files", "cluster_dates", "cluster_originals"])
def test_originals_of_two_points_with_one_id(spark, small, name):
    same_as_sql(spark, small, reports.QUERIES, name, ["orders", "lineitem"])


def test_kmeans_step_tells_sizes(spark, small):
    made = same_as_sql(spark, small, clustering.QUERIES, "kmeans_step", ["embeddings"])
    assert {r["child"]: r["n"] for r in made.collect()} and "n" in made.columns


def test_first_merge_takes_one_round(spark, small, monkeypatch):
    monkeypatch.setattr(clustering.L, "merges", None)
    same_as_sql(spark, small, clustering.QUERIES, "linkage_first_merge", ["embeddings"])


def test_first_merge_of_a_row_that_comes_twice(spark, tmp_path):
    vectors = [(1, 0, [1.0, 2.0]), (2, 0, [2.0, 1.0]), (5, 0, [4.0, 1.0]), (5, 0, [4.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in clustering.linkage_first_merge(spark, str(tmp_path)).collect()] == [(5, 5, 0.0)]


def test_clusters_share_folders(spark, tmp_path):
    # 200 pairs of points: a folder and a file for each pair were 200
    from topicloom.operators import clusters as R
    from topicloom.operators import tree as G
    from topicloom.sources import tables as ST

    leaves = [(i, 1, 0.0, 1000 + i // 2, None, None) for i in range(400)]
    pairs = [(1000 + i, 2, 0.5, None, 2 * i, 2 * i + 1) for i in range(200)]
    nodes = spark.createDataFrame(leaves + pairs, "cluster_id long, size long, density double, parent_id long, left_id long, right_id long")
    ST.write_cut(G.cut(nodes, 1.0), G.under_cuts(nodes, [1.0], only_points=False), nodes, f"{tmp_path}/cut")
    assert len(list((tmp_path / "cut" / "all").glob("*/*/part-*"))) <= 20
    back = ST.read_cut(spark, f"{tmp_path}/cut").collect()
    assert sorted((r["cut"], r["cluster_id"], r["node"]) for r in back) == sorted((1.0, 1000 + i, n) for i in range(200) for n in (2 * i, 2 * i + 1, 1000 + i))

    members = G.under_cuts(nodes, [1.0]).withColumnRenamed("node", "point")
    weights = spark.createDataFrame([(i, 0, 1.0) for i in range(400)], "point long, topic int, p double")
    index = spark.createDataFrame([(i, i) for i in range(400)], "point long, doc_id long")
    rules = spark.createDataFrame([], "point long, rule string")
    facts = [spark.createDataFrame([], f"doc_id long, {c} string") for c in ("version", "date", "path")]
    sizes, near = G.cut_sweep(nodes, [1.0]), R.point_distances(members, weights)
    lines = R.documents(sizes, R.report(members, weights, index, *facts, rules), near, R.originals(members, index), rules)
    ST.write_cluster_documents(lines, sizes, f"{tmp_path}/documents")
    assert len(list((tmp_path / "documents" / "clusters").glob("*/*/part-*"))) <= 20
    back = ST.read_cluster_documents(spark, f"{tmp_path}/documents")
    points = back.where("entry.distance is not null").collect()
    assert sorted((r["cluster_id"], r["entry"]["point"]) for r in points) == [(1000 + i // 2, i) for i in range(400)]
    assert "cluster_id" not in back.schema["entry"].dataType.names


def test_point_distances_by_lists(spark, small):
    # a join on topics made a row per member and topic, shuffled twice
    from topicloom.operators import clusters as R

    same_as_sql(spark, small, reports.QUERIES, "cluster_point_distance", ["orders", "lineitem"])
    members = spark.createDataFrame([(1.0, 9, p) for p in (1, 2, 3)], "cut double, cluster_id long, point long")
    rows = [(1, 0, 0.5), (1, 1, 0.5), (2, 0, 1.0), (3, 0, 0.25), (3, 1, 0.25), (3, 2, 0.5), (3, None, 0.5), (4, 0, 1.0)]
    weights = spark.createDataFrame(rows, "point long, topic int, p double")
    made = R.point_distances(members, weights)
    assert "topic" not in "".join(line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    mean = {0: 1.75 / 3, 1: 0.25, 2: 0.5 / 3, None: 0.5 / 3}
    for r in made.collect():
        own = {t: p for q, t, p in rows if q == r["point"]}
        # as before, a weight without a topic counts in both squares and not in the product
        want = sum(p * p for p in own.values()) + sum(m * m for m in mean.values()) - 2 * sum(p * mean[t] for t, p in own.items() if t is not None)
        assert r["d2"] == pytest.approx(want)
    assert made.count() == 3
