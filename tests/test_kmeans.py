"""Bisecting k-means: steps against numpy, and what must hold for any split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import kmeans as K
from topicloom.scale import checkpoint


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(c, 0.1, (15, 3)) for c in (0, 1, 5, 6)])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return checkpoint(spark.createDataFrame(rows, "point long, v array<double>"))


def numpy_lloyd(x, c0, c1, max_steps, check_every=5, delta=0.01):
    """Steps by the book for one parent: centres, RSS, converged."""
    past, c = [], [np.array(c0), np.array(c1)]
    for step in range(1, max_steps + 1):
        d = np.stack([((x - k) ** 2).sum(1) for k in c])
        side = (d[1] < d[0]).astype(int)
        rss = [d[k][side == k].sum() for k in (0, 1)]
        c = [x[side == k].mean(0) if (side == k).any() else c[k] for k in (0, 1)]
        past.append((rss, [k.copy() for k in c]))
        if step % check_every == 0 and step <= max_steps - max_steps % check_every:
            done = True
            for k in (0, 1):
                (r0, a), (r1, b), (r2, _) = sorted(((p[0][k], p[1][k].tolist()) for p in past[-3:]))
                done &= np.allclose(a, b, rtol=1e-9) or r2 - r1 <= (1 + delta) * (r1 - r0) + 1e-9 * r2
            if done:
                return c, sum(rss), True
    return c, sum(rss), False


@pytest.mark.parametrize("cell_rows,max_steps", [(K.CELL_ROWS, 20), (K.CELL_ROWS, 7), (7, 7), (30, 10)])
def test_steps_against_numpy(spark, points, cell_rows, max_steps):
    """One parent in one cell, or sliced over many: the same centres and RSS as without Spark."""
    two = points.withColumn("parent", F.when(F.col("point") < 40, 5).otherwise(9).cast("long"))
    cells = K.in_cells(two, tries=3, cell_rows=cell_rows)
    first = checkpoint(K.seeds(two, 3, 7))
    got = {(r["parent"], r["try"]): r for r in K.train(cells, first, max_steps).collect()}
    assert len(got) == 6
    x = {r["point"]: np.array(r["v"]) for r in points.collect()}
    for r in first.collect():
        mine = np.array([v for p, v in sorted(x.items()) if (p < 40) == (r["parent"] == 5)])
        c, rss, converged = numpy_lloyd(mine, r["c0"], r["c1"], max_steps)
        made = got[r["parent"], r["try"]]
        assert made["rss"] == pytest.approx(rss) and made["converged"] == converged
        assert made["c0"] == pytest.approx(c[0]) and made["c1"] == pytest.approx(c[1])
    best = checkpoint(K.train(cells, first, max_steps).where("try = 1"))
    near = {r["point"]: (r["child"], r["d2"]) for r in K.assign(cells, best).collect()}
    by_parent = {r["parent"]: r for r in best.collect()}
    for p, v in x.items():
        parent = 5 if p < 40 else 9
        d = [((v - np.array(by_parent[parent][f"c{k}"])) ** 2).sum() for k in (0, 1)]
        assert near[p] == (parent * 2 + int(d[1] < d[0]), pytest.approx(min(d)))


def test_seeds_are_drawn_by_md5(spark, points):
    import hashlib

    at = points.withColumn("parent", F.lit(1).cast("long"))
    x = {r["point"]: np.array(r["v"]) for r in points.collect()}
    for r in K.seeds(at, 2, 11).collect():
        order = sorted(x, key=lambda p: (hashlib.md5(f"{p}:11:{r['try']}".encode()).hexdigest(), p))[: 2 * K.SEED_POINTS]
        assert r["c0"] == pytest.approx(np.mean([x[p] for p in order[::2]], axis=0))
        assert r["c1"] == pytest.approx(np.mean([x[p] for p in order[1::2]], axis=0))


def test_cells_hold_bounded_slices(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).cast("long").alias("parent"), F.col("id").alias("point"), F.array(F.lit(1.0)).alias("v"))
    cells = K.in_cells(rows, cell_rows=200)
    sizes = [r["count"] for r in cells.points.groupBy("cell").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 5 * 5000 / cells.count
    assert cells.slices.where("parent = 1").first()["slices"] == 20
    # the cells are read where they lie: only centres are shuffled
    centers = K.without_past(cells.slices.select("parent", F.lit(0).alias("try"), F.array(F.lit(0.0)).alias("c0"), F.array(F.lit(2.0)).alias("c1")))
    plan = K.lloyd_step(cells, centers)._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroups") :]
    left = cogroup[: cogroup.index("Bucketed: true")] if "Bucketed: true" in cogroup else cogroup
    assert "Bucketed: true" in cogroup and left.count("Exchange") == 0


def test_levels(points):
    made = K.bisect(points, levels=2, tries=3, cell_rows=13)
    members, clusters = checkpoint(made.members), checkpoint(made.clusters)
    assert made.restarts.count() == 6 and made.restarts.where("chosen").count() == 2
    rss = {r["level"]: r["s"] for r in clusters.groupBy("level").agg(F.sum("rss").alias("s")).collect()}
    assert rss[0] > rss[1] > rss[2]
    assert members.groupBy("level").count().filter("count <> 60").count() == 0
    # the four clouds come apart
    groups = members.filter("level = 2").groupBy("cluster_id").agg(F.collect_set(F.floor(F.col("point") / 15)).alias("g"))
    assert sorted(r["g"][0] for r in groups.collect()) == [0, 1, 2, 3]
    up = members.filter("level = 2").alias("a").join(members.filter("level = 1").alias("b"), "point")
    assert up.filter("shiftright(a.cluster_id, 1) <> b.cluster_id").count() == 0


def test_copies_and_single_points_end(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)] + [(5, [9.0, 9.0])]
    made = K.bisect(spark.createDataFrame(rows, "point long, v array<double>"), tries=2)
    assert made.clusters.agg(F.max("level")).first()[0] == 1
    assert sorted(r["n"] for r in made.clusters.filter("level = 1").collect()) == [1, 5]
    # the single point has one child a level while the rest is split
    rows = [(i, [float(i % 4), 0.0]) for i in range(8)] + [(8, [900.0, 0.0])]
    made = K.bisect(spark.createDataFrame(rows, "point long, v array<double>"), tries=3)
    levels = made.clusters.agg(F.max("level")).first()[0]
    alone = [r["cluster_id"] for r in made.members.where("point = 8").orderBy("level").collect()]
    assert len(alone) == levels + 1 >= 4 and all(b == 2 * a for a, b in zip(alone[1:], alone[2:]))
    assert made.members.count() == 9 * (levels + 1)
    assert {r["n"] for r in made.clusters.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {9}
    assert made.clusters.where(f"level = {levels}").count() == 5


def test_no_points(spark):
    made = K.bisect(spark.createDataFrame([], "point long, v array<double>"))
    assert made.members.count() == made.clusters.count() == made.restarts.count() == 0


def test_restarts_of_a_parent_that_fits_in_a_task_take_no_job_per_step(spark, monkeypatch):
    rows = [(1 + k % 2, k, [float(k % 5), float(k * 7 % 11), float(k * k % 13)]) for k in range(90)]
    points = spark.createDataFrame(rows, "parent long, point long, v array<double>")
    first = checkpoint(K.seeds(points, 2, 42))

    def trained():
        made = K.train(K.in_cells(points, tries=2, cell_rows=30), first, 10).collect()
        return {(r["parent"], r["try"]): ([round(x, 9) for x in [*r["c0"], *r["c1"], r["rss"]]], r["converged"]) for r in made}

    with monkeypatch.context() as m:
        m.setattr(K, "lloyd_step", None)
        whole = trained()
    monkeypatch.setattr(K, "WHOLE_BYTES", 0, raising=False)
    assert len(whole) == 4 and whole == trained()
