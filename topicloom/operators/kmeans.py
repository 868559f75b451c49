"""Bisecting k-means, all clusters of a level and all restarts at once.

Every cluster of a level splits in two; the children of cluster c are 2c and 2c + 1. The points of a level are dealt
into cells once: a large parent is sliced over several cells, small parents share one. In a step only centres move:
a parent's centres go to the cells that hold its points, every cell gives back one row of partial sums for each
parent and restart, and these are added up. Where a cell holds all points of a parent, it takes the steps up to the
next check before it gives back its sums. Nothing is sent to all tasks and no point leaves its cell. Restarts of parents
that are many points, but fit in a task, are trained to their end in a task each, so their steps are no jobs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.scale import checkpoint, checkpoint_by, drop_step, ship_with_tasks

ship_with_tasks(__name__)

# Levels, restarts, most Lloyd steps, steps between convergence checks, convergence delta,
# and the number of random points that make one first centre.
LEVELS, TRIES, MAX_STEPS, CHECK_EVERY, DELTA, SEED_POINTS = 32, 10, 100, 5, 0.01, 10

# Vectors, of points and centres, that a cell holds on average.
CELL_ROWS = 16_384

# Points from which a restart of a parent is worth a task of its own, restarts that are so whatever their points, and bytes
# of its vectors that the task may hold.
WHOLE_LEAST, WHOLE_COUNT, WHOLE_BYTES = 512, 10_000, 128 << 20

# Sums of doubles depend on their order in the last digits; what is this much smaller is no difference.
NOISE = 1e-9

DOUBLES = pa.list_(pa.float64())
STATE = "struct<r0:double,c0:array<double>,r1:double,c1:array<double>>"


@dataclass(frozen=True)
class Cells:
    """``points(cell, parent, point, v)`` bucketed by cell, and ``slices(parent, slices, size)``, the cells of each parent."""

    points: DataFrame
    slices: DataFrame
    count: int

    def at(self, parent: Column, part: Column) -> Column:
        return _cell(parent, part, self.count)


def _cell(parent: Column, part: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(parent.cast("long"), part.cast("long")), F.lit(cells)).cast("int")


def in_cells(points: DataFrame, sizes: DataFrame | None = None, tries: int = 1, cell_rows: int = CELL_ROWS) -> Cells:
    """Deal ``points(parent, point, v)`` into cells; with ``sizes(parent, size)`` only the points of these parents."""
    if sizes is None:
        sizes = points.groupBy("parent").agg(F.count("*").alias("size"))
    slices = checkpoint(sizes.select("parent", F.ceil(F.col("size") / cell_rows).cast("int").alias("slices"), "size"))
    parents, rows = slices.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cores = points.sparkSession.sparkContext.defaultParallelism
    count = max(1, -(-(rows + 2 * tries * parents) // cell_rows), min(cores, rows // 512))
    part = F.pmod(F.xxhash64("point"), F.col("slices"))
    dealt = points.join(slices.drop("size"), "parent").select(_cell(F.col("parent"), part, count).alias("cell"), "parent", "point", "v")
    return Cells(checkpoint_by(dealt, "cell", count), slices, count)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _sides(x: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Side and squared distance of the nearer centre; the first on a tie, or where there is no second (nan)."""
    d = np.stack([((x - c) ** 2).sum(1) for c in (c0, c1)])
    side = (d[1] < d[0]).astype(np.int64)
    return side, np.where(side == 1, d[1], d[0])


def _centers(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Parents, tries and both centres as matrices; a missing second centre is nan."""
    second = table["c1"].combine_chunks()
    there = np.array(second.is_valid())
    c1 = np.full((table.num_rows, dims), np.nan)
    c1[there] = second.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return table["parent"].to_numpy(), table["try"].to_numpy(), [_matrix(table["c0"], table.num_rows), c1]


def _meet(cells: Cells, centers: DataFrame, task, schema: str) -> DataFrame:
    """Run ``task(points, centers)`` on every cell; ``centers(parent, try, c0, c1, past)``, ``home`` marks one copy of each."""
    part = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    spread = centers.join(cells.slices, "parent").withColumn("_part", part)
    sent = spread.select(
        cells.at(F.col("parent"), F.col("_part")).alias("cell"), "parent", "try", "c0", "c1", "past", (F.col("_part") == 0).alias("home")
    ).dropDuplicates(["cell", "parent", "try"])  # two slices of a parent can fall into one cell
    return cells.points.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(task, schema)


def _pass(x: np.ndarray, of: np.ndarray, parents: np.ndarray, tries: np.ndarray, both: list[np.ndarray]):
    """Count and RSS of both sides of every center row, and their sums; one restart at a time."""
    n, dims = both[0].shape
    counts, rss, sums = np.zeros((n, 2)), np.zeros((n, 2)), [np.zeros((n, dims)) for _ in (0, 1)]
    for t in np.unique(tries):
        rows = np.flatnonzero(tries == t)
        rows = rows[np.argsort(parents[rows])]
        place = np.clip(np.searchsorted(parents[rows], of), 0, len(rows) - 1)
        held = np.flatnonzero(parents[rows][place] == of)
        at = rows[place[held]]
        side, d2 = _sides(x[held], both[0][at], both[1][at])
        for k in (0, 1):
            mine = side == k
            counts[:, k] += np.bincount(at[mine], minlength=n)
            rss[:, k] += np.bincount(at[mine], d2[mine], minlength=n)
            order = np.argsort(at[mine], kind="stable")
            keys, starts = np.unique(at[mine][order], return_index=True)
            if len(keys):
                sums[k][keys] += np.add.reduceat(x[held[mine]][order], starts, axis=0)
    return counts, rss, sums


def _partial_sums(steps: int):
    """Task that takes ``steps`` - 1 steps, for parents that lie whole in the cell, and gives the sums of one more."""

    def task(points: pa.Table, centers: pa.Table) -> pa.Table:
        n = centers.num_rows
        if n == 0 or points.num_rows == 0:
            return pa.table({f.name: pa.array([], f.type) for f in EMPTY})
        x = _matrix(points["v"], points.num_rows)
        of = points["parent"].to_numpy()
        parents, tries, both = _centers(centers, x.shape[1])
        states = []
        for step in range(steps):
            counts, rss, sums = _pass(x, of, parents, tries, both)
            if step < steps - 1:
                both = [np.where(counts[:, [k]] > 0, sums[k] / np.maximum(counts[:, [k]], 1), both[k]) for k in (0, 1)]
                states.append((rss, both))
        home = np.array(centers["home"])
        told = [[c.tolist() if h and not np.isnan(c).any() else None for c, h in zip(side, home, strict=True)] for side in both]
        past = [[*(p or []), *({"r0": r[i, 0], "c0": c[0][i].tolist(), "r1": r[i, 1], "c1": c[1][i].tolist()} for r, c in states[-2:])] if h else None for i, (p, h) in enumerate(zip(centers["past"].to_pylist(), home, strict=True))]
        return pa.table(
            {
                "parent": centers["parent"], "try": centers["try"], "n0": counts[:, 0], "n1": counts[:, 1], "r0": rss[:, 0], "r1": rss[:, 1],
                "s0": _listed(sums[0]), "s1": _listed(sums[1]), "c0": pa.array(told[0], DOUBLES), "c1": pa.array(told[1], DOUBLES),
                "past": pa.array(past, PAST),
            }
        )

    return task


def _listed(s: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(s.ravel(), s.shape[1]).cast(DOUBLES)


PAST = pa.list_(pa.struct([("r0", pa.float64()), ("c0", DOUBLES), ("r1", pa.float64()), ("c1", DOUBLES)]))
EMPTY = pa.schema(
    [("parent", pa.int64()), ("try", pa.int32()), *[(c, pa.float64()) for c in ("n0", "n1", "r0", "r1")], *[(c, DOUBLES) for c in ("s0", "s1", "c0", "c1")], ("past", PAST)]
)
PARTIAL = (
    "parent long, try int, n0 double, n1 double, r0 double, r1 double, s0 array<double>, s1 array<double>, "
    f"c0 array<double>, c1 array<double>, past array<{STATE}>"
)


def lloyd_step(cells: Cells, centers: DataFrame, steps: int = 1) -> DataFrame:
    """One step of all parents and tries: ``(parent, try, c0, c1, past)`` with the centres moved.

    More ``steps`` may be asked for parents of one slice only.

    ``past`` holds the last three states ``struct(r0, c0, r1, c1)``: RSS of the children in a step, and their centres after it. A
    child without points keeps its centre. Parents without points in ``cells`` drop out.
    """
    parts = _meet(cells, centers, _partial_sums(steps), PARTIAL)
    summed = parts.groupBy("parent", "try").agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "r0", "r1")],
        *[Summarizer.sum(array_to_vector(F.coalesce(c, F.array()))).alias(c) for c in ("s0", "s1")],
        *[F.first(c, ignorenulls=True).alias(c) for c in ("c0", "c1", "past")],
    )

    def mean(k: int) -> Column:
        moved = F.transform(vector_to_array(f"s{k}"), lambda x: x / F.col(f"n{k}"))
        return F.when(F.col(f"n{k}") > 0, moved).otherwise(F.col(f"c{k}"))

    moved = summed.withColumns({"c0": mean(0), "c1": mean(1)})
    state = F.struct("r0", "c0", "r1", "c1").cast(STATE)
    last = F.when(F.size("past") >= 2, F.slice("past", -2, 2)).otherwise(F.col("past"))
    return moved.where("n0 + n1 > 0").select("parent", "try", "c0", "c1", F.concat(last, F.array(state)).alias("past"))


def without_past(centers: DataFrame) -> DataFrame:
    return centers.select("parent", "try", "c0", "c1", F.array().cast(f"array<{STATE}>").alias("past"))


def _nearest_side(points: pa.Table, centers: pa.Table) -> pa.Table:
    ids, children, found = points["point"], np.zeros(0, np.int64), np.zeros(0)
    held = np.zeros(0, np.int64)
    if points.num_rows and centers.num_rows:
        x = _matrix(points["v"], points.num_rows)
        parents, _, both = _centers(centers, x.shape[1])
        rows = np.argsort(parents)
        of = points["parent"].to_numpy()
        place = np.clip(np.searchsorted(parents[rows], of), 0, len(rows) - 1)
        held = np.flatnonzero(parents[rows][place] == of)
        at = rows[place[held]]
        side, found = _sides(x[held], both[0][at], both[1][at])
        children = of[held] * 2 + side
    return pa.table({"point": ids.take(pa.array(held)), "v": points["v"].take(pa.array(held)).cast(DOUBLES), "child": children, "d2": found})


def assign(cells: Cells, centers: DataFrame) -> DataFrame:
    """``(point, v, child, d2)``: each point goes to the nearer of its parent's centres ``(parent, c0, c1)``."""
    given = centers.select("parent", F.lit(0).alias("try"), "c0", "c1")
    kind = cells.points.schema["point"].dataType.simpleString()
    return _meet(cells, without_past(given), _nearest_side, f"point {kind}, v array<double>, child long, d2 double")


def summarize(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, rss, center)``, combined on the map side."""
    return (
        assigned.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.sum("d2").alias("rss"),
            Summarizer.mean(array_to_vector(F.col("v"))).alias("_mean"),
        )
        .withColumn("center", vector_to_array("_mean"))
        .drop("_mean")
    )


def draw(point: Column, seed: int, turn: Column) -> Column:
    """What orders the points of a parent for a restart: MD5 of point, seed and restart, the same in every engine."""
    return F.md5(F.concat_ws(":", point.cast("string"), F.lit(str(seed)), turn.cast("string")))


def seeds(points: DataFrame, tries: int, seed: int) -> DataFrame:
    """``(parent, try, c0, c1)``: the mean of up to ten random points for each child.

    The first points in the order of :func:`draw` go to the children in turn. Every task keeps its first ones only, so a
    large parent is no large group.
    """
    turns = F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try")
    drawn = points.select("parent", "point", turns).withColumn("_draw", draw(F.col("point"), seed, F.col("try")))
    order = Window.partitionBy("parent", "try").orderBy("_draw", "point")
    picked = drawn.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= 2 * SEED_POINTS)
    sided = picked.select("point", "try", (F.col("_rn") % 2).alias("side")).join(points, "point")
    means = sided.groupBy("parent", "try", "side").agg(Summarizer.mean(array_to_vector(F.col("v"))).alias("m"))
    return means.groupBy("parent", "try").agg(
        F.max(F.when(F.col("side") == 1, vector_to_array("m"))).alias("c0"),
        F.max(F.when(F.col("side") == 0, vector_to_array("m"))).alias("c1"),
    )


def _settled(states: Column, delta: float) -> Column:
    """Three states of a child ``struct(r, c)`` sorted by RSS: the two lowest share a centre, or the last gain is small."""
    s = F.array_sort(states)
    gain, before = s[1]["r"] - s[0]["r"], s[2]["r"] - s[1]["r"]
    same = V.sq_distance(s[0]["c"], s[1]["c"]) <= NOISE * NOISE * V.dot(s[0]["c"], s[0]["c"])
    return F.coalesce(same, F.lit(True)) | (before <= (1 + delta) * gain + NOISE * s[2]["r"])


def _no_gain(states: list[tuple[float, np.ndarray]]) -> bool:
    """:func:`_settled` for the three states (RSS, centre) of a child in a task."""
    (r0, c0), (r1, c1), (r2, _) = sorted(states, key=lambda s: (s[0], s[1].tolist()))
    missing = np.isnan(c0).any() or np.isnan(c1).any()
    return bool(missing or ((c0 - c1) ** 2).sum() <= NOISE * NOISE * (c0 @ c0) or r2 - r1 <= (1 + DELTA) * (r1 - r0) + NOISE * r2)


def _all_steps(max_steps: int, check_every: int):
    """Task that trains one restart of a parent, whose points are all there, to its end."""

    def task(points: pa.Table, centers: pa.Table) -> pa.Table:
        if centers.num_rows == 0 or points.num_rows == 0:
            return pa.table({f.name: pa.array([], f.type) for f in WHOLE})
        x = _matrix(points["v"], points.num_rows)
        _, _, both = _centers(centers, x.shape[1])
        both, past, settled = [c[0] for c in both], [], False
        for step in range(1, max_steps + 1):
            side, d2 = _sides(x, *both)
            n = np.bincount(side, minlength=2)
            rss = np.bincount(side, d2, minlength=2).tolist()
            both = [(side == k).astype(np.float64) @ x / n[k] if n[k] else both[k] for k in (0, 1)]
            past = [*past[-2:], (rss, both)]
            if step % check_every == 0 and len(past) == 3 and all(_no_gain([(r[k], c[k]) for r, c in past]) for k in (0, 1)):
                settled = True
                break
        told = [None if np.isnan(c).any() else c.tolist() for c in both]
        return pa.table(
            {
                "parent": centers["parent"], "try": centers["try"], "c0": pa.array([told[0]], DOUBLES), "c1": pa.array([told[1]], DOUBLES),
                "rss": [sum(rss)], "converged": [settled],
            }
        )

    return task


WHOLE = pa.schema([("parent", pa.int64()), ("try", pa.int32()), ("c0", DOUBLES), ("c1", DOUBLES), ("rss", pa.float64()), ("converged", pa.bool_())])


def _train_whole(cells: Cells, first: DataFrame, max_steps: int, check_every: int) -> DataFrame:
    turns = first.select(F.col("parent").alias("parent"), F.col("try").alias("try"))
    points = cells.points.select("parent", "v").join(turns, "parent").groupBy("parent", "try")
    schema = "parent long, try int, c0 array<double>, c1 array<double>, rss double, converged boolean"
    return points.cogroup(first.groupBy("parent", "try")).applyInArrow(_all_steps(max_steps, check_every), schema)


def _of_slices(cells: Cells, centers: DataFrame, which: str) -> DataFrame:
    return centers.join(cells.slices.where(which).select("parent"), "parent", "left_semi")


def train(cells: Cells, first: DataFrame, max_steps: int = MAX_STEPS, check_every: int = CHECK_EVERY) -> DataFrame:
    """Lloyd steps from the first centres until every (parent, try) has converged: ``(parent, try, c0, c1, rss, converged)``.

    Parents that are worth a task and fit in it are trained in one job. For the others the steps between two checks are one job: one
    pass for parents that lie in one cell, a pass a step for larger ones. Converged parents and tries leave the loop. Of ``max_steps`` the last ones
    that make no whole round of ``check_every`` are taken without a check.
    """
    dims, restarts_ = first.select(F.max(F.size("c0")), F.count("*")).first()
    least = WHOLE_LEAST if restarts_ > WHOLE_COUNT else 1
    whole = checkpoint(cells.slices.where(F.col("size").between(least, WHOLE_BYTES // (8 * (dims or 1)))).select("parent"))
    done = [checkpoint(_train_whole(cells, first.join(whole, "parent", "left_semi"), max_steps, check_every))]
    current = checkpoint(without_past(first.join(whole, "parent", "left_anti")))
    if current.isEmpty():
        return done[0]
    sliced_left = not _of_slices(cells, current, "slices > 1").isEmpty()
    for step in range(0, max_steps, check_every):
        steps = min(check_every, max_steps - step)
        moved = lloyd_step(cells, _of_slices(cells, current, "slices = 1"), steps)
        if sliced_left:
            sliced = _of_slices(cells, current, "slices > 1")
            for _ in range(steps):
                sliced = lloyd_step(cells, sliced)
            moved = moved.unionByName(sliced)

        def child(k):
            return F.transform("past", lambda p: F.struct(p[f"r{k}"].alias("r"), p[f"c{k}"].alias("c")))

        settled = (_settled(child(0), DELTA) & _settled(child(1), DELTA)) if steps == check_every else F.lit(False)
        last = F.element_at("past", -1)
        ready = F.when(F.size("past") >= 3, settled).otherwise(False)
        state = checkpoint(moved.select("*", (last["r0"] + last["r1"]).alias("rss"), ready.alias("converged")))
        done.append(state.where("converged").drop("past"))
        current = state.where("not converged").drop("rss", "converged")
        rest = state.where("not converged").drop("past")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, rest])


def restarts(trained: DataFrame) -> DataFrame:
    """``(try, rss, chosen)``: RSS of each restart over all clusters of the level; the lowest is chosen, the first on a tie."""
    total = trained.groupBy("try").agg(F.sum("rss").alias("rss"))
    best = F.min(F.struct(F.round("rss", 9).alias("rss"), "try")).over(Window.partitionBy(F.lit(0)))  # one row per restart
    return total.select("try", "rss", (F.col("try") == best["try"]).alias("chosen"))


@dataclass(frozen=True)
class Bisection:
    """``members(level, point, cluster_id)``, ``clusters(level, cluster_id, center, n, rss, converged)``, ``restarts(level, try, rss, chosen)``."""

    members: DataFrame
    clusters: DataFrame
    restarts: DataFrame


MEMBERS, CLUSTERS, RESTARTS = ("level", "point", "cluster_id"), ("level", "cluster_id", "center", "n", "rss", "converged"), ("level", "try", "rss", "chosen")


def bisect(
    points: DataFrame, levels: int = LEVELS, tries: int = TRIES, max_steps: int = MAX_STEPS, seed: int = 42, cell_rows: int = CELL_ROWS
) -> Bisection:
    """Split ``points(point, v)`` level by level; level 0 is the whole set, with id 1.

    A cluster of one point, or of copies of one point, is not split again: from then on it has one child a level, with the
    even id. Ends early when no cluster can be split. Point ids must be unique; without points all tables are empty.
    """
    root = checkpoint(points.select(F.lit(1).cast("long").alias("parent"), "point", V.doubles(F.col("v")).alias("v")))
    mean = V.mean_vectors(root, ["parent"], name="c0").select("parent", "c0", F.lit(None).cast("array<double>").alias("c1"))
    whole = summarize(assign(in_cells(root, cell_rows=cell_rows), mean), ["child"])
    clusters = checkpoint(whole.select(F.lit(0).alias("level"), F.lit(1).cast("long").alias("cluster_id"), "center", "n", "rss", F.lit(True).alias("converged")))
    least = F.lit(NOISE * NOISE) * F.lit(clusters.agg(F.sum("rss")).first()[0] or 0.0)
    current = root
    members = [root.select(F.lit(0).alias("level"), "point", F.col("parent").alias("cluster_id"))]
    every, tried, closed = [clusters], [], []
    last = 0
    for level in range(1, levels + 1):
        sizes = clusters.select(F.col("cluster_id").alias("parent"), F.col("n").alias("size"), "rss", "center")
        can_split = (F.col("size") > 1) & (F.col("rss") > least)
        ended = sizes.where(~can_split)
        closed.append((level - 1, current.join(ended.select("parent"), "parent", "left_semi"), clusters.where(~((F.col("n") > 1) & (F.col("rss") > least)))))
        if sizes.where(can_split).isEmpty():
            break
        last = level
        cells = in_cells(current, sizes.where(can_split), tries, cell_rows)
        trained = checkpoint(train(cells, checkpoint(seeds(cells.points, tries, seed + level)), max_steps))
        judged = checkpoint(restarts(trained).select(F.lit(level).alias("level"), "try", "rss", "chosen"))
        best = checkpoint(trained.join(F.broadcast(judged.where("chosen").select("try")), "try", "left_semi"))  # one row
        moved = checkpoint(assign(cells, best))
        drop_step(cells.points, trained)
        made = summarize(moved, ["child"]).join(
            best.select(F.col("parent").alias("_parent"), "converged"), F.expr("shiftright(child, 1) = _parent")
        )
        clusters = checkpoint(made.select(F.lit(level).alias("level"), F.col("child").alias("cluster_id"), "center", "n", "rss", "converged"))
        current = moved.select(F.col("child").alias("parent"), "point", "v")
        members.append(current.select(F.lit(level).alias("level"), "point", F.col("parent").alias("cluster_id")))
        every.append(clusters)
        tried.append(judged)
    for at, held, rows in closed:
        # one child a level, with the even id
        below = F.explode(F.sequence(F.lit(at + 1), F.lit(last))).alias("level") if at < last else None
        if below is not None:
            again = F.expr(f"shiftleft({{}}, level - {at})".format("cluster_id"))
            members.append(held.select(below, "point", F.col("parent").alias("cluster_id")).withColumn("cluster_id", again))
            every.append(rows.drop("level").select(below, "*").withColumns({"cluster_id": again, "converged": F.lit(True)}))
    none = points.sparkSession.createDataFrame([], "level int, try int, rss double, chosen boolean")
    return Bisection(
        reduce(DataFrame.unionByName, [m.select(*MEMBERS) for m in members]),
        reduce(DataFrame.unionByName, [c.select(*CLUSTERS) for c in every]),
        reduce(DataFrame.unionByName, [none, *(t.select(*RESTARTS) for t in tried)]),
    )


def cluster_report(clusters: DataFrame, labels: DataFrame, top: int = 2) -> DataFrame:
    """``(level, cluster_id, n, rank, topic, label, p)``: cluster sizes with the strongest topics of the centre."""
    from topicloom.operators.topics import top_n

    long = clusters.select("level", "cluster_id", "n", F.posexplode("center").alias("topic", "p"))
    return top_n(long, ["level", "cluster_id"], "p", "topic", top).join(labels, "topic", "left").select(
        "level", "cluster_id", "n", "rank", "topic", "label", "p"
    )
