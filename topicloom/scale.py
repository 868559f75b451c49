"""Helpers that keep a plan distributed: checkpoints, dense ids, ranks inside hot groups."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A DataFrame with at most this many rows may be sent whole to every executor or to the driver.
SMALL_ROWS = 200_000

# Inputs of fewer bytes per core than this are spread by hand.
SPLIT_BYTES = 4 << 20

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ship_with_tasks(module_name: str) -> None:
    """Send the functions of a module along with the tasks, so that executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="topicloom-"))
    return sc.getCheckpointDir().rstrip("/")


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Shuffle files of the jobs run inside are deleted as soon as these have ended; the session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs no recomputation.

    A written table, unlike an RDD checkpoint, also gives the optimizer its true size, which iterative
    plans need to choose their joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._step_path = path
    return table


def checkpoint_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As :func:`checkpoint`, dealt out by ``key`` into ``parts`` buckets.

    Joins and groups on ``key`` read the table without moving it, however often it is read.
    """
    spark = df.sparkSession
    name = f"step_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/step-{name}"
    with _shuffles_go(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table._step_path, table._step_name = path, name
    return table


def drop_step(*tables: DataFrame) -> None:
    """Delete tables that :func:`checkpoint` and :func:`checkpoint_by` wrote, once nothing reads them; others are left alone."""
    for table in tables:
        path = getattr(table, "_step_path", None)
        if getattr(table, "_step_name", None):
            table.sparkSession.sql(f"drop table if exists {table._step_name}")
        if path is not None and "/step-" in path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def ordered_index(df: DataFrame, order_by: list[str | Column], name: str = "idx") -> DataFrame:
    """Add a dense 0-based index in the order of ``order_by`` without a one-partition window.

    The rows are range-partitioned and sorted once; the index is the row's place in its partition plus
    the sizes of the partitions before it. End ``order_by`` with a unique column, so that a value that
    many rows share is still split over partitions.
    """
    placed = checkpoint(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", _ROW_BITS))
    # one row per partition: safe to order in one window and to broadcast
    offsets = (
        placed.groupBy("_part")
        .count()
        .select(
            "_part",
            F.coalesce(
                F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_part", "_place", "_offset")
    )


def rank_within(
    df: DataFrame, keys: list[str], order_by: list[str | Column], name: str = "rank"
) -> DataFrame:
    """Add a 1-based rank inside each key group; a hot group is ranked by many tasks."""
    indexed = ordered_index(df, [*keys, *order_by], "_idx")
    first = indexed.groupBy(*keys).agg(F.min("_idx").alias("_first"))
    return (
        indexed.join(first, keys)
        .withColumn(name, F.col("_idx") - F.col("_first") + 1)
        .drop("_idx", "_first")
    )


def count_within(df: DataFrame, limit: int) -> int | None:
    """The row count if it is at most ``limit``, else None; reads no more rows than needed."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows over the cores when the input is too small to give each core a file split.

    For CPU-heavy row work on few files. Decided from the optimizer's size estimate, so nothing is run; on
    large inputs the scan has splits enough and nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPLIT_BYTES else df
