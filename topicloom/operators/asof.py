"""Commits and release tags: as-of joins, release ranges, distance from a tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.scale import rank_within

DAY = 86_400

# The name before the first release, and the majors whose two-part tags open a range of their own.
NO_RELEASE = "rc"
RANGE_MAJORS = ["v2.6", "v3", "v4"]


def is_release(tag: Column) -> Column:
    """Neither a release candidate nor a suffixed tag, and starts with ``v``."""
    return ~F.contains(tag, F.lit("rc")) & ~F.contains(tag, F.lit("-")) & F.startswith(tag, F.lit("v"))


def _bucket(ts: Column, width: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / width)


def asof_join(
    commits: DataFrame,
    tags: DataFrame,
    ts: str = "ts",
    width: int = DAY,
    default: str | None = None,
) -> DataFrame:
    """Add ``tag`` and ``tag_ts`` of the latest tag whose time is not after the commit's.

    Tags become intervals inside time buckets of ``width`` seconds, so the join has an equality key and
    reads each commit once; adaptive execution splits a bucket with too many commits. Only the list of
    buckets, at most (time span / width) rows, goes through a single window.
    """
    at = tags.groupBy(F.col("ts").alias("tag_ts")).agg(F.max("tag").alias("tag"))
    at = at.withColumn("_bucket", _bucket(F.col("tag_ts"), width))
    inside = at.withColumn("_to", F.lead("tag_ts").over(Window.partitionBy("_bucket").orderBy("tag_ts")))

    left = commits.withColumn("_bucket", _bucket(F.col(ts), width))
    last = at.groupBy("_bucket").agg(
        F.max_by(F.struct("tag", "tag_ts"), "tag_ts").alias("_last"), F.min("tag_ts").alias("_first_ts")
    )
    buckets = left.select("_bucket").distinct().join(last, "_bucket", "full")
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        buckets.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .filter(F.col("_carry").isNotNull())
        .select("_carry.tag", "_carry.tag_ts", "_bucket", F.col("_first_ts").alias("_to"), F.lit(True).alias("_open"))
    )
    spans = inside.withColumn("_open", F.lit(False)).unionByName(carried)
    on = (
        (left["_bucket"] == spans["_bucket"])
        & (F.col("_open") | (left[ts] >= F.col("tag_ts")))
        & (F.col("_to").isNull() | (left[ts] < F.col("_to")))
    )
    joined = left.join(spans, on, "left").drop("_bucket", "_to", "_open")
    return joined.fillna(default, ["tag"]) if default is not None else joined


def with_release(commits: DataFrame, tags: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``release``: the latest release not after the commit, or ``rc`` before the first one."""
    releases = tags.filter(is_release(F.col("tag")))
    return asof_join(commits, releases, ts, default=NO_RELEASE).withColumnRenamed("tag", "release").drop("tag_ts")


def describe(commits: DataFrame, tags: DataFrame, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """Add ``version`` (the nearest earlier tag of any kind) and ``n_since`` (place among the commits since it)."""
    tagged = asof_join(commits, tags, ts).withColumnRenamed("tag", "version")
    known = tagged.filter(F.col("version").isNotNull())
    ranked = rank_within(known, ["tag_ts", "version"], [ts, id_col], "n_since")
    unknown = tagged.filter(F.col("version").isNull()).withColumn("n_since", F.lit(None).cast("long"))
    return ranked.unionByName(unknown).select(*commits.columns, "version", "n_since")


def major(tag: Column) -> Column:
    """The tag up to its last dot."""
    return F.regexp_extract(tag, r"^(.*)\.[^.]*$", 1)


def latest_per_major(tags: DataFrame) -> DataFrame:
    """``(series, tag, ts)``: the newest point release of each series; a two-part tag opens a series."""
    releases = tags.filter(is_release(F.col("tag")) & F.contains("tag", F.lit(".")))
    series = F.when(major(F.col("tag")).isin(RANGE_MAJORS), F.col("tag")).otherwise(major(F.col("tag")))
    return (
        releases.withColumn("series", series)
        .groupBy("series")
        .agg(F.max(F.struct("ts", "tag")).alias("_newest"))
        .select("series", "_newest.tag", "_newest.ts")
    )


def stable_ranges(tags: DataFrame) -> DataFrame:
    """``(series, since, until)``: from the tag that opens a series to its newest point release."""
    newest = latest_per_major(tags)
    opened = tags.groupBy(F.col("tag").alias("series")).agg(F.min("ts").alias("since"))
    return newest.join(opened, "series").select("series", "since", F.col("ts").alias("until"))


def in_ranges(commits: DataFrame, ranges: DataFrame, ts: str = "ts", width: int = DAY) -> DataFrame:
    """Commits in (since, until] of any range, each once. Ranges are spread over time buckets for an equality key."""
    spread = ranges.filter(F.col("since") < F.col("until")).select(
        "since",
        "until",
        F.explode(F.sequence(_bucket(F.col("since"), width), _bucket(F.col("until"), width))).alias("_bucket"),
    )
    left = commits.withColumn("_bucket", _bucket(F.col(ts), width))
    on = (
        (left["_bucket"] == spread["_bucket"]) & (left[ts] > spread["since"]) & (left[ts] <= spread["until"])
    )
    return left.join(spread, on, "left_semi").drop("_bucket")
