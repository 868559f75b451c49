"""Commit sources on tables: ``commits(id, ts, n_parents or parents, ...)``, ``changes(id, status, old_path,
new_path)``, ``tags(tag, ts)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import paths as P
from topicloom.operators import asof


def files_changed(changes: DataFrame) -> DataFrame:
    """``(id, path)``, distinct. Long form: one commit may change any number of files."""
    path = P.changed_path(F.col("status"), F.col("old_path"), F.col("new_path"))
    return changes.select("id", path.alias("path")).distinct()


def no_merges(commits: DataFrame) -> DataFrame:
    parents = F.size("parents") if "parents" in commits.columns else F.col("n_parents")
    return commits.filter(parents <= 1)


def commit_log(
    commits: DataFrame,
    files: DataFrame | None = None,
    since: str | None = None,
    until: str | None = None,
    paths: list[str] | None = None,
    merges: bool = False,
) -> DataFrame:
    """Commits in (since, until] that touch any of ``paths`` (files or directories), merges left out unless asked."""
    log = commits if merges else no_merges(commits)
    if since is not None:
        log = log.filter(F.col("ts") > F.lit(since).cast("timestamp"))
    if until is not None:
        log = log.filter(F.col("ts") <= F.lit(until).cast("timestamp"))
    if paths:
        touched = F.lit(False)
        for p in paths:
            touched = touched | (F.col("path") == p) | F.startswith("path", F.lit(p.rstrip("/") + "/"))
        log = log.join(files.filter(touched).select("id"), "id", "left_semi")
    return log


def listed_commits(commits: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the commits whose id is listed."""
    return commits.join(ids.select("id").distinct(), "id", "left_semi")


def stable_commits(commits: DataFrame, tags: DataFrame, files: DataFrame | None = None, paths=None) -> DataFrame:
    """Commits of the stable series, with ``version``; candidates and pre-releases are left out."""
    log = commit_log(commits, files, paths=paths)
    in_series = asof.in_ranges(log, asof.stable_ranges(tags))
    described = asof.asof_join(in_series, tags).withColumnRenamed("tag", "version").drop("tag_ts")
    return described.filter(~F.coalesce(F.col("version"), F.lit("")).rlike("-rc|-pre"))


def release_tags(tags: DataFrame) -> DataFrame:
    """Tags that point to a commit with a time."""
    return tags.filter(F.col("ts").isNotNull()).select("tag", "ts")
