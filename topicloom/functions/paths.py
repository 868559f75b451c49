"""File paths of changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of change whose new path counts; for the others the old path does.
NEW_PATH_STATUS = ["ADD", "COPY", "RENAME"]


def changed_path(status: Column, old_path: Column, new_path: Column) -> Column:
    return F.when(status.isin(NEW_PATH_STATUS), new_path).otherwise(old_path)


def ancestors(path: Column) -> Column:
    """All parent directories of a file; a file at the top has none."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    # sequence(1, 0) would count down, so files at the top get an empty array first
    return F.when(
        depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ).otherwise(F.array().cast("array<string>"))
