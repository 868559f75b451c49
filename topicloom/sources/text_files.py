"""Text file sources: separated records, rules, tags, id lists, delimited lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.scale import rank_within

COMMENT = r"^\s*#.*$"
LINES_PER_BLOCK = 65_536


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)``: lines with their number from 1; a large file is read and numbered by many tasks."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    return rank_within(lines, ["file"], ["_start", "_at"], "line").select("file", "line", "value")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def read_separated(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(doc_id, text)``: id and text sections take turns between lines that equal the separator.

    A record counts only if a separator closes it.
    """
    lines = numbered_lines(spark, path).withColumn("_sep", (F.col("value") == separator).cast("int"))
    blocked = lines.withColumn("_block", F.floor(F.col("line") / LINES_PER_BLOCK))
    per_block = blocked.groupBy("file", "_block").agg(F.sum("_sep").alias("_seps"))
    # one row per 65536 lines
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("file", "_block", F.coalesce(F.sum("_seps").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("file", "_block").orderBy("line")
    counted = (
        blocked.withColumn("_count", F.sum("_sep").over(inside))
        .join(offsets, ["file", "_block"])
        .withColumn("section", F.col("_count") + F.col("_offset"))
    )
    closed = per_block.groupBy("file").agg(F.sum("_seps").alias("_total"))
    # sections 1, 3, 5, ... are ids and 2, 4, 6, ... are texts
    body = (
        counted.filter("_sep = 0 and section > 0")
        .join(closed, "file")
        .withColumn("record", F.floor((F.col("section") - 1) / 2))
        .filter(F.col("_total") >= 2 * F.col("record") + 3)
    )

    def section(is_id: bool) -> Column:
        # one group is one record
        mine = F.when(F.col("section") % 2 == (1 if is_id else 0), F.struct("line", "value"))
        ordered = F.transform(F.sort_array(F.collect_list(mine)), lambda x: x["value"])
        return _trim(F.array_join(ordered, "\n"))

    return body.groupBy("file", "record").agg(section(True).alias("doc_id"), section(False).alias("text")).select("doc_id", "text")


def write_separated(docs: DataFrame, path: str, separator: str) -> None:
    """``(doc_id, text)`` in the layout of :func:`read_separated`.

    Each record closes itself and is followed by an empty one, so records can stand in any order in any file.
    """
    lines = [F.lit(separator), F.col("doc_id").cast("string"), F.lit(separator), F.col("text"), F.lit(separator), F.lit(separator)]
    docs.select(F.concat_ws("\n", *lines).alias("value")).write.text(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``(name, regex)`` of lines ``"name","regex"``; comments and broken lines are skipped, a later name wins."""
    lines = spark.read.text(path).select(
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("_place"),
        "value",
    )
    pattern = r'^"(.*)","(.*)"$'
    kept = lines.filter(~F.col("value").rlike(COMMENT) & F.col("value").rlike(pattern))
    return (
        kept.select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("regex"), "_place")
        .groupBy("name")
        .agg(F.max_by("regex", "_place").alias("regex"))
    )


def read_doc_tags(spark: SparkSession, path: str) -> DataFrame:
    """``(row, col, value)``: 1 for every tag of lines ``doc,tag,tag,...``; blank lines are skipped."""
    parts = spark.read.text(path).filter("value != ''").select(F.split("value", ",").alias("p"))
    return (
        parts.select(F.element_at("p", 1).alias("row"), F.explode(F.slice("p", 2, F.size("p") - 1)).alias("col"))
        .filter("col != ''")
        .distinct()
        .withColumn("value", F.lit(1.0))
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """``(id)``, distinct."""
    return spark.read.text(path).select(_trim(F.col("value")).alias("id")).filter("id != ''").distinct()


def read_id_group(spark: SparkSession, path: str, id_col: str = "doc") -> DataFrame:
    """``(doc)``: one whole number per line."""
    return spark.read.text(path).select(F.col("value").cast("long").alias(id_col)).distinct()


def read_delimited(spark: SparkSession, path: str, regex: str) -> DataFrame:
    """``(fields)``: lines split at a pattern, comment lines left out."""
    return spark.read.text(path).filter(~F.col("value").rlike(COMMENT)).select(F.split("value", regex).alias("fields"))
