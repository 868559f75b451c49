"""Named matrices as coordinate tables ``(row, col, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.scale import rank_within


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """A x B. Partial sums are combined before the second shuffle."""
    left = a.select("row", F.col("col").alias("_k"), F.col("value").alias("_a"))
    right = b.select(F.col("row").alias("_k"), "col", F.col("value").alias("_b"))
    return left.join(right, "_k").groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def scale(m: DataFrame, by: float | Column) -> DataFrame:
    return m.withColumn("value", F.col("value") * by)


def divide(m: DataFrame, by: float | Column) -> DataFrame:
    return m.withColumn("value", F.col("value") / by)


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def _paired(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), ["row", "col"], how)


def times_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell; a cell missing on either side is 0 and is left out."""
    return _paired(a, b, "inner").select("row", "col", (F.col("_a") * F.col("_b")).alias("value"))


def divide_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell over the cells of ``b``; a missing cell of ``a`` is 0."""
    numerator = F.coalesce("_a", F.lit(0.0))
    return _paired(a, b, "right").select("row", "col", F.try_divide(numerator, F.col("_b")).alias("value"))


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("value").alias("value"))


def row_sums(m: DataFrame) -> DataFrame:
    """``(row, value)``: the product with a matrix of ones, without building it."""
    return m.groupBy("row").agg(F.sum("value").alias("value"))


def normalize_rows(m: DataFrame) -> DataFrame:
    """Divide each row by the sum of its absolute values."""
    norm = m.groupBy("row").agg(F.sum(F.abs("value")).alias("_norm"))
    return m.join(norm, "row").select("row", "col", F.try_divide("value", "_norm").alias("value"))


def entropy(m: DataFrame) -> DataFrame:
    """``(row, entropy)`` in bits; an empty cell adds nothing."""
    v = F.col("value")
    return m.groupBy("row").agg((-F.sum(F.when(v > 0, v * F.log2(v)).otherwise(0.0))).alias("entropy"))


def sort_columns(m: DataFrame) -> DataFrame:
    """Add ``rank`` of each cell in its row by value, largest first."""
    return rank_within(m, ["row"], [F.desc("value"), F.asc("col")])


def sort_rows_by_entropy(m: DataFrame) -> DataFrame:
    return m.join(entropy(m), "row").orderBy("entropy", "row", "col")


def lost_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row names of ``a`` that ``b`` does not have."""
    return a.select("row").distinct().join(b.select("row").distinct(), "row", "left_anti")


def drop_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    return m.join(rows.select("row"), "row", "left_anti")


def _shared(doc_tags: DataFrame, doc_topics: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Normalised tags and topics of the documents that have both, and their number."""
    tags = normalize_rows(doc_tags.join(doc_topics.select("row").distinct(), "row", "left_semi"))
    topics = doc_topics.join(tags.select("row").distinct(), "row", "left_semi")
    return tags, topics, tags.select("row").distinct().agg(F.count("*")).scalar()


def joint(doc_tags: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """p(tag & topic) = sum over documents of p(tag | doc) p(topic | doc) / documents.

    Rows are documents on both sides; documents on one side only are left out (see :func:`lost_rows`).
    """
    tags, topics, n_docs = _shared(doc_tags, doc_topics)
    return divide(product(transpose(tags), topics), n_docs)


def harmony(doc_tags: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """2 p(tag & topic) / (p(tag) + p(topic)) for every tag and topic that share a document."""
    tags, topics, n_docs = _shared(doc_tags, doc_topics)
    both = divide(product(transpose(tags), topics), n_docs)
    p_tag = divide(row_sums(transpose(tags)), n_docs).select("row", F.col("value").alias("_tag"))
    p_topic = divide(row_sums(transpose(topics)), n_docs).select(
        F.col("row").alias("col"), F.col("value").alias("_topic")
    )
    return (
        both.join(p_tag, "row")
        .join(p_topic, "col")
        .select("row", "col", (2 * F.col("value") / (F.col("_tag") + F.col("_topic"))).alias("value"))
    )
