"""Reports on a weight table ``(doc, topic, p)`` or on vectors ``(doc, v)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import vectors as V


def weights(vectors: DataFrame, id_col: str = "doc", v: str = "v") -> DataFrame:
    """``(doc, topic, p)`` of a vector table."""
    return vectors.select(F.col(id_col), F.posexplode(v).alias("topic", "p"))


def top_n(df: DataFrame, keys: list[str], value: str, tie: str, n: int, non_zero: bool = False) -> DataFrame:
    """The ``n`` largest values of each key with their rank. Planned as a group limit before the shuffle."""
    source = df.filter(F.col(value) != 0) if non_zero else df
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(tie))
    return source.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def topic_labels(topic_terms: DataFrame, words: int = 2) -> DataFrame:
    """``(topic, label)``, label ``T<topic>-<word>-<word>`` of the ``words`` strongest terms."""
    best = top_n(topic_terms, ["topic"], "p", "term", words)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
    return best.groupBy("topic").agg(ordered.alias("_words")).select("topic", label(F.col("topic"), F.col("_words")))


def label(topic: Column, words: Column) -> Column:
    return F.concat_ws("-", F.concat(F.lit("T"), topic.cast("string")), words).alias("label")


def in_group(df: DataFrame, group: DataFrame, id_col: str = "doc") -> DataFrame:
    """Rows whose id is in ``group``."""
    return df.join(group.select(id_col), id_col, "left_semi")


def distance_to_centroid(vectors: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Add the group's ``center`` and the squared distance ``d2`` to it."""
    centers = V.mean_vectors(vectors, keys, v).drop("n")
    return vectors.join(centers, keys).withColumn("d2", V.sq_distance(F.col(v), F.col("center")))


def topic_share(weights_: DataFrame, groups: DataFrame, key: str, id_col: str = "doc") -> DataFrame:
    """``(topic, key, p)``: p(topic | key) = sum over the key's documents of p(topic | doc) / documents of the key.

    ``groups(doc, key)`` lists each corpus document once per key.
    """
    member = groups.select(id_col, key).distinct()
    n_docs = member.groupBy(key).agg(F.count("*").alias("_n"))
    sums = weights_.join(member, id_col).groupBy("topic", key).agg(F.sum("p").alias("_sum"))
    return sums.join(n_docs, key).select("topic", key, (F.col("_sum") / F.col("_n")).alias("p"))


def sorted_map(entries: Column, descending: bool = True) -> Column:
    """Entries of a map ordered by value, then key."""
    sign = -1 if descending else 1

    def compare(a, b):
        return (
            F.when(a["value"] < b["value"], -sign)
            .when(a["value"] > b["value"], sign)
            .when(a["key"] < b["key"], -1)
            .when(a["key"] > b["key"], 1)
            .otherwise(0)
        )

    return F.array_sort(F.map_entries(entries), compare)
