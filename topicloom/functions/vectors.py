"""Array-of-double vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def sq_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def l1_normalized(v: Column) -> Column:
    norm = _total(F.transform(v, F.abs))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def mean_vectors(df: DataFrame, keys: list[str], v: str = "v", name: str = "center") -> DataFrame:
    """``(keys, n, center)``: mean vector of each group, combined on the map side."""
    vec = array_to_vector(F.col(v))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"), Summarizer.mean(vec).alias("_mean"))
        .withColumn(name, vector_to_array("_mean"))
        .drop("_mean")
    )
