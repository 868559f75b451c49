"""Cross tables of labelled records.

A record set is a key table ``(key, objective)`` and a label table ``(key, var)``; keys and labels are
distinct. A record without labels keeps its key and counts as a row of zeros.

A wide table has one column per label, however many there are. It is a table of lines: the places of a row's cells,
sorted, become its text in one pass, with as many zeros between them as the places say. No plan has a column per label.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.scale import ordered_index


class Records(NamedTuple):
    keys: DataFrame  # (key, objective)
    labels: DataFrame  # (key, var)


def with_prefix(records: Records, prefix: str) -> Records:
    """Keep the labels that start with ``prefix`` and strip it."""
    kept = records.labels.filter(F.startswith("var", F.lit(prefix)))
    return Records(records.keys, kept.withColumn("var", F.expr(f"substr(var, {len(prefix) + 1})")))


def matching(records: Records, regex: str) -> Records:
    """Keep the labels that match the whole pattern."""
    return Records(records.keys, records.labels.filter(F.col("var").rlike(f"^(?:{regex})$")))


def holding(records: Records, label: str) -> Records:
    """Only records that hold ``label``; all their labels stay."""
    have = records.labels.filter(F.col("var") == label).select("key")
    return Records(
        records.keys.join(have, "key", "left_semi"), records.labels.join(have, "key", "left_semi")
    )


def rekey(records: Records, feature_prefix: str, objective_prefix: str) -> Records:
    """Labels with one prefix stay labels; each label with the other prefix makes a record with that objective."""
    features = with_prefix(records, feature_prefix).labels
    others = records.labels.filter(~F.startswith("var", F.lit(feature_prefix)))
    objectives = with_prefix(Records(records.keys, others), objective_prefix).labels.withColumnRenamed("var", "objective")
    keys = objectives.select(F.concat_ws("-O:", F.col("key").cast("string"), "objective").alias("key"), "objective")
    labels = objectives.join(features, "key").select(
        F.concat_ws("-O:", F.col("key").cast("string"), "objective").alias("key"), "var"
    )
    return Records(keys, labels)


def components(records: Records, label: str, prefix: str) -> Records:
    """Components (``dir/subdir``) of the records that hold ``label``."""
    kept = with_prefix(holding(records, label), prefix)
    return Records(kept.keys, kept.labels.withColumn("var", F.replace("var", F.lit(":"), F.lit("/"))))


def label_counts(records: Records) -> DataFrame:
    return records.labels.groupBy("var").agg(F.count("*").alias("n"))


def objective_counts(records: Records) -> DataFrame:
    return records.keys.groupBy("objective").agg(F.count("*").alias("n"))


def contingency(records: Records) -> DataFrame:
    """``(objective, var, n)``, long form."""
    return records.keys.join(records.labels, "key").groupBy("objective", "var").agg(F.count("*").alias("n"))


def counts_with_total(records: Records) -> DataFrame:
    """Label counts, largest first, and a last row ``total``."""
    counts = label_counts(records)
    total = counts.agg(F.lit("total").alias("var"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    both = counts.withColumn("_last", F.lit(0)).unionByName(total.withColumn("_last", F.lit(1)))
    return both.orderBy("_last", F.desc("n"), "var").drop("_last")


def in_places(names: DataFrame, order: list[str | Column]) -> DataFrame:
    """``(at, name)``: dense places of the columns ``names(name, ...)`` in the given order."""
    return ordered_index(names, order, "at").select("at", "name")


def by_count(records: Records) -> DataFrame:
    """Places of the labels, by total descending."""
    return in_places(label_counts(records).withColumnRenamed("var", "name"), [F.desc("n"), "name"])


def by_name(records: Records) -> DataFrame:
    """Places of the labels in name order."""
    return in_places(records.labels.select(F.col("var").alias("name")).distinct(), ["name"])


class Wide(NamedTuple):
    columns: DataFrame  # (at, name)
    lines: DataFrame  # (key columns, line): the cells of a row in column order, joined by commas


def wide(rows: DataFrame, keys: list[str], cells: DataFrame, columns: DataFrame, empty: str = "0") -> Wide:
    """Lines of all ``rows(keys)`` from ``cells(keys, name, value)``; a cell that is not there is ``empty``.

    One shuffle of the cells. A row's cells are together in memory, as its line is, and no more than there are columns.
    """
    width = columns.count()
    placed = cells.join(columns, "name").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", F.col("value").cast("string").alias("value")))).alias("_cells"))
    full = rows.select(*keys).join(placed, keys, "left").withColumn("_cells", F.coalesce("_cells", F.array()))

    def gap(count: Column) -> Column:
        return F.repeat(F.lit(f",{empty}"), count.cast("int"))

    def cell(c: Column, i: Column) -> Column:
        before = F.when(i == 0, -1).otherwise(F.get(F.col("_cells.at"), (i - 1).cast("int")))
        return F.concat(gap(c["at"] - before - 1), F.lit(","), c["value"])

    last = F.coalesce(F.element_at(F.col("_cells.at"), F.when(F.size("_cells") > 0, -1).otherwise(None)), F.lit(-1))
    text = F.concat(F.array_join(F.transform("_cells", cell), ""), gap(F.lit(width - 1) - last))
    return Wide(columns, full.select(*keys, F.substring(text, 2, 2**31 - 1).alias("line")))


def contingency_wide(records: Records) -> Wide:
    """One line per objective with the counts of all labels, columns by total descending."""
    cells = contingency(records).select("objective", F.col("var").alias("name"), F.col("n").alias("value"))
    return wide(records.keys.select("objective").distinct(), ["objective"], cells, by_count(records))


def binary_wide(records: Records) -> Wide:
    """One 0/1 line per record, columns in name order."""
    cells = records.keys.join(records.labels, "key").select("key", "objective", F.col("var").alias("name"), F.lit(1).alias("value"))
    return wide(records.keys, ["key", "objective"], cells, by_name(records))


def binary_long(records: Records) -> DataFrame:
    """``(key, objective, var, value)``: the 1 cells only."""
    return records.keys.join(records.labels, "key").withColumn("value", F.lit(1))


def from_wide(table: Wide) -> Records:
    """Back from a 0/1 table. Lines are split where they lie, only cells that are not 0 move."""
    split = table.lines.select("key", "objective", F.split("line", ",").alias("_cells"))
    cells = split.select("key", F.posexplode("_cells").alias("at", "value")).where("value <> '0' and value <> ''")
    names = table.columns.select(F.col("at").cast("long").alias("at"), F.col("name").alias("var"))
    labels = cells.join(names, "at").select("key", "var")
    return Records(table.lines.select("key", "objective"), labels)


def taxonomy_listing(taxonomy: DataFrame) -> DataFrame:
    """``(class, subclass, errors)``, errors joined in name order; a taxonomy is a short hand-written list."""
    return taxonomy.groupBy("class", "subclass").agg(
        F.concat_ws(", ", F.sort_array(F.collect_set("error"))).alias("errors")
    )
