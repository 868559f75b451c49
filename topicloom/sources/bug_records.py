"""Bug records in JSON: ``{id: {"type": fix | [fix, ...] | "class:..."}}``, and the error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.labels import fix_labels, string_or_array
from topicloom.operators.crosstab import Records
from topicloom.scale import SMALL_ROWS, count_within, spread


def read_bug_files(spark: SparkSession, path: str) -> DataFrame:
    """``(objective, id, type)`` of every ``.json`` file in a folder; the file name is the objective.

    An id that is in several files is one record, that of the last file by name.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    stem = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]*)\.json$", 1)
    parsed = files.select(stem.alias("objective"), F.parse_json("value").alias("bugs"))
    entries = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("bugs").outer()))
    found = entries.select(
        "objective", F.col("key").alias("id"), F.variant_get("value", "$.type", "variant").alias("type")
    )
    last = found.groupBy("id").agg(F.max("objective").alias("objective"))
    return found.join(last, ["objective", "id"], "left_semi")


def malformed(fix_table: DataFrame) -> DataFrame:
    """``(objective, key, missing)`` of fixes that are no build failures and lack fields that labels come from.

    Labels are made of what is there; look at this table before trusting counts.
    """
    fix = F.col("fix")
    fields = {"when": F.try_variant_get(fix, "$.when", "string")} | {
        name: string_or_array(fix, f"$.{name}") for name in ("fix", "if", "errors")
    }
    absent = F.array_compact(F.array(*(F.when(_nothing(value), F.lit(name)) for name, value in fields.items())))
    built = F.coalesce(F.startswith(fields["when"], F.lit("build")), F.lit(False))
    asked = fix_table.where("kind = 'fix'").select("objective", "key", F.when(~built, absent).alias("missing"))
    return asked.where(F.size("missing") > 0)


def _nothing(value: Column) -> Column:
    """Null, or an array that holds nothing but null."""
    return F.coalesce(F.to_json(F.array(value)).isin("[null]", "[]", "[[null]]"), F.lit(True))


def fixes(bugs: DataFrame) -> DataFrame:
    """``(objective, key, kind, fix)``: one row per fix. An array gives ``<id>-F<i>``; an empty object gives none."""
    kind = F.schema_of_variant("type")

    def case(key, name, fix):
        return F.struct(key.alias("key"), F.lit(name).alias("kind"), fix.alias("fix"))

    several = F.transform(
        F.try_variant_get("type", "$", "array<variant>"),
        lambda f, i: case(F.concat(F.col("id"), F.lit("-F"), i.cast("string")), "fix", f),
    )
    cases = (
        F.when(F.startswith(kind, F.lit("ARRAY")), several)
        .when(kind == "OBJECT<>", F.array())
        .when(F.startswith(kind, F.lit("OBJECT")), F.array(case(F.col("id"), "fix", F.col("type"))))
        .otherwise(F.array(case(F.col("id"), "class", F.col("type"))))
    )
    return spread(bugs, "id").select("objective", F.inline(cases))


def to_records(fix_table: DataFrame, taxonomy: DataFrame) -> Records:
    """Keys and distinct labels of the fixes, with error classes from ``taxonomy(error, class, subclass)``."""
    named = F.array(F.concat(F.lit("fixclass:"), F.split_part(F.variant_get("fix", "$", "string"), F.lit(":"), F.lit(1))))
    labels = F.when(F.col("kind") == "class", named).otherwise(fix_labels(F.col("fix")))
    base = fix_table.select("key", F.explode(labels).alias("var"))
    return Records(fix_table.select("key", "objective"), with_error_classes(base, taxonomy).distinct())


def with_error_classes(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Every label, and for an ``error:`` label that the taxonomy knows its class, subclass and error labels."""
    # a label that is no error gets a key of its own, so that they do not all meet in one task
    error = F.when(F.startswith("var", F.lit("error:")), F.expr("substr(var, 7)")).otherwise(F.concat(F.lit("\0"), "key"))
    small = count_within(taxonomy, SMALL_ROWS) is not None
    known = labels.withColumn("error", error).join(F.broadcast(taxonomy) if small else taxonomy, "error", "left")
    classed = F.array(
        F.col("var"),
        F.concat(F.lit("errorclass:"), "class"),
        F.concat(F.lit("errorsubclass-"), "class", F.lit(":"), "subclass"),
        F.concat(F.lit("errorsubsubclass-"), "class", F.lit("-"), "subclass", F.lit(":"), "error"),
    )
    return known.select("key", F.explode(F.array_compact(classed)).alias("var"))


def unclassified(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(error, n)``: errors that the taxonomy does not know."""
    errors = labels.filter(F.startswith("var", F.lit("error:"))).select(F.expr("substr(var, 7)").alias("error"))
    return errors.join(taxonomy, "error", "left_anti").groupBy("error").agg(F.count("*").alias("n"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``(error, class, subclass)`` of ``{class: {subclass: [error, ...]}}``."""
    nested = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,map<string,array<string>>>", {"mode": "FAILFAST"}).alias("m")
    )
    return (
        nested.select(F.explode("m").alias("class", "subs"))
        .select("class", F.explode("subs").alias("subclass", "errors"))
        .select(F.explode("errors").alias("error"), "class", "subclass")
    )
