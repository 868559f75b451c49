"""What the given tables stand in for, in Spark and in SQL: commits, tags, changes, weights, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.checks import table
from topicloom.functions import paths, vectors
from topicloom.operators import topics
from topicloom.operators.crosstab import Records


def commits(spark, sf):
    """Every event is a commit; an ``error`` event is a merge."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "error", 2).otherwise(1).alias("n_parents")
    )


def tags(spark, sf):
    """The first event of each hour is tagged: a release, a point release, a candidate or another tag."""
    day, hour = F.dayofmonth("ts"), F.hour("ts")
    name = (
        F.when(hour == 0, F.concat(F.lit("v4."), day))
        .when(hour % 6 == 0, F.concat(F.lit("v4."), day, F.lit("-rc"), hour))
        .when(hour % 2 == 1, F.concat(F.lit("v4."), day, F.lit("."), hour))
        .otherwise(F.concat(F.lit("next-"), day, F.lit("-"), hour))
    )
    return table(spark, sf, "events").groupBy(name.alias("tag")).agg(F.min("ts").alias("ts"))


SQL_TAGS = """tags as (
  select tag, min(ts) as ts from (
    select ts, case when hour(ts) = 0 then concat('v4.', day(ts))
                    when hour(ts) % 6 = 0 then concat('v4.', day(ts), '-rc', hour(ts))
                    when hour(ts) % 2 = 1 then concat('v4.', day(ts), '.', hour(ts))
                    else concat('next-', day(ts), '-', hour(ts)) end as tag from events)
  group by tag)"""


def changes(spark, sf):
    """Every order line is a changed file of commit ``l_orderkey``."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    new = F.concat(F.lower("p_type"), F.lit("/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".c"))
    status = F.when(F.col("l_returnflag") == "A", "ADD").when(F.col("l_returnflag") == "R", "RENAME").otherwise("MODIFY")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("id"),
        status.alias("status"),
        F.concat(F.lit("old/"), new).alias("old_path"),
        new.alias("new_path"),
    )


def changed_files(spark, sf):
    c = changes(spark, sf)
    return c.select("id", paths.changed_path(c["status"], c["old_path"], c["new_path"]).alias("path")).distinct()


SQL_FILES = """files as (
  select distinct l_orderkey as id, case when l_returnflag in ('A', 'R') then '' else 'old/' end
    || lower(p_type) || '/' || p_brand || '/' || replace(p_name, ' ', '/') || '.c' as path
  from lineitem join part on l_partkey = p_partkey)"""

SQL_DIRS = """dirs as (
  select distinct id, array_to_string(parts[1:i], '/') as dir
  from (select id, parts, unnest(range(1, len(parts))) as i from (select id, string_split(path, '/') as parts from files)))"""


def vectors_of(spark, sf):
    """``(doc, label, v)``: absolute values divided by their sum, as p(topic | doc)."""
    v = F.transform(vectors.doubles(F.col("embedding")), F.abs)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), "label", vectors.l1_normalized(v).alias("v"))


def weights(spark, sf):
    return topics.weights(vectors_of(spark, sf).select("doc", "v"))


SQL_WEIGHTS = """absolute as (
  select vec_id as doc, label, list_transform(embedding, lambda x: abs(cast(x as double))) as a from embeddings),
vecs as (select doc, label, list_transform(a, lambda x: x / list_sum(a)) as v from absolute),
w as (select doc, label, unnest(v) as p, unnest(range(len(v))) as topic from vecs)"""


def doc_tags(spark, sf):
    """``(row, col, value)``: language and source of a document as manual tags."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    tag = F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")))
    return docs.select(F.col("doc_id").alias("row"), tag.alias("col"), F.lit(1.0).alias("value"))


def doc_topics(spark, sf):
    return weights(spark, sf).select(F.col("doc").alias("row"), F.col("topic").alias("col"), F.col("p").alias("value"))


SQL_TAG_MATRIX = (
    SQL_WEIGHTS
    + """,
tagged as (select doc_id as doc, concat('lang:', lang) as tag from documents
           union all select doc_id, concat('source:', source) from documents),
shared as (select doc, tag, 0.5 as t from tagged where doc in (select doc from vecs)),
shared_w as (select * from w where doc in (select doc from shared)),
nd as (select count(distinct doc) as n from shared),
both_p as (select tag, topic, sum(t * p) / (select n from nd) as value from shared join shared_w using (doc) group by tag, topic)"""
)


def records(spark, sf) -> Records:
    """Orders as records: status is the objective; flags, line states, priority and brands are labels."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    flags = line.select(
        F.col("l_orderkey").alias("key"),
        F.explode(F.array(F.concat(F.lit("flag:"), "l_returnflag"), F.concat(F.lit("line:"), "l_linestatus"))).alias("var"),
    )
    brands = line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("key"), F.concat(F.lit("brand:"), "p_brand").alias("var")
    )
    priority = orders.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("prio:"), "o_orderpriority").alias("var"))
    keys = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("objective"))
    return Records(keys, flags.unionByName(brands).unionByName(priority).distinct())


SQL_RECORDS = """labels_ as (
  select l_orderkey as key, concat('flag:', l_returnflag) as var from lineitem
  union select l_orderkey, concat('line:', l_linestatus) from lineitem
  union select l_orderkey, concat('brand:', p_brand) from lineitem join part on l_partkey = p_partkey
  union select o_orderkey, concat('prio:', o_orderpriority) from orders),
keys_ as (select o_orderkey as key, o_orderstatus as objective from orders)"""
