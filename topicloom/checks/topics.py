"""Topic reports on weight tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.checks import standins as S
from topicloom.checks import table
from topicloom.checks.corpus import sql_docs
from topicloom.functions import paths, vectors
from topicloom.operators import asof
from topicloom.operators import corpus as C
from topicloom.operators import topics as P
from topicloom.plans import pipelines as PL


def top_topics(spark, sf):
    return P.top_n(S.weights(spark, sf), ["doc"], "p", "topic", 10).select("doc", "rank", "topic", F.round("p", 6).alias("p"))


def _source_terms(spark, sf):
    """p(term | source) of the documents, as a stand-in for p(term | topic)."""
    docs = table(spark, sf, "documents")
    tokens = C.tokenize(docs).join(docs.select("doc_id", F.col("source").alias("topic")), "doc_id")
    counts = tokens.select("topic", F.explode("tokens").alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    total = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return counts.join(total, "topic").select("topic", "term", (F.col("n") / F.col("total")).alias("p"))


SQL_TERMS = f"""
tk as materialized ({sql_docs()}),
counts as (select source as topic, term, count(*) as n
           from (select doc_id, unnest(tokens) as term from tk where len(tokens) >= 2) t join documents d on d.doc_id = t.doc_id
           group by source, term),
terms as (select topic, term, n / sum(n) over (partition by topic) as p from counts),
ranked as (select topic, term, p, row_number() over (partition by topic order by p desc, term) as rank from terms)"""


def top_terms(spark, sf):
    return P.top_n(_source_terms(spark, sf), ["topic"], "p", "term", 30).select(
        "topic", F.col("rank").cast("long").alias("rank"), "term", F.round("p", 9).alias("p")
    )


def topic_labels(spark, sf):
    return P.topic_labels(_source_terms(spark, sf))


def group_centroid(spark, sf):
    centers = vectors.mean_vectors(S.vectors_of(spark, sf), ["label"])
    return centers.select("label", "n", F.posexplode("center").alias("topic", "p")).withColumn("p", F.round("p", 6))


def centroid_top_topics(spark, sf):
    long = vectors.mean_vectors(S.vectors_of(spark, sf), ["label"]).select("label", F.posexplode("center").alias("topic", "p"))
    return P.top_n(long, ["label"], "p", "topic", 10, non_zero=True).select("label", "rank", "topic")


def group_distance(spark, sf):
    near = P.distance_to_centroid(S.vectors_of(spark, sf), ["label"])
    return near.select("label", "doc", F.round("d2", 7).alias("d2")).orderBy("label", "d2", "doc")


def id_group(spark, sf):
    """Weights of the documents that are marked toxic."""
    group = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("doc"))
    return P.in_group(S.weights(spark, sf), group).select("doc", "topic", F.round("p", 6).alias("p"))


def topic_by_release(spark, sf):
    released = asof.with_release(S.commits(spark, sf), S.tags(spark, sf)).select(F.col("id").alias("doc"), "release")
    w = S.weights(spark, sf)
    # only documents of the corpus count
    in_corpus = released.join(w.select("doc").distinct(), "doc", "left_semi")
    return P.topic_share(w, in_corpus, "release").withColumn("p", F.round("p", 6))


def paragraph_trend(spark, sf):
    """The trend of a corpus of paragraphs, two of each commit, in both denominators."""
    vectors_ = S.vectors_of(spark, sf)
    number = F.explode(F.array(F.lit("-0"), F.lit("-1")))
    index = vectors_.select(F.col("doc").alias("corpus_id"), number.alias("_n"), F.col("doc").alias("record_id")).select(
        "corpus_id", F.concat(F.col("corpus_id").cast("string"), "_n").alias("doc_id"), "record_id"
    )
    doc_topics = S.weights(spark, sf).withColumnRenamed("doc", "corpus_id")
    found = []
    for all_commits in (False, True):
        trend = PL.topic_trend(doc_topics, index, S.commits(spark, sf), S.changes(spark, sf), S.tags(spark, sf), all_commits)
        for name, key in (("by_release", "release"), ("by_directory", "dir")):
            found.append(trend[name].select(F.lit(all_commits).alias("all_commits"), "topic", F.col(key).alias("place"), F.round("p", 6).alias("p")))
    return reduce(DataFrame.unionByName, found)


_SQL_PARAGRAPH_TREND = f"""with {S.SQL_WEIGHTS}, {S.SQL_TAGS}, {S.SQL_FILES}, {S.SQL_DIRS},
releases as (select max(tag) as tag, ts from tags where not contains(tag, 'rc') and not contains(tag, '-') and starts_with(tag, 'v') group by ts),
rel as (select event_id as id, event_type = 'error' as is_merge, coalesce(tag, 'rc') as place from events e asof left join releases r on e.ts >= r.ts),
places as (select id, is_merge, place from rel
  union all select dirs.id, event_type = 'error' as is_merge, dir as place from dirs join events on event_id = dirs.id),
docs as (select id, place, unnest([0, 1]) as k from places where id in (select doc from vecs)),
sums as (select topic, place, sum(p) as s from docs join w on w.doc = docs.id group by topic, place),
few as (select place, count(*) as n from docs group by place),
every as (select place, count(distinct id) as n from places where not is_merge group by place)
select false as all_commits, cast(topic as int) as topic, place, round(s / n, 6) as p from sums join few using (place)
union all select true, cast(topic as int), place, round(s / n, 6) from sums join every using (place)"""


def path_ancestors(spark, sf):
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", F.explode(paths.ancestors(path)).alias("dir"))


def _dirs(spark, sf):
    files = S.changed_files(spark, sf)
    return files.select(F.col("id").alias("doc"), F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()


def directory_commits(spark, sf):
    return _dirs(spark, sf).groupBy("dir").agg(F.count("*").alias("n"))


def path_share(spark, sf):
    w = S.weights(spark, sf)
    in_corpus = _dirs(spark, sf).join(w.select("doc").distinct(), "doc", "left_semi")
    return P.topic_share(w, in_corpus, "dir").withColumn("p", F.round("p", 6))


def sorted_maps(spark, sf):
    """Order value by priority for each customer, as a map in value order."""
    sums = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("v"))
    # at most one entry per priority
    as_map = sums.groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "v"))).alias("m")
    )
    keys = F.transform(P.sorted_map(F.col("m")), lambda e: e["key"])
    return as_map.select("o_custkey", F.array_join(keys, ">").alias("priorities"))


QUERIES = {
    "top_topics": (
        top_topics,
        f"with {S.SQL_WEIGHTS} select doc, cast(rank as int) as rank, cast(topic as int) as topic, round(p, 6) as p from "
        "(select *, row_number() over (partition by doc order by p desc, topic) as rank from w) where rank <= 10",
    ),
    "top_terms": (top_terms, f"with {SQL_TERMS} select topic, rank, term, round(p, 9) as p from ranked where rank <= 30"),
    "topic_labels": (
        topic_labels,
        f"with {SQL_TERMS} select topic, concat('T', topic, '-', string_agg(term, '-' order by rank)) as label "
        "from ranked where rank <= 2 group by topic",
    ),
    "group_centroid": (
        group_centroid,
        f"with {S.SQL_WEIGHTS} select label, count(*) as n, cast(topic as int) as topic, round(avg(p), 6) as p from w group by label, topic",
    ),
    "centroid_top_topics": (
        centroid_top_topics,
        f"""with {S.SQL_WEIGHTS}, c as (select label, topic, avg(p) as p from w group by label, topic)
select label, cast(rank as int) as rank, cast(topic as int) as topic from (
  select *, row_number() over (partition by label order by p desc, topic) as rank from c where p <> 0) where rank <= 10""",
    ),
    "group_distance": (
        group_distance,
        f"""with {S.SQL_WEIGHTS}, c as (select label, topic, avg(p) as p from w group by label, topic)
select w.label, doc, round(sum((w.p - c.p) * (w.p - c.p)), 7) as d2 from w join c on w.label = c.label and w.topic = c.topic
group by w.label, doc""",
    ),
    "id_group": (
        id_group,
        f"with {S.SQL_WEIGHTS} select doc, cast(topic as int) as topic, round(p, 6) as p from w where doc in (select doc_id from labels where toxic = 1)",
    ),
    "topic_by_release": (
        topic_by_release,
        f"""with {S.SQL_WEIGHTS}, {S.SQL_TAGS},
releases as (select max(tag) as tag, ts from tags where not contains(tag, 'rc') and not contains(tag, '-') and starts_with(tag, 'v') group by ts),
rel as (select event_id as doc, coalesce(tag, 'rc') as release from events e asof left join releases r on e.ts >= r.ts
        where event_id in (select doc from vecs)),
n as (select release, count(*) as n from rel group by release)
select cast(topic as int) as topic, release, round(sum(p) / max(n), 6) as p
from w join rel using (doc) join n using (release) group by topic, release""",
    ),
    "paragraph_trend": (paragraph_trend, _SQL_PARAGRAPH_TREND),
    "path_ancestors": (
        path_ancestors,
        """with parts as (select page_id, string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/') as s from pages)
select page_id, array_to_string(s[1:i], '/') as dir from (select page_id, s, unnest(range(1, len(s))) as i from parts)""",
    ),
    "directory_commits": (
        directory_commits,
        f"with {S.SQL_FILES}, {S.SQL_DIRS} select dir, count(*) as n from dirs group by dir",
    ),
    "path_share": (
        path_share,
        f"""with {S.SQL_WEIGHTS}, {S.SQL_FILES}, {S.SQL_DIRS},
m as (select id as doc, dir from dirs where id in (select doc from vecs)),
n as (select dir, count(*) as n from m group by dir)
select cast(topic as int) as topic, dir, round(sum(p) / max(n), 6) as p from w join m using (doc) join n using (dir) group by topic, dir""",
    ),
    "sorted_maps": (
        sorted_maps,
        """select o_custkey, string_agg(o_orderpriority, '>' order by v desc, o_orderpriority) as priorities
from (select o_custkey, o_orderpriority, max(o_totalprice) as v from orders group by o_custkey, o_orderpriority) group by o_custkey""",
    ),
}
