"""Matrices, cross tables, keywords and bug labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.checks import standins as S
from topicloom.checks import table
from topicloom.functions import keywords as K
from topicloom.operators import crosstab as X
from topicloom.operators import matrix as M
from topicloom.scale import shared_folder
from topicloom.sources import bug_records as B

# the default rules and a few that the invented prose of the tables can match
RULES = K.DEFAULT_RULES + [
    ("prose.the", r"\bthe\b"),
    ("prose.une", r"\b(un|une) "),
    ("prose.doubled", r"(tion|ing)(tion|ing)"),
    ("prose.sentence", r"\. [a-z]+\."),
]


def _rounded(m, digits=9):
    return m.select("row", "col", F.round("value", digits).alias("value"))


def tag_topic_joint(spark, sf):
    return _rounded(M.joint(S.doc_tags(spark, sf), S.doc_topics(spark, sf)))


def tag_topic_harmony(spark, sf):
    h = M.harmony(S.doc_tags(spark, sf), S.doc_topics(spark, sf))
    return M.sort_columns(h).select("row", "col", F.round("value", 9).alias("value"), "rank")


def row_entropy(spark, sf):
    e = M.entropy(M.normalize_rows(M.joint(S.doc_tags(spark, sf), S.doc_topics(spark, sf))))
    return e.select("row", F.round("entropy", 6).alias("entropy")).orderBy("entropy", "row")


def rows_by_entropy(spark, sf):
    """Rows of the joint matrix by entropy, with their cells counted and their largest one."""
    m = M.joint(S.doc_tags(spark, sf), S.doc_topics(spark, sf))
    ordered = M.sort_rows_by_entropy(M.normalize_rows(m)).groupBy("row", F.round("entropy", 6).alias("entropy"))
    return ordered.agg(F.count("*").alias("n"), F.round(F.max("value"), 7).alias("most"))


def matrix_cells(spark, sf):
    """(A o A') / (A + A') of the joint matrix and its halved, twice transposed copy."""
    a = M.joint(S.doc_tags(spark, sf), S.doc_topics(spark, sf))
    half = M.transpose(M.transpose(M.scale(a, 0.5)))
    return _rounded(M.divide_cells(M.times_cells(a, half), M.plus(a, half)))


def lost_rows(spark, sf):
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("row"))
    return M.lost_rows(labelled, S.doc_topics(spark, sf))


def kept_rows(spark, sf):
    marked = table(spark, sf, "labels").select(F.col("doc_id").alias("row"))
    return M.row_sums(M.drop_rows(S.doc_topics(spark, sf), marked)).select("row", F.round("value", 6).alias("value"))


def cross_counts(spark, sf):
    return X.contingency(X.with_prefix(S.records(spark, sf), "brand:"))


def _with_header(wide, keys):
    """The lines and, under null keys, the column names."""
    names = wide.columns.agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("c")).select(
        *[F.lit(None).cast("string").alias(k) for k in keys], F.array_join(F.col("c.name"), ",").alias("line")
    )
    return wide.lines.select(*[F.col(k).cast("string").alias(k) for k in keys], "line").unionByName(names)


def cross_wide(spark, sf):
    """Contingency lines of all labels, by total."""
    return _with_header(X.contingency_wide(S.records(spark, sf)), ["objective"])


def cross_binary(spark, sf):
    """0/1 lines of all labels, in name order."""
    return _with_header(X.binary_wide(S.records(spark, sf)), ["key", "objective"])


def cross_unpivot(spark, sf):
    """All labels there and back."""
    return X.binary_long(X.from_wide(X.binary_wide(S.records(spark, sf)))).select("key", "objective", "var", "value")


def cross_rekey(spark, sf):
    return X.contingency(X.rekey(S.records(spark, sf), "flag:", "prio:"))


def cross_totals(spark, sf):
    return X.counts_with_total(S.records(spark, sf))


def cross_components(spark, sf):
    """Brands of the orders that hold a returned line, ``#`` kept, as a contingency table."""
    return X.contingency(X.components(S.records(spark, sf), "flag:R", "brand:"))


def cross_matching(spark, sf):
    return X.label_counts(X.matching(S.records(spark, sf), "brand:Brand#1[0-9]|prio:[12].*"))


def cross_objectives(spark, sf):
    returned = X.holding(S.records(spark, sf), "flag:R")
    return X.objective_counts(returned)


def taxonomy_listing(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    tax = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("r_name").alias("class"),
        F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("subclass"),
        F.col("n_name").alias("error"),
    )
    return X.taxonomy_listing(tax)


def keyword_hits(spark, sf):
    return K.match_rules(table(spark, sf, "documents").select("doc_id", "text"), RULES)


def keyword_groups(spark, sf):
    hits = K.match_groups(table(spark, sf, "benchmark").select("item_id", "text"), RULES)
    return hits.select("item_id", "rule", F.array_join("matches", "|").alias("matches"))


def keyword_counts(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    groups = docs.select("source").distinct()
    return K.rule_counts(K.match_rules(docs, RULES), "source", "doc_id", groups, RULES)


# --- bug labels: a JSON record is made of every event -------------------------------------------------


def _bug_json():
    """Text of one record by event type: an object, an array of two, a class name, an empty object, a build failure."""
    u, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    site = F.concat(F.lit('"when": "run:'), k, F.lit('"'))
    deep = F.concat(F.lit('"fix": ["drivers/net/u'), u, F.lit('/a.c:3", "arch/b.c"]'))
    flat = F.concat(F.lit('"fix": "fs/u'), u, F.lit('/x.c"'))
    errors = F.concat(F.lit('"errors": ["crash:oops", "err'), F.pmod(k.cast("int"), F.lit(7)).cast("string"), F.lit('"]'))
    first = F.concat(F.lit("{"), site, F.lit(", "), deep, F.lit(', "if": "", '), errors, F.lit("}"))
    second = F.concat(F.lit("{"), site, F.lit(", "), flat, F.lit(', "if": ["load:1", "race"], "errors": "crash"}'))
    return (
        F.when(F.col("event_type") == "view", first)
        .when(F.col("event_type") == "purchase", F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]")))
        .when(F.col("event_type") == "error", F.concat(F.lit('"clean:'), k, F.lit('"')))
        .when(F.col("event_type") == "signup", F.lit('{"when": "build:ld"}'))
        .otherwise(F.lit("{}"))
    )


def _taxonomy(spark, sf):
    """Errors err0..err4 of the event keys, classed by parity; err5 and err6 stay unclassified."""
    k = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(7))
    return (
        table(spark, sf, "events").select(k.alias("e")).distinct().filter("e < 5").select(
            F.concat(F.lit("err"), F.col("e").cast("string")).alias("error"),
            F.when(F.col("e") % 2 == 0, "soft state").otherwise("hard state").alias("class"),
            F.concat(F.lit("s"), F.col("e").cast("string")).alias("subclass"),
        )
    )


def _bug_records(spark, sf):
    bugs = table(spark, sf, "events").select(
        F.concat(F.lit("day"), F.dayofmonth("ts").cast("string")).alias("objective"),
        F.col("event_id").cast("string").alias("id"),
        F.parse_json(_bug_json()).alias("type"),
    )
    return B.to_records(B.fixes(bugs), _taxonomy(spark, sf))


def variant_labels(spark, sf):
    return _bug_records(spark, sf).labels


def bug_folder(spark, sf):
    """The same labels from files: a folder with a JSON file of records for every day, and a taxonomy file."""
    import uuid

    path = f"{shared_folder(spark)}/check-{uuid.uuid4().hex}"
    entry = F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('": {"type": '), _bug_json(), F.lit("}"))
    days = table(spark, sf, "events").select(F.concat(F.lit("day"), F.dayofmonth("ts").cast("string")).alias("day"), entry.alias("entry"))
    # a file is one JSON object
    files = days.groupBy("day").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ",\n"), F.lit("}")).alias("value"))
    files.write.partitionBy("day").text(f"{path}/days")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(f"{path}/bugs"))
    for found in fs.globStatus(fs_path(f"{path}/days/day=*/part-*")):  # one a day, named by its objective
        day = found.getPath().getParent().getName().removeprefix("day=")
        fs.rename(found.getPath(), fs_path(f"{path}/bugs/{day}.json"))
    classes = _taxonomy(spark, sf).groupBy("class", "subclass").agg(F.collect_list("error").alias("errors"))
    nested = classes.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("subclass", "errors"))).alias("m"))
    nested.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("class", "m")))).alias("value")).write.text(f"{path}/taxonomy")
    return B.to_records(B.fixes(B.read_bug_files(spark, f"{path}/bugs")), B.read_taxonomy(spark, f"{path}/taxonomy")).labels


def bug_error_classes(spark, sf):
    bugs = X.holding(_bug_records(spark, sf), "fixclass:bug")
    return X.contingency(X.rekey(bugs, "errorclass:", "trigger:"))


def bug_unclassified(spark, sf):
    return B.unclassified(_bug_records(spark, sf).labels, _taxonomy(spark, sf))


SQL_BUGS = """
ev as (select cast(event_id as varchar) as id, concat('day', day(ts)) as objective, event_type, concat('u', user_id) as u,
              cast(props->>'$.k' as int) as k from events),
f as (select id as key, objective, u, k, 1 as form from ev where event_type = 'view'
      union all select concat(id, '-F0'), objective, u, k, 1 from ev where event_type = 'purchase'
      union all select concat(id, '-F1'), objective, u, k, 2 from ev where event_type = 'purchase'),
raw_labels as (
  select key, unnest(['fixclass:bug', 'failuresite:run', 'fixedloc:drivers', 'fixedsubloc-drivers:net',
    concat('fixedsubsubloc-drivers-net:', u), 'fixedloc:arch', 'fixedsubloc-arch:.', 'trigger:None', 'error:crash', 'crash:oops',
    concat('error:err', k % 7)]) as var from f where form = 1
  union all select key, unnest(['fixclass:bug', 'failuresite:run', 'fixedloc:fs', concat('fixedsubloc-fs:', u),
    concat('fixedsubsubloc-fs-', u, ':.'), 'trigger:load', 'trigger:race', 'error:crash', 'crash:None']) from f where form = 2
  union all select key, unnest([concat('errorclass:', c), concat('errorsubclass-', c, ':s', e), concat('errorsubsubclass-', c, '-s', e, ':err', e)])
    from (select key, k % 7 as e, case when (k % 7) % 2 = 0 then 'soft state' else 'hard state' end as c from f where form = 1 and k % 7 < 5)
  union all select id, 'fixclass:clean' from ev where event_type = 'error'
  union all select id, 'fixclass:build' from ev where event_type = 'signup'),
blabels as (select distinct key, var from raw_labels)"""


def _sql_rules(source: str, id_col: str) -> str:
    return " union all ".join(
        f"select {id_col}, '{name}' as rule from {source} where regexp_matches(lower(text), '{regex}')"
        for name, regex in RULES
    )


def _sql_groups(source: str, id_col: str) -> str:
    return " union all ".join(
        f"select {id_col}, '{name}' as rule, array_to_string(regexp_extract_all(lower(text), '{regex}', 0), '|') as matches "
        f"from {source} where regexp_matches(lower(text), '{regex}')"
        for name, regex in RULES
    )


def _sql_named(prefix: str) -> str:
    return f"select key, substr(var, {len(prefix) + 1}) as var from labels_ where starts_with(var, '{prefix}')"


QUERIES = {
    "tag_topic_joint": (
        tag_topic_joint,
        f"with {S.SQL_TAG_MATRIX} select tag as row, cast(topic as int) as col, round(value, 9) as value from both_p",
    ),
    "tag_topic_harmony": (
        tag_topic_harmony,
        f"""with {S.SQL_TAG_MATRIX},
pt as (select tag, sum(t) / (select n from nd) as pt from shared group by tag),
pp as (select topic, sum(p) / (select n from nd) as pp from shared_w group by topic),
h as (select tag, topic, 2 * value / (pt + pp) as value from both_p join pt using (tag) join pp using (topic))
select tag as row, cast(topic as int) as col, round(value, 9) as value,
       row_number() over (partition by tag order by value desc, topic) as rank from h""",
    ),
    "row_entropy": (
        row_entropy,
        f"""with {S.SQL_TAG_MATRIX}, q as (select tag, value / sum(value) over (partition by tag) as v from both_p)
select tag as row, round(-sum(v * log2(v)), 6) as entropy from q group by tag""",
    ),
    "rows_by_entropy": (
        rows_by_entropy,
        f"""with {S.SQL_TAG_MATRIX}, q as (select tag, value / sum(value) over (partition by tag) as v from both_p)
select tag as row, round(-sum(v * log2(v)), 6) as entropy, count(*) as n, round(max(v), 7) as most from q group by tag""",
    ),
    "matrix_cells": (
        matrix_cells,
        f"""with {S.SQL_TAG_MATRIX}
select tag as row, cast(topic as int) as col, round((value * (value * 0.5)) / (value + value * 0.5), 9) as value from both_p""",
    ),
    "lost_rows": (lost_rows, "select distinct doc_id as row from labels where doc_id not in (select vec_id from embeddings)"),
    "kept_rows": (
        kept_rows,
        f"with {S.SQL_WEIGHTS} select doc as row, round(sum(p), 6) as value from w where doc not in (select doc_id from labels) group by doc",
    ),
    "cross_counts": (
        cross_counts,
        f"""with {S.SQL_RECORDS}, l as ({_sql_named('brand:')})
select objective, var, count(*) as n from keys_ join l using (key) group by objective, var""",
    ),
    "cross_wide": (
        cross_wide,
        f"""with {S.SQL_RECORDS}, c as (select var, count(*) as n from labels_ group by var),
n as (select objective, var, count(*) as k from keys_ join labels_ using (key) group by objective, var)
select objective, string_agg(coalesce(k, 0)::varchar, ',' order by c.n desc, c.var) as line
from (select distinct objective from keys_) cross join c left join n using (objective, var) group by objective
union all select null, string_agg(var, ',' order by n desc, var) from c""",
    ),
    "cross_binary": (
        cross_binary,
        f"""with {S.SQL_RECORDS}, c as (select distinct var from labels_)
select key::varchar as key, objective, string_agg((l.var is not null)::int::varchar, ',' order by c.var) as line
from keys_ cross join c left join labels_ l using (key, var) group by key, objective
union all select null, null, string_agg(var, ',' order by var) from c""",
    ),
    "cross_unpivot": (
        cross_unpivot,
        f"with {S.SQL_RECORDS} select key, objective, var, cast(1 as int) as value from keys_ join labels_ using (key)",
    ),
    "cross_rekey": (
        cross_rekey,
        f"""with {S.SQL_RECORDS}, l as ({_sql_named('flag:')}), o as ({_sql_named('prio:')})
select o.var as objective, l.var as var, count(*) as n from o join l using (key) group by o.var, l.var""",
    ),
    "cross_totals": (
        cross_totals,
        f"""with {S.SQL_RECORDS} select var, count(*) as n from labels_ group by var
union all select 'total', count(*) from labels_""",
    ),
    "cross_components": (
        cross_components,
        f"""with {S.SQL_RECORDS}, l as ({_sql_named('brand:')})
select objective, replace(var, ':', '/') as var, count(*) as n from keys_ join l using (key)
where key in (select key from labels_ where var = 'flag:R') group by all""",
    ),
    "cross_matching": (
        cross_matching,
        f"""with {S.SQL_RECORDS} select var, count(*) as n from labels_
where regexp_full_match(var, 'brand:Brand#1[0-9]|prio:[12].*') group by var""",
    ),
    "cross_objectives": (
        cross_objectives,
        f"""with {S.SQL_RECORDS} select objective, count(*) as n from keys_
where key in (select key from labels_ where var = 'flag:R') group by objective""",
    ),
    "taxonomy_listing": (
        taxonomy_listing,
        """select r_name as class, case when n_nationkey % 2 = 0 then 'even' else 'odd' end as subclass,
string_agg(n_name, ', ' order by n_name) as errors from nation join region on n_regionkey = r_regionkey group by 1, 2""",
    ),
    "keyword_hits": (keyword_hits, _sql_rules("documents", "doc_id")),
    "keyword_groups": (keyword_groups, _sql_groups("benchmark", "item_id")),
    "keyword_counts": (
        keyword_counts,
        f"""with hits as ({_sql_rules('documents', 'source, doc_id')}),
rules as (select unnest([{', '.join("'" + n + "'" for n, _ in RULES)}]) as rule),
sources as (select distinct source from documents)
select s.source, r.rule, count(distinct h.doc_id) as n from sources s cross join rules r
left join hits h on h.source = s.source and h.rule = r.rule group by s.source, r.rule""",
    ),
    "variant_labels": (variant_labels, f"with {SQL_BUGS} select key, var from blabels"),
    "bug_folder": (bug_folder, f"with {SQL_BUGS} select key, var from blabels"),
    "bug_error_classes": (
        bug_error_classes,
        f"""with {SQL_BUGS}
select substr(o.var, 9) as objective, substr(l.var, 12) as var, count(*) as n from blabels o join blabels l using (key)
where starts_with(o.var, 'trigger:') and starts_with(l.var, 'errorclass:')
  and key in (select key from blabels where var = 'fixclass:bug') group by 1, 2""",
    ),
    "bug_unclassified": (
        bug_unclassified,
        f"""with {SQL_BUGS} select substr(var, 7) as error, count(*) as n from blabels
where starts_with(var, 'error:') and var not in ('error:err0', 'error:err1', 'error:err2', 'error:err3', 'error:err4') group by 1""",
    ),
}
