"""Cluster reports, topic models, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from topicloom.checks import standins as S
from topicloom.checks import table
from topicloom.checks.corpus import sql_corpus
from topicloom.checks.tables import RULES
from topicloom.checks.tree import CUTS, _sql, order_tree
from topicloom.functions import jsonio
from topicloom.operators import clusters as R
from topicloom.operators import corpus as C
from topicloom.operators import lda as D
from topicloom.operators import tree as G
from topicloom.scale import checkpoint, shared_folder
from topicloom.sources import tables as ST
from topicloom.sources import text_files as TF

# --- reports on cut clusters: orders are points, their lines are the original ids ---------------------------


def _members(spark, sf):
    return checkpoint(G.under_cuts(order_tree(spark, sf), CUTS).withColumnRenamed("node", "point"))


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("point"),
        (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("doc_id"),
        F.col("l_returnflag").alias("version"),
        F.col("l_suppkey").alias("path"),
        "l_linenumber",
        "l_quantity",
        F.date_format("l_shipdate", "yyyy/MM").alias("date"),
    )


def _id_index(spark, sf):
    return _lines(spark, sf).select("point", "doc_id")


def _weights(spark, sf):
    """Share of each line number in an order's quantity."""
    line = _lines(spark, sf)
    sums = line.groupBy("point", F.col("l_linenumber").alias("topic")).agg(F.sum("l_quantity").alias("q"))
    total = line.groupBy("point").agg(F.sum("l_quantity").alias("t"))
    return sums.join(total, "point").select("point", "topic", (F.col("q") / F.col("t")).alias("p"))


def cluster_topics(spark, sf):
    t = R.mean_topics(_members(spark, sf), _weights(spark, sf))
    return t.withColumn("p", F.round("p", 9))


def _own(lines, column):
    """``(doc_id, column)`` of the originals with an id that holds the point, since two points can have one ``doc_id``."""
    return lines.select(F.struct("point", "doc_id").alias("doc_id"), column).distinct()


def _frequencies(spark, sf, value):
    lines = _lines(spark, sf)
    return R.frequencies(_members(spark, sf), _own(lines, "point"), _own(lines, value), value)


def cluster_versions(spark, sf):
    return _frequencies(spark, sf, "version")


def cluster_files(spark, sf):
    return _frequencies(spark, sf, "path")


def cluster_dates(spark, sf):
    return _frequencies(spark, sf, "date")


REPORT_CUTS = [CUTS[1], CUTS[6]]


def cluster_documents(spark, sf):
    """The JSON documents of all cut clusters, written and read back entry by entry."""
    nodes, lines, weights = order_tree(spark, sf), _lines(spark, sf), checkpoint(_weights(spark, sf))
    members = checkpoint(G.under_cuts(nodes, REPORT_CUTS).withColumnRenamed("node", "point"))
    index = checkpoint(lines.select("point", "doc_id").distinct())
    texts = table(spark, sf, "documents").select("doc_id", "text")
    point_rules = checkpoint(R.keyword_points(texts.select(F.col("doc_id").alias("point"), "doc_id"), texts, RULES))
    facts = [_own(lines, c) for c in ("version", "date", "path")]
    told = checkpoint(R.report(members, weights, _own(index, "point"), *facts, point_rules))
    sizes, near = G.cut_sweep(nodes, REPORT_CUTS), checkpoint(R.point_distances(members, weights))
    path = _folder(spark)
    ST.write_cluster_documents(R.documents(sizes, told, near, R.originals(members, index), point_rules), sizes, path)
    e = ST.read_cluster_documents(spark, path).select("cut", "cluster_id", "entry.*")
    name = F.coalesce("topic", "date", "version", "file", "keyword", F.concat(F.lit("+"), "commit"), F.array_join("keywords", "|"))
    value = F.round(F.coalesce("value", "distance") + 1e-11, 8)  # a digit that is exactly a half goes up in every engine
    return e.select("cut", "cluster_id", "point", name.alias("name"), value.alias("value"))


def cluster_sizes_file(spark, sf):
    """Sizes and densities of the cut clusters as files."""
    nodes, path = order_tree(spark, sf), _folder(spark)
    sizes = G.cut_sweep(nodes, CUTS)
    ST.write_folders(sizes.withColumn("_small", -F.col("size")), ["cut"], ["_small", "cluster_id"], path, keep=["cluster_id", "size", "density"])
    return spark.read.schema("cluster_id long, size long, density double, cut double").csv(path, header=True)


def cut_files(spark, sf):
    """The subtree of every cut cluster, written and read back."""
    nodes, path = order_tree(spark, sf), _folder(spark)
    made = G.under_cuts(nodes, [REPORT_CUTS[0]], only_points=False)
    ST.write_cut(G.by_size(G.cut(nodes, REPORT_CUTS[0])), made, nodes, path)
    return ST.read_cut(spark, path).select("cut", "cluster_id", "node", "size", F.round("density", 6).alias("density"), "parent_id")


def trend_files(spark, sf):
    """Topic shares by release, a labelled folder for each topic, written and read back."""
    from topicloom.plans import pipelines as PL

    vectors_ = S.vectors_of(spark, sf)
    index = vectors_.select(F.col("doc").alias("corpus_id"), F.col("doc").alias("doc_id"))
    doc_topics = S.weights(spark, sf).withColumnRenamed("doc", "corpus_id")
    tags, path = S.tags(spark, sf), _folder(spark)
    trend = PL.topic_trend(doc_topics, index, S.commits(spark, sf), S.changes(spark, sf), tags)
    terms = spark.range(64).select(F.col("id").cast("int").alias("topic"), F.concat(F.lit("t"), "id").alias("term"), F.lit(1.0).alias("p"))
    PL.save_trend(trend, terms, tags, path)
    return ST.read_trend(spark, f"{path}/version", "release").select("topic", "label", "release", F.round("p", 6).alias("p"))


def document_report(spark, sf):
    """The report of the dearest order of every customer nation."""
    from topicloom.plans import pipelines as PL

    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    paid = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    dearest = paid.groupBy("c_nationkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("doc_id"))
    index = orders.select(F.col("o_orderkey").alias("corpus_id"), F.col("o_orderkey").alias("doc_id"))
    text = F.concat("o_orderpriority", F.lit("\nby "), "o_custkey")
    commits = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("version"), text.alias("text"))
    files = _lines(spark, sf).select(F.col("point").alias("doc_id"), F.col("path").cast("string").alias("path"))
    topics = _weights(spark, sf).withColumnRenamed("point", "corpus_id")
    rows = PL.document_report(order_tree(spark, sf), topics, index, commits, files, dearest.select("doc_id"))
    path = _folder(spark)
    ST.write_point_reports(rows, path)
    back = ST.read_point_reports(spark, path, "point long, kind string, place int, name string, value double, bucket long")
    return back.select("point", "kind", "place", "name", F.round("value", 6).alias("value"))


def cluster_point_distance(spark, sf):
    d = R.ordered_points(R.point_distances(_members(spark, sf), checkpoint(_weights(spark, sf))))
    return d.withColumn("d2", F.round("d2", 7))


def cluster_keywords(spark, sf):
    """Order n carries the text of document n, where there is one."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = docs.select(F.col("doc_id").alias("point"), "doc_id")
    return R.keyword_frequencies(_members(spark, sf), R.keyword_points(index, docs, RULES))


def cluster_originals(spark, sf):
    index = _id_index(spark, sf).distinct()
    return R.originals(_members(spark, sf), index).groupBy(*R.KEY).agg(F.count("*").alias("n"), F.sum(F.col("doc_id").cast("decimal(20,0)")).cast("string").alias("ids"))


_SQL_LINES = """, mem as materialized (select cast(cut as double) as cut, cluster_id, c.point from cutn join chain c using (cluster_id)),
li as (select distinct l_orderkey as point, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber as doc_id, l_returnflag as version, l_suppkey as path from lineitem),
wt as (select l_orderkey as point, l_linenumber as topic, sum(l_quantity) / sum(sum(l_quantity)) over (partition by l_orderkey) as p
       from lineitem group by l_orderkey, l_linenumber),
sz as (select cut, cluster_id, count(*) as n from mem group by cut, cluster_id),
mt as (select m.cut, m.cluster_id, topic, sum(p) / max(sz.n) as p from mem m join wt using (point)
       join sz on sz.cut = m.cut and sz.cluster_id = m.cluster_id group by m.cut, m.cluster_id, topic)
"""

# --- topic models -------------------------------------------------------------------------------------------


def _corpus(spark, sf):
    docs = checkpoint(C.tokenize(table(spark, sf, "documents")))
    ids = C.corpus_ids(docs)
    corpus = C.corpus_docs(docs, ids)
    stops = C.mark_stop_words(C.doc_freq(corpus), ids).filter("is_stop")
    return checkpoint(C.strip_stop_words(corpus, stops))


def term_ids(spark, sf):
    return D.dictionary(_corpus(spark, sf))


def term_counts(spark, sf):
    corpus = _corpus(spark, sf)
    return D.term_counts(corpus, D.dictionary(corpus))


def row_ids(spark, sf):
    return D.row_ids(_corpus(spark, sf))


# SQL unrolls the iterations, so the checked training is short; the steps are the same for any number.
LDA_TOPICS, LDA_STEPS, LDA_SEED = 6, 3, 42


def _trained(spark, sf):
    return D.train(_corpus(spark, sf), LDA_TOPICS, LDA_STEPS, LDA_SEED, measure_every=1)


def lda_topics(spark, sf):
    return _trained(spark, sf)["topic_terms"].select("topic", "term", F.round("p", 8).alias("p"))


def lda_documents(spark, sf):
    return _trained(spark, sf)["doc_topics"].select("corpus_id", "topic", F.round("p", 8).alias("p"))


def lda_perplexity(spark, sf):
    measured = _trained(spark, sf)["perplexity"]
    return measured.select("iteration", "words", F.round("log_perplexity", 7).alias("log_perplexity"))


_SQL_TERMS = (
    sql_corpus()
    + """, sl as (select list(term) as s from stops),
kept as (select corpus_id, list_filter(tokens, lambda t: not coalesce(list_contains(s, t), false)) as tokens from uniq, sl),
full_ as (select * from kept where len(tokens) > 0),
uses as (select corpus_id, unnest(tokens) as term from full_),
terms as (select term, row_number() over (order by term) - 1 as term_id from (select term from uses group by term having count(*) >= 2))
"""
)



def _sql_training() -> str:
    """Tables dv<i>(corpus_id, topic, v), tv<i>(term_id, topic, v) and total<i>(topic, v) after every iteration."""
    alpha, eta, k = D.DOC_SMOOTHING / LDA_TOPICS, D.TERM_SMOOTHING, LDA_TOPICS
    sql = _SQL_TERMS + f""", counts as materialized (select corpus_id, term_id, count(*)::double as n from uses join terms using (term) group by corpus_id, term_id),
topics as (select unnest(range({k})) as topic), size as (select count(*) as n_terms from terms),
dv0 as (select corpus_id, topic, 1.0::double / {k} as v from (select distinct corpus_id from full_), topics),
tv0 as materialized (select term_id, topic, (('0x' || substr(md5(concat_ws(':', term, topic, {LDA_SEED})), 1, 7))::bigint + 1) / {float(1 << 28)} as v
  from terms, topics),
total0 as (select topic, sum(v) as v from tv0 group by topic)"""

    def shares(docs: int, words: int) -> str:
        return f"""(select corpus_id, term_id, topic, n * s / sum(s) over (partition by corpus_id, term_id) as s from (
  select c.corpus_id, c.term_id, d.topic, c.n, (d.v + {alpha}) * (t.v + {eta}) / (o.v + {eta} * n_terms) as s
  from counts c join dv{docs} d using (corpus_id) join tv{words} t on t.term_id = c.term_id and t.topic = d.topic
  join total{words} o on o.topic = d.topic, size))"""

    for i in range(1, LDA_STEPS + 1):
        sql += f""",
ds{i} as (select corpus_id, topic, sum(s) as s from {shares(i - 1, i - 1)} group by corpus_id, topic),
du{i} as (select corpus_id, topic, s / sum(s) over (partition by corpus_id) as v from ds{i}),
dv{i} as materialized (select a.corpus_id, a.topic, coalesce(b.v, a.v) as v from dv0 a left join du{i} b using (corpus_id, topic)),
tv{i} as materialized (select term_id, topic, sum(s) as v from {shares(i, i - 1)} group by term_id, topic),
total{i} as (select topic, sum(v) as v from tv{i} group by topic)"""
    return sql


def _sql_perplexity() -> str:
    eta, parts = D.TERM_SMOOTHING, []
    for i in range(1, LDA_STEPS + 1):
        parts.append(f"""select {i}::int as iteration, sum(n) as words, round(-sum(n * ln(chance)) / sum(n), 7) as log_perplexity from (
  select c.corpus_id, c.term_id, any_value(c.n) as n, sum(d.v * (t.v + {eta}) / (o.v + {eta} * n_terms)) as chance
  from counts c join dv{i} d using (corpus_id) join tv{i} t on t.term_id = c.term_id and t.topic = d.topic join total{i} o on o.topic = d.topic, size
  where ('0x' || substr(md5(c.corpus_id::varchar), 1, 7))::bigint % {D.MEASURED} = 0 group by c.corpus_id, c.term_id)""")
    return _sql_training() + " " + " union all ".join(parts)


# --- files ----------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/check-{uuid.uuid4().hex}"


def separated_records(spark, sf):
    path, separator = _folder(spark), "=====8<====="
    TF.write_separated(table(spark, sf, "documents").select("doc_id", "text"), path, separator)
    back = TF.read_separated(spark, path, separator)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


def doc_tag_file(spark, sf):
    path = _folder(spark)
    docs = table(spark, sf, "documents")
    docs.select(F.concat_ws(",", F.col("doc_id").cast("string"), "lang", "source")).write.text(path)
    return TF.read_doc_tags(spark, path).select("row", "col", "value")


def rule_file(spark, sf):
    """A rule per document source, and comment and broken lines in between."""
    path = _folder(spark)
    docs = table(spark, sf, "documents")
    rule = F.concat(F.lit('"'), "source", F.lit('","'), "source", F.lit('-[a-z]+"'))
    lines = F.when(F.col("doc_id") % 3 == 0, rule).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" # "), rule)).otherwise(F.col("source"))
    docs.select(lines.alias("value")).write.text(path)
    return TF.read_rules(spark, path)


def id_group_file(spark, sf):
    path = _folder(spark)
    table(spark, sf, "labels").select(F.col("doc_id").cast("string")).write.text(path)
    return TF.read_id_group(spark, path)


def id_list_file(spark, sf):
    path = _folder(spark)
    table(spark, sf, "lineitem").select(F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).write.text(path)
    return TF.read_id_list(spark, path)


def delimited_file(spark, sf):
    path = _folder(spark)
    pages = table(spark, sf, "pages")
    pages.select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("#"), "url")).otherwise(F.col("url"))).write.text(path)
    fields = TF.read_delimited(spark, path, "[/:?]+")
    return fields.select(F.array_join("fields", "|").alias("fields"))


def crosstab_file(spark, sf):
    path = _folder(spark)
    from topicloom.operators import crosstab as X

    ST.write_crosstab(S.records(spark, sf), path)
    return X.contingency(ST.read_crosstab(spark, path))


def corpus_files(spark, sf):
    """The corpus tables as files: what a stored id index and corpus say about every document."""
    from topicloom.plans import pipelines as PL

    made, path = PL.corpus(table(spark, sf, "documents").select("doc_id", "text")), _folder(spark)
    ST.write_corpus(path, **{k: v for k, v in made.items() if k in ST.CORPUS_TABLES})
    index, kept = ST.read_corpus(spark, path, "id_index"), ST.read_corpus(spark, path, "corpus")
    return index.join(kept, "corpus_id").select("doc_id", "corpus_id", F.md5(F.array_join("tokens", " ")).alias("body_md5"))


def sorted_rows_file(spark, sf):
    """Rows of the joint matrix by entropy, their columns by value, as files."""
    from topicloom.operators import matrix as M

    path = _folder(spark)
    ST.write_sorted_rows(M.normalize_rows(M.joint(S.doc_tags(spark, sf), S.doc_topics(spark, sf))), path, with_entropy=True)
    back = spark.read.csv(path, header=True)
    return back.select("row", F.col("rank").cast("int").alias("rank"), F.col("col").cast("int").alias("col"), F.round(F.col("value").cast("double"), 7).alias("value"), F.round(F.col("entropy").cast("double"), 6).alias("entropy"))


def tag_agreement(spark, sf):
    """Agreement of tags with labelled topics, and the documents that have tags but no topics."""
    from topicloom.plans import pipelines as PL

    doc_topics = S.weights(spark, sf).withColumnRenamed("doc", "corpus_id")
    terms = spark.range(64).select(F.col("id").cast("int").alias("topic"), F.concat(F.lit("t"), "id").alias("term"), F.lit(1.0).alias("p"))
    made = PL.compare_tags(S.doc_tags(spark, sf), doc_topics, terms)
    agreed = made["harmony"].select("row", "col", F.round("value", 9).alias("value"), "rank")
    lost = made["ignored"].select(F.col("row").cast("string").alias("row"), F.lit(None).cast("string").alias("col"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("rank"))
    return agreed.unionByName(lost)


def dendrogram_file(spark, sf):
    path = _folder(spark)
    ST.write_dendrogram(order_tree(spark, sf), path)
    return ST.read_dendrogram(spark, path)


def json_records(spark, sf):
    """Orders per customer as nested JSON text and back."""
    orders = table(spark, sf, "orders")
    one = orders.select(
        "o_orderkey",
        F.struct(
            F.col("o_custkey").alias("customer"),
            F.array("o_orderstatus", "o_orderpriority").alias("labels"),
            F.create_map(F.lit("price"), F.col("o_totalprice")).alias("numbers"),
            F.to_date("o_orderdate").alias("day"),
        ).alias("doc"),
    )
    text = one.select("o_orderkey", jsonio.write("doc").alias("json"))
    back = text.select("o_orderkey", jsonio.read("json", "customer long, labels array<string>, numbers map<string,double>, day date").alias("d"))
    return back.select(
        "o_orderkey",
        "d.customer",
        F.array_join("d.labels", "|").alias("labels"),
        F.col("d.numbers")["price"].alias("price"),
        F.date_format("d.day", "yyyy/MM/dd").alias("day"),
    )


QUERIES = {
    "cluster_topics": (cluster_topics, _sql(_SQL_LINES + "select cut, cluster_id, topic, round(p, 9) as p from mt")),
    "cluster_versions": (
        cluster_versions,
        _sql(_SQL_LINES + "select cut, cluster_id, version, count(*) as n from mem join (select distinct point, doc_id, version from li) using (point) group by cut, cluster_id, version"),
    ),
    "cluster_files": (
        cluster_files,
        _sql(_SQL_LINES + "select cut, cluster_id, path, count(*) as n from mem join (select distinct point, doc_id, path from li) using (point) group by cut, cluster_id, path"),
    ),
    "cluster_dates": (
        cluster_dates,
        _sql(
            _SQL_LINES
            + "select cut, cluster_id, date, count(*) as n from mem join (select distinct l_orderkey as point,"
            + " l_orderkey * 10000000 + l_partkey * 100 + l_linenumber as doc_id, strftime(l_shipdate, '%Y/%m') as date from lineitem)"
            + " using (point) group by cut, cluster_id, date"
        ),
    ),
    "cluster_documents": (
        cluster_documents,
        _sql(
            _SQL_LINES
            + ", hits as ("
            + " union all ".join(
                f"select doc_id as point, '{n}' as rule from documents where regexp_matches(lower(text), '{r}')" for n, r in RULES
            )
            + f"""),
few as (select * from mem where cut in ({', '.join(map(str, REPORT_CUTS))})),
words as (select point, string_agg(rule, '|' order by rule) as rules from hits group by point),
dl as (select distinct l_orderkey as point, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber as doc_id, strftime(l_shipdate, '%Y/%m') as date from lineitem),
far as (
  select m.cut, m.cluster_id, m.point, sum((coalesce(wt.p, 0) - mt.p) * (coalesce(wt.p, 0) - mt.p)) as d2
  from few m join mt on mt.cut = m.cut and mt.cluster_id = m.cluster_id left join wt on wt.point = m.point and wt.topic = mt.topic
  where m.point in (select point from wt) group by m.cut, m.cluster_id, m.point),
told as (
  select cut, cluster_id, null as point, topic::varchar as name, p as value from mt where cut in (select cut from few)
  union all select cut, cluster_id, null, date, count(*) from few join dl using (point) group by cut, cluster_id, date
  union all select cut, cluster_id, null, version, count(*) from few join (select distinct point, doc_id, version from li) using (point) group by cut, cluster_id, version
  union all select cut, cluster_id, null, path::varchar, count(*) from few join (select distinct point, doc_id, path from li) using (point) group by cut, cluster_id, path
  union all select cut, cluster_id, null, rule, count(*) from few join hits using (point) group by cut, cluster_id, rule
  union all select cut, cluster_id, point, coalesce(rules, ''), d2 from far left join words using (point)
  union all select cut, cluster_id, point, '+' || doc_id, null from few join (select distinct point, doc_id from li) using (point))
select cut, cluster_id, point, name, round(value + 1e-11, 8) as value from told"""
        ),
    ),
    "cluster_sizes_file": (cluster_sizes_file, _sql("select cast(cut as double) as cut, cluster_id, size, density from cutn")),
    "cut_files": (
        cut_files,
        _sql(f"""select distinct cast(cut as double) as cut, k.cluster_id, c2.cluster_id as node, n.size, round(n.density, 6) as density, n.parent_id
from cutn k join chain c using (cluster_id) join chain c2 on c2.point = c.point and c2.level <= c.level
join nodes n on n.cluster_id = c2.cluster_id where cut = {REPORT_CUTS[0]}"""),
    ),
    "trend_files": (
        trend_files,
        f"""with {S.SQL_WEIGHTS}, {S.SQL_TAGS},
releases as (select max(tag) as tag, ts from tags where not contains(tag, 'rc') and not contains(tag, '-') and starts_with(tag, 'v') group by ts),
rel as (select event_id as doc, coalesce(tag, 'rc') as release from events e asof left join releases r on e.ts >= r.ts where event_id in (select doc from vecs)),
n as (select release, count(*) as n from rel group by release)
select cast(topic as int) as topic, concat('T', topic, '-t', topic) as label, release, round(sum(p) / any_value(n), 6) as p
from rel join w using (doc) join n using (release) group by topic, release""",
    ),
    "document_report": (
        document_report,
        _sql(""", paid as (select o_orderkey as point, row_number() over (partition by c_nationkey order by o_totalprice desc, o_orderkey desc) as rn
  from orders join customer on c_custkey = o_custkey),
asked as (select point from paid where rn = 1),
way as (select c.point, c.level, c.cluster_id, n.size, n.density, n.left_id, n.right_id, b.size as most
  from asked join chain c using (point) join nodes n using (cluster_id) join best b on b.point = c.point),
steps as (select *, lag(cluster_id) over (partition by point order by level) as child from way where size <= most),
added as (select point, level, case when child is null then cluster_id when child = left_id then right_id else left_id end as added_id from steps),
facts as (select o_orderkey as point, o_orderpriority as subject, strftime(o_orderdate, '%Y/%m/%d') as date, o_orderstatus as version from orders join asked on o_orderkey = point),
wt as (select l_orderkey as point, l_linenumber as topic, sum(l_quantity) / sum(sum(l_quantity)) over (partition by l_orderkey) as p
       from lineitem group by l_orderkey, l_linenumber)
select point, 'commit' as kind, 0 as place, point::varchar as name, null::double as value from facts
union all select point, 'subject', 0, subject, null from facts
union all select point, 'date', 0, date, 1 from facts
union all select point, 'version', 0, version, 1 from facts
union all select distinct point, 'file', 0, l_suppkey::varchar, null from lineitem join asked on l_orderkey = point
union all select point, 'topic', 0, topic::varchar, round(p, 6) from wt join asked using (point)
union all select point, 'trend', 0, size::varchar, round(density, 6) from way
union all select point, 'chain', level, cluster_id::varchar, size from steps
union all select a.point, 'new_point', a.level, c.point::varchar, null from added a join chain c on c.cluster_id = a.added_id"""),
    ),
    "corpus_files": (
        corpus_files,
        sql_corpus()
        + """, sl as (select list(term) as s from stops),
kept as (select corpus_id, array_to_string(list_filter(tokens, lambda t: not coalesce(list_contains(s, t), false)), ' ') as body from uniq, sl)
select d.doc_id, g.corpus_id, md5(k.body) as body_md5 from docs d join groups g on g.body = d.body join kept k using (corpus_id) where k.body <> ''""",
    ),
    "sorted_rows_file": (
        sorted_rows_file,
        f"""with {S.SQL_TAG_MATRIX}, q as (select tag, topic, value / sum(value) over (partition by tag) as v from both_p),
e as (select tag, -sum(v * log2(v)) as entropy from q group by tag)
select tag as row, cast(row_number() over (partition by tag order by v desc, topic) as int) as rank, cast(topic as int) as col, round(v, 7) as value, round(entropy, 6) as entropy
from q join e using (tag)""",
    ),
    "tag_agreement": (
        tag_agreement,
        f"""with {S.SQL_TAG_MATRIX},
pt as (select tag, sum(t) / (select n from nd) as pt from shared group by tag),
pp as (select topic, sum(p) / (select n from nd) as pp from shared_w group by topic),
h as (select tag, concat('T', topic, '-t', topic) as label, 2 * value / (pt + pp) as value from both_p join pt using (tag) join pp using (topic))
select tag as row, label as col, round(value, 9) as value, cast(row_number() over (partition by tag order by value desc, label) as int) as rank from h
union all select distinct doc_id::varchar, null, null, 0 from documents where doc_id not in (select doc from vecs)""",
    ),
    "cluster_point_distance": (
        cluster_point_distance,
        _sql(
            _SQL_LINES
            + """select m.cut, m.cluster_id, m.point, round(sum((coalesce(wt.p, 0) - mt.p) * (coalesce(wt.p, 0) - mt.p)), 7) as d2
from mem m join mt on mt.cut = m.cut and mt.cluster_id = m.cluster_id
left join wt on wt.point = m.point and wt.topic = mt.topic
where m.point in (select point from wt) group by m.cut, m.cluster_id, m.point"""
        ),
    ),
    "cluster_keywords": (
        cluster_keywords,
        _sql(
            _SQL_LINES
            + ", hits as ("
            + " union all ".join(
                f"select doc_id as point, '{n}' as rule from documents where regexp_matches(lower(text), '{r}')" for n, r in RULES
            )
            + ") select cut, cluster_id, rule, count(*) as n from mem join hits using (point) group by cut, cluster_id, rule"
        ),
    ),
    "cluster_originals": (
        cluster_originals,
        _sql(
            _SQL_LINES
            + """select cut, cluster_id, count(*) as n, cast(sum(doc_id) as varchar) as ids
from mem join (select distinct point, doc_id from li) using (point) group by cut, cluster_id"""
        ),
    ),
    "term_ids": (term_ids, _SQL_TERMS + "select term, term_id from terms"),
    "term_counts": (
        term_counts,
        _SQL_TERMS + "select corpus_id, term_id, count(*) as n from uses join terms using (term) group by corpus_id, term_id",
    ),
    "row_ids": (row_ids, _SQL_TERMS + "select corpus_id, row_number() over (order by corpus_id) - 1 as row_id from full_"),
    "lda_topics": (
        lda_topics,
        _sql_training()
        + f" select topic::int as topic, term, round(t.v / o.v, 8) as p from tv{LDA_STEPS} t join terms using (term_id) join total{LDA_STEPS} o using (topic)",
    ),
    "lda_documents": (lda_documents, _sql_training() + f" select corpus_id, topic::int as topic, round(v, 8) as p from dv{LDA_STEPS}"),
    "lda_perplexity": (lda_perplexity, _sql_perplexity()),
    "separated_records": (
        separated_records,
        "select doc_id, md5(regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) as text_md5 from documents",
    ),
    "doc_tag_file": (
        doc_tag_file,
        "select cast(doc_id as varchar) as row, unnest([lang, source]) as col, 1.0::double as value from documents",
    ),
    "rule_file": (
        rule_file,
        "select source as name, concat(source, '-[a-z]+') as regex from documents where doc_id % 3 = 0 group by source",
    ),
    "id_group_file": (id_group_file, "select distinct doc_id as doc from labels"),
    "id_list_file": (id_list_file, "select distinct cast(l_partkey as varchar) as id from lineitem"),
    "delimited_file": (
        delimited_file,
        "select array_to_string(regexp_split_to_array(url, '[/:?]+'), '|') as fields from pages where page_id % 5 <> 0",
    ),
    "crosstab_file": (
        crosstab_file,
        f"with {S.SQL_RECORDS} select objective, var, count(*) as n from keys_ join labels_ using (key) group by objective, var",
    ),
    "dendrogram_file": (dendrogram_file, _sql("select * from nodes")),
    "json_records": (
        json_records,
        """select o_orderkey, o_custkey as customer, concat(o_orderstatus, '|', o_orderpriority) as labels, o_totalprice as price,
strftime(o_orderdate, '%Y/%m/%d') as day from orders""",
    ),
}
