"""The user-level pipelines. Each takes tables and gives back named tables; :func:`save` writes them.

Tables: ``commits(id, ts, parents or n_parents, message)``, ``changes(id, status, old_path, new_path)``,
``tags(tag, ts)``, ``doc_topics(corpus_id, topic, p)``, ``topic_terms(topic, term, p)``, ``points(point, v)``,
``nodes`` as in :mod:`topicloom.operators.tree`, ``id_index(corpus_id, doc_id)``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import keywords as K
from topicloom.functions import paths as P
from topicloom.functions import text as T
from topicloom.operators import asof, kmeans, lda, linkage
from topicloom.operators import clusters as R
from topicloom.operators import corpus as C
from topicloom.operators import crosstab as X
from topicloom.operators import matrix as M
from topicloom.operators import topics as W
from topicloom.operators import tree as G
from topicloom.scale import checkpoint
from topicloom.sources import commits as S
from topicloom.sources import tables as ST
from topicloom.sources import text_files as TF

Tables = dict[str, DataFrame]


def save(tables: Tables, path: str, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


# --- corpus ---------------------------------------------------------------------------------------------------


def corpus(
    docs: DataFrame,
    by_paragraph: bool = False,
    split_underscore: bool = False,
    long_stop_words: bool = False,
    stems: DataFrame | None = None,
) -> Tables:
    """Cleaned corpus of ``docs(doc_id, text)``: docs, id_index, corpus, doc_freq, stats."""
    words = T.STOP_WORDS_LONG if long_stop_words else T.STOP_WORDS_SHORT
    tokens = C.tokenize(docs, by_paragraph=by_paragraph, split_underscore=split_underscore, stop_words=words)
    tokens = checkpoint(C.stem(tokens, stems) if stems is not None else tokens)
    ids = checkpoint(C.corpus_ids(tokens))
    unique = checkpoint(C.corpus_docs(tokens, ids))
    terms = checkpoint(C.mark_stop_words(C.doc_freq(unique), ids))
    options = [F.lit(v).alias(k) for k, v in (("by_paragraph", by_paragraph), ("split_underscore", split_underscore), ("long_stop_words", long_stop_words))]
    record = F.regexp_replace("doc_id", "-[0-9]+$", "") if by_paragraph else F.col("doc_id")
    return {
        "docs": unique,
        "id_index": C.id_index(tokens, ids).withColumn("record_id", record),
        "corpus": C.strip_stop_words(unique, terms.filter("is_stop")),
        "doc_freq": terms,
        "stats": C.corpus_stats(tokens, by_paragraph).select("*", *options),
    }


def _commit_docs(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("id").alias("doc_id"), F.col("message").alias("text"))


def _commit_facts(commits: DataFrame, tags: DataFrame) -> DataFrame:
    described = asof.asof_join(commits, tags).withColumnRenamed("tag", "version")
    return described.select(F.col("id").alias("doc_id"), "ts", T.slash_date(F.col("ts")).alias("date"), "version", F.col("message").alias("text"))


def _commit_corpus(log: DataFrame, files: DataFrame, tags: DataFrame, **options) -> Tables:
    """The corpus of the commits, with facts and files of those that are in it."""
    made = corpus(_commit_docs(log), **options)
    kept = checkpoint(made["id_index"].select(F.col("record_id").alias("doc_id")).distinct())
    facts = _commit_facts(log, tags).join(kept, "doc_id", "left_semi")
    return {**made, "commits": facts, "files": files.withColumnRenamed("id", "doc_id").join(kept, "doc_id", "left_semi")}


def corpus_of_log(commits: DataFrame, changes: DataFrame, tags: DataFrame, since=None, until=None, paths=None, merges=False, **options) -> Tables:
    """Corpus of a commit log, merges left out unless asked."""
    files = S.files_changed(changes)
    return _commit_corpus(S.commit_log(commits, files, since, until, paths, merges), files, tags, **options)


def corpus_of_ids(commits: DataFrame, changes: DataFrame, tags: DataFrame, ids: DataFrame, **options) -> Tables:
    """Corpus of the listed commits, merges included."""
    return corpus_of_log(S.listed_commits(commits, ids), changes, tags, merges=True, **options)


def corpus_of_stable(commits: DataFrame, changes: DataFrame, tags: DataFrame, paths=None, **options) -> Tables:
    """Corpus of the commits of stable series."""
    files = S.files_changed(changes)
    return _commit_corpus(S.stable_commits(commits, tags, files, paths).drop("version"), files, tags, **options)


def corpus_of_text(spark: SparkSession, path: str, separator: str, **options) -> Tables:
    """Corpus of a file of separated records."""
    return corpus(TF.read_separated(spark, path, separator), **options)


# --- topics ---------------------------------------------------------------------------------------------------


def train_topics(corpus_docs: DataFrame, topics: int = lda.TOPICS, iterations: int = lda.ITERATIONS, **options) -> Tables:
    """Topics of the corpus, the topics of every document, and the perplexity along the way."""
    return {**lda.train(corpus_docs, topics, iterations, **options), "row_ids": lda.row_ids(corpus_docs)}


def dump_topics(topic_terms: DataFrame, doc_topics: DataFrame, n: int = 30) -> Tables:
    labels = W.topic_labels(topic_terms)
    return {
        "top_terms": W.top_n(topic_terms, ["topic"], "p", "term", n),
        "top_topics": W.top_n(doc_topics, ["corpus_id"], "p", "topic", n).join(labels, "topic"),
    }


def document_group(points: DataFrame, group: DataFrame, n: int = 10) -> Tables:
    """Documents of ``group(point)`` by distance to their centroid, with the strongest topics of each."""
    members = W.in_group(points, group, "point").withColumn("_all", F.lit(1))
    near = checkpoint(W.distance_to_centroid(members, ["_all"]).drop("_all"))
    center = near.select("center").limit(1).select(F.posexplode("center").alias("topic", "p"))
    return {
        "centroid": center.orderBy(F.desc("p"), "topic").limit(n),
        "documents": near.select("point", "d2").orderBy("d2", "point"),
        "topics": W.top_n(W.weights(near, "point"), ["point"], "p", "topic", n),
    }


def topic_trend(
    doc_topics: DataFrame, id_index: DataFrame, commits: DataFrame, changes: DataFrame, tags: DataFrame, all_commits: bool = False
) -> Tables:
    """p(topic | release) and p(topic | directory) over the originals of the corpus documents.

    The original of a paragraph is its commit (``record_id``). Shares are of the documents in the corpus, or, with
    ``all_commits``, sums over the commits of the release or directory that are no merges.
    """
    log = S.no_merges(commits)
    record = "record_id" if "record_id" in id_index.columns else "doc_id"
    originals = id_index.select("corpus_id", "doc_id", F.col(record).alias("_record"))
    in_corpus = checkpoint(commits.join(originals, commits["id"] == originals["_record"]).select("corpus_id", "doc_id", "id", "ts"))
    weights = id_index.join(doc_topics, "corpus_id").select("doc_id", "topic", "p")
    released = asof.with_release(in_corpus.select("doc_id", "id", "ts"), tags)
    in_dirs = S.files_changed(changes).select("id", F.explode(P.ancestors(F.col("path"))).alias("dir")).distinct()
    dirs = in_dirs.join(in_corpus.select("doc_id", "id"), "id").select("doc_id", "dir")
    if not all_commits:
        return {
            "by_release": W.topic_share(weights, released, "release", "doc_id"),
            "by_directory": W.topic_share(weights, dirs, "dir", "doc_id"),
        }
    commits_of = {"release": asof.with_release(log, tags).groupBy("release"), "dir": in_dirs.join(log.select("id"), "id", "left_semi").groupBy("dir")}
    shares = {}
    for name, key, table in (("by_release", "release", released), ("by_directory", "dir", dirs)):
        summed = weights.join(table.select("doc_id", key), "doc_id").groupBy("topic", key).agg(F.sum("p").alias("p"))
        total = commits_of[key].agg(F.countDistinct("id").alias("n"))
        shares[name] = summed.join(total, key).select("topic", key, (F.col("p") / F.col("n")).alias("p"))
    return shares


def save_trend(trend: Tables, topic_terms: DataFrame, tags: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Shares by release, in the order of release, and by directory, a folder for each topic named by its label."""
    labels = W.topic_labels(topic_terms)
    releases = tags.groupBy(F.col("tag").alias("release")).agg(F.min("ts").alias("place"))
    ST.write_trend(trend["by_release"], "release", labels, f"{path}/version", releases, mode)
    ST.write_trend(trend["by_directory"], "dir", labels, f"{path}/directory", None, mode)


def compare_tags(doc_tags: DataFrame, doc_topics: DataFrame, topic_terms: DataFrame) -> Tables:
    """Agreement of manual tags ``(row, col, value)`` with topics; documents on one side only are listed."""
    labels = W.topic_labels(topic_terms)
    topics = doc_topics.join(labels, "topic").select(F.col("corpus_id").alias("row"), F.col("label").alias("col"), F.col("p").alias("value"))
    return {
        "joint": M.joint(doc_tags, topics),
        "harmony": M.sort_columns(M.harmony(doc_tags, topics)),
        "ignored": M.lost_rows(doc_tags, topics),
    }


# --- clusterings ----------------------------------------------------------------------------------------------


def top_down(points: DataFrame, levels: int = kmeans.LEVELS, **options) -> Tables:
    made = kmeans.bisect(points, levels, **options)
    return {"members": made.members, "clusters": made.clusters, "restarts": made.restarts}


def dump_top_down(clusters: DataFrame, topic_terms: DataFrame) -> Tables:
    return {"centroids": kmeans.cluster_report(clusters, W.topic_labels(topic_terms, words=1))}


def bottom_up(points: DataFrame, topic_terms: DataFrame | None = None, sequential: bool = False) -> Tables:
    """Average-linkage hierarchy with the labelled centroid of every node."""
    nodes = checkpoint(linkage.dendrogram(points, checkpoint(linkage.merges(points, sequential))))
    labels = W.topic_labels(topic_terms) if topic_terms is not None else None
    return {"nodes": nodes, "centroids": G.node_centroids(nodes, points, labels)}


def bottom_up_by_dimension(points: DataFrame) -> Tables:
    merged = checkpoint(linkage.dimension_merges(points))
    return {"nodes": linkage.dimension_dendrogram(points, merged)}


def graph(nodes: DataFrame, start: DataFrame | None = None, depth: int = 5) -> Tables:
    shown = checkpoint(G.subtree(nodes, start, depth))
    return {"nodes": shown, "edges": G.edges(shown)}


def cut(nodes: DataFrame, g: float) -> Tables:
    return {"summary": G.by_size(G.cut(nodes, g)), "subtrees": G.under_cuts(nodes, [g], only_points=False)}


def save_cut(nodes: DataFrame, g: float, path: str, mode: str = "errorifexists") -> None:
    """Cut the hierarchy and write the nodes below each cut cluster."""
    made = cut(nodes, g)
    ST.write_cut(made["summary"], made["subtrees"], nodes, path, mode)


def cluster_metrics(
    nodes: DataFrame,
    doc_topics: DataFrame,
    id_index: DataFrame,
    commits: DataFrame,
    files: DataFrame,
    rules: K.Rules = K.DEFAULT_RULES,
    cuts: Iterable[float] | None = None,
) -> Tables:
    """Report of every cluster of a sweep of cuts. ``commits(doc_id, ts, version, text)``, ``files(doc_id, path)``.

    ``documents`` are the lines of one JSON document per cluster; :func:`save_cluster_metrics` writes them.
    """
    cuts = list(cuts) if cuts is not None else G.sweep()
    members = checkpoint(G.under_cuts(nodes, cuts).withColumnRenamed("node", "point"))
    weights = doc_topics.withColumnRenamed("corpus_id", "point")
    index = id_index.withColumnRenamed("corpus_id", "point")
    point_rules = checkpoint(R.keyword_points(index, commits, rules))
    dates = commits.select("doc_id", T.slash_date(F.col("ts")).alias("date"))
    versions, paths = commits.select("doc_id", "version"), files.select("doc_id", "path")
    report = checkpoint(R.report(members, weights, index, versions, dates, paths, point_rules))
    distances, originals = checkpoint(R.point_distances(members, weights)), R.originals(members, index)
    sizes = checkpoint(G.cut_sweep(nodes, cuts))
    return {
        "sizes": sizes,
        "report": report,
        "points": R.ordered_points(distances),
        "originals": originals,
        "keywords": K.match_groups(commits.select("doc_id", "text"), rules),
        "documents": R.documents(sizes, report, distances, originals.select(*R.KEY, "point", "doc_id"), point_rules),
    }


def save_cluster_metrics(metrics: Tables, path: str, mode: str = "errorifexists") -> None:
    ST.write_cluster_documents(metrics["documents"], metrics["sizes"], path, mode)


def similar_documents(
    nodes: DataFrame, doc_topics: DataFrame, id_index: DataFrame, commits: DataFrame, files: DataFrame, doc_ids: DataFrame | None = None
) -> Tables:
    """The best cluster round documents, built up level by level, for all points or the asked ``doc_ids(doc_id)``.

    For asked documents only the rows on their way to the root are laid out (see :func:`topicloom.operators.tree.ancestors`).
    """
    index = id_index.withColumnRenamed("corpus_id", "point")
    asked = checkpoint(index.join(doc_ids, "doc_id", "left_semi").select("point").distinct()) if doc_ids is not None else None
    chain = checkpoint(G.incremental_chain(nodes, asked))
    if asked is not None:
        index = index.join(asked, "point", "left_semi")
    facts = R.point_facts(index, commits)
    topics = doc_topics.withColumnRenamed("corpus_id", "point")
    tables = {"chain": chain, "trend": G.density_trend(nodes, asked)}
    if asked is not None:
        topics = topics.join(asked, "point", "left_semi")
        # the new points of every level, written out only for the points asked for
        below = G.points_below(nodes, chain.select(F.col("added_id").alias("cluster_id")))
        tables["new_points"] = chain.select("point", "level", F.col("added_id").alias("cluster_id")).join(
            below.withColumnRenamed("point", "new_point"), "cluster_id"
        )
    own_files = facts.select("point", "doc_id").join(files, "doc_id").select("point", "path").distinct()
    return {**tables, "facts": facts, "files": own_files, "topics": topics}


def document_report(
    nodes: DataFrame, doc_topics: DataFrame, id_index: DataFrame, commits: DataFrame, files: DataFrame, doc_ids: DataFrame
) -> DataFrame:
    """``(point, kind, place, name, value)``: everything about the asked documents and their best clusters, an entry per row.

    :func:`topicloom.sources.tables.write_point_reports` writes it.
    """
    return R.document_rows(similar_documents(nodes, doc_topics, id_index, commits, files, doc_ids))


# --- labelled records -----------------------------------------------------------------------------------------

# The directories whose levels get tables of their own, and the classes reported with locations.
TOP_DIRS = ["drivers", "arch"]
SUB_DIRS = [("drivers", "net"), ("drivers", "media")]
LOCATED_CLASSES = ["hard state", "soft state"]


def bug_tables(records: X.Records, taxonomy: DataFrame) -> dict[str, X.Records]:
    """Record sets by name; each goes to :func:`topicloom.sources.tables.write_crosstab`."""
    bugs = X.holding(records, "fixclass:bug")
    out = {"bulk": records, "fixtype": X.with_prefix(records, "fixclass:")}
    named = {"fixedtopdir": "fixedloc:", "error": "error:", "errorclass": "errorclass:", "crash": "crash:"}
    named |= {f"{d}dir": f"fixedsubloc-{d}:" for d in TOP_DIRS}
    named |= {f"{a}{b}dir": f"fixedsubsubloc-{a}-{b}:" for a, b in SUB_DIRS}
    out |= {name: X.with_prefix(bugs, prefix) for name, prefix in named.items()}
    by = {"failuresite": "failuresite:", "trigger": "trigger:", "topdir": "fixedloc:"}
    by |= {f"{d}dir": f"fixedsubloc-{d}:" for d in TOP_DIRS}
    by |= {f"{a}{b}dir": f"fixedsubsubloc-{a}-{b}:" for a, b in SUB_DIRS}
    out |= {f"errorclass-by-{name}": X.rekey(bugs, "errorclass:", prefix) for name, prefix in by.items()}
    # a taxonomy is a short hand-written list
    for row in taxonomy.select("class").distinct().orderBy("class").collect():
        cls = row["class"]
        file = "errorsubclass/" + cls.replace(" ", "-").replace(":", "_")
        prefix = f"errorsubclass-{cls}:"
        out[file] = X.with_prefix(bugs, prefix)
        out[f"{file}-by-trigger"] = X.rekey(bugs, prefix, "trigger:")
        out[f"{file}-by-failuresite"] = X.rekey(bugs, prefix, "failuresite:")
        if cls in LOCATED_CLASSES:
            out[f"{file}-with-loc"] = X.components(bugs, f"errorclass:{cls}", "fixedsubloc-")
    return out
