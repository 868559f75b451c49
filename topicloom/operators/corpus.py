"""From documents to a deduplicated token corpus.

Tables: ``docs(doc_id, tokens)`` -> ``id_index(corpus_id, doc_id)`` in long form (a group of copies can be
any size, so it is never collected into an array), ``corpus(corpus_id, tokens)``, ``doc_freq(term, df)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.scale import ordered_index, spread

STOP_SHARE = 5  # a term in more than floor(N / 5) documents is a corpus stop word


def tokenize(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", by_paragraph: bool = False, **options
) -> DataFrame:
    """``(doc_id, tokens)`` of documents with two or more tokens.

    With ``by_paragraph`` every paragraph of two or more tokens is a document ``<id>-<n>``, n counted from 0.
    """
    docs = spread(docs.select(id_col, text_col), id_col)
    text = F.col(text_col)
    if by_paragraph:
        kept = F.filter(T.paragraph_tokens(text, **options), lambda p: F.size(p) >= 2)
        return docs.select(F.col(id_col).alias("_id"), F.posexplode(kept).alias("_n", "tokens")).select(
            F.concat_ws("-", F.col("_id").cast("string"), F.col("_n").cast("string")).alias("doc_id"), "tokens"
        )
    # explode of a zero- or one-element array: a plain filter would be pushed down and tokenize twice
    kept = F.filter(F.array(T.document_tokens(text, **options)), lambda t: F.size(t) >= 2)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(kept).alias("tokens"))


def stem(docs: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace each token by its stem in ``stems(term, stem)``; a term without a stem stays."""
    words = docs.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    stemmed = words.join(stems.select("term", "stem"), "term", "left").select(
        "doc_id", F.struct("pos", F.coalesce("stem", "term").alias("word")).alias("at")
    )
    # one group is one document's tokens, which came from one row
    ordered = F.sort_array(F.collect_list("at"))
    return stemmed.groupBy("doc_id").agg(F.transform(ordered, lambda a: a["word"]).alias("tokens"))


def copies(docs: DataFrame) -> DataFrame:
    """``(hash, first_id, copies)``: one row per distinct content, pre-aggregated before the shuffle."""
    return (
        docs.select(T.content_hash(F.col("tokens")).alias("hash"), "doc_id")
        .groupBy("hash")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    )


def distinct_docs(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The first document of each of the ``copies`` groups. The first id is unique, so no key is hot."""
    return docs.join(groups.select(F.col("first_id").alias("doc_id"), "copies"), "doc_id")


def corpus_ids(docs: DataFrame) -> DataFrame:
    """``(hash, first_id, copies, corpus_id)``: dense ids in first-seen order."""
    return ordered_index(copies(docs), ["first_id"], "corpus_id")


def id_index(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(corpus_id, doc_id)`` for every original document."""
    return (
        docs.select("doc_id", T.content_hash(F.col("tokens")).alias("hash"))
        .join(ids.select("hash", "corpus_id"), "hash")
        .select("corpus_id", "doc_id")
    )


def corpus_docs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(corpus_id, tokens)``, before corpus stop words are removed."""
    return docs.join(ids.select(F.col("first_id").alias("doc_id"), "corpus_id"), "doc_id").select(
        "corpus_id", "tokens"
    )


def doc_freq(unique_docs: DataFrame) -> DataFrame:
    """``(term, df)`` over documents without copies."""
    return (
        unique_docs.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def stop_limit(n_docs: Column) -> Column:
    return F.floor(n_docs / STOP_SHARE)


def mark_stop_words(df_table: DataFrame, groups: DataFrame) -> DataFrame:
    """``(term, df, is_stop)``; N = number of ``groups`` rows, as a scalar subquery."""
    n_docs = groups.agg(F.count("*")).scalar()
    return df_table.withColumn("is_stop", F.col("df") > stop_limit(n_docs))


def strip_stop_words(corpus: DataFrame, stops: DataFrame) -> DataFrame:
    """Remove the terms of ``stops(term)`` and drop documents that become empty; other columns stay.

    Corpus stop words are few by arithmetic: a term in more than a fifth of the documents uses up more than a
    fifth of a document's distinct terms, so there are fewer than 5 x (mean distinct terms of a document),
    however many documents there are. They become one hashed set in the plan.
    """
    words = [r["term"] for r in stops.select("term").distinct().orderBy("term").collect()]
    if not words:
        return corpus.filter(F.size("tokens") > 0)
    kept = corpus.withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(words)))
    return kept.filter(F.size("tokens") > 0)


def corpus_stats(docs: DataFrame, by_paragraph: bool = False) -> DataFrame:
    """One row: original records, documents, documents without copies."""
    record = F.regexp_replace(F.col("doc_id"), "-[0-9]+$", "") if by_paragraph else F.col("doc_id")
    keyed = docs.select(record.alias("rec"), T.content_hash(F.col("tokens")).alias("hash"))
    # two single-key aggregates instead of two distinct counts in one Expand
    recs = keyed.groupBy("rec").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents")
    )
    n_unique = keyed.select("hash").distinct().agg(F.count("*")).scalar()
    return recs.withColumn("n_unique", n_unique)
