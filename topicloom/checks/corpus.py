"""Corpus: tokens, copies, document frequency, stop words."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.checks import table
from topicloom.functions import text as T
from topicloom.operators import corpus as C
from topicloom.scale import checkpoint


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def sql_tokens(paragraph: str, split_underscore: bool = False, words=T.STOP_WORDS_SHORT) -> str:
    run = r"([\p{L}\p{M}\p{Nd}]+)" if split_underscore else r"([\p{L}\p{M}\p{Nd}_]+)"
    # runs are cut every 255 characters: only the last piece can be short enough to stay
    pieces = (
        f"list_transform(regexp_extract_all({paragraph}, '{run}', 1), "
        f"lambda r: substr(r, 255 * (length(r) // 255) + 1))"
    )
    return (
        f"list_filter({pieces}, lambda t: length(t) between 2 and 20 "
        f"and t not in ({_quoted(words)}) and not regexp_full_match(t, '[a-f0-9]+|0x[a-f0-9]+'))"
    )


def sql_paragraphs(text: str, separator: str = r"E'\n\n'") -> str:
    marks = " or ".join(f"contains(p, '{m}')" for m in T.SIGNATURE_MARKS)
    a, b = T.SIGNATURE_MARK_PAIR
    return (
        f"list_filter(string_split(lower({text}), {separator}), lambda p: "
        f"not (not regexp_matches(p, '[^\\x00-\\x20]') or {marks} "
        f"or (contains(p, '{a}') and contains(p, '{b}'))))"
    )


def sql_docs(source: str = "documents", id_col: str = "doc_id", **options) -> str:
    return (
        f"select {id_col} as doc_id, flatten(list_transform({sql_paragraphs('text')}, "
        f"lambda p: {sql_tokens('p', **options)})) as tokens from {source}"
    )


def sql_corpus() -> str:
    """Common tables: docs, groups (one row per content), uniq, dfreq, stops."""
    return f"""
with toks as materialized ({sql_docs()}),
docs as (select doc_id, tokens, array_to_string(tokens, ' ') as body from toks where len(tokens) >= 2),
groups as (select body, min(doc_id) as first_id, count(*) as copies,
                  row_number() over (order by min(doc_id)) - 1 as corpus_id from docs group by body),
uniq as (select g.corpus_id, d.tokens from docs d join groups g on d.doc_id = g.first_id),
dfreq as (select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from uniq) group by term),
stops as (select term from dfreq where df > floor((select count(*) from uniq) / 5))
"""


def _docs(spark, sf):
    return C.tokenize(table(spark, sf, "documents"))


def doc_tokens(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.array_join("tokens", " ").alias("body"), F.size("tokens").cast("long").alias("n_tokens")
    )


def turn_tokens(spark, sf):
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"
    )
    docs = C.tokenize(turns, split_underscore=True, stop_words=T.STOP_WORDS_LONG)
    return docs.select("doc_id", F.array_join("tokens", " ").alias("body"))


def paragraph_docs(spark, sf):
    docs = C.tokenize(table(spark, sf, "documents"), by_paragraph=True, separator="\n")
    return docs.select("doc_id", F.array_join("tokens", " ").alias("body"))


def _signed(spark, sf):
    """Every text with a second paragraph, a signature on every other one."""
    last = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Signed-off-by: "), "source")).otherwise(F.concat(F.lit("Second paragraph of "), "source"))
    return table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n\n"), last).alias("text"))


def signed_paragraphs(spark, sf):
    docs = C.tokenize(_signed(spark, sf), by_paragraph=True)
    return docs.select("doc_id", F.array_join("tokens", " ").alias("body"))


def subjects(spark, sf):
    """First line, and a digest of the cleaned text."""
    docs = table(spark, sf, "documents").select("doc_id", T.subject(F.col("text")).alias("subject"))
    return docs.select("doc_id", F.md5("subject").alias("subject_md5"), F.length("subject").cast("long").alias("n_chars"))


def dedup_groups(spark, sf):
    docs = _docs(spark, sf)
    return C.copies(docs).select("first_id", "copies", F.length("hash").cast("long").alias("hash_len"))


def content_hashes(spark, sf):
    """What a document's hash is taken of, under the function that both engines have."""
    return _docs(spark, sf).select("doc_id", T.content_hash(F.col("tokens"), 256).alias("hash"))


def corpus_ids(spark, sf):
    docs = checkpoint(_docs(spark, sf))
    return C.id_index(docs, C.corpus_ids(docs))


def doc_freq(spark, sf):
    docs = checkpoint(_docs(spark, sf))
    groups = C.copies(docs)
    return C.mark_stop_words(C.doc_freq(C.distinct_docs(docs, groups)), groups)


def corpus_docs(spark, sf):
    docs = checkpoint(_docs(spark, sf))
    ids = C.corpus_ids(docs)
    corpus = C.corpus_docs(docs, ids)
    stops = C.mark_stop_words(C.doc_freq(corpus), ids).filter("is_stop")
    return C.strip_stop_words(corpus, stops).select("corpus_id", F.array_join("tokens", " ").alias("body"))


def corpus_stats(spark, sf):
    return C.corpus_stats(checkpoint(_docs(spark, sf)))


def stemmed_tokens(spark, sf):
    # stem table from the data: a plural of the benchmark texts loses its last letter
    stems = (
        C.tokenize(table(spark, sf, "benchmark"), id_col="item_id")
        .select(F.explode("tokens").alias("term"))
        .distinct()
        .filter(F.col("term").endswith("s"))
        .select("term", F.expr("left(term, length(term) - 1)").alias("stem"))
    )
    return C.stem(_docs(spark, sf), stems).select("doc_id", F.array_join("tokens", " ").alias("body"))


QUERIES = {
    "doc_tokens": (
        doc_tokens,
        f"select doc_id, array_to_string(tokens, ' ') as body, len(tokens) as n_tokens from ({sql_docs()}) where len(tokens) >= 2",
    ),
    "turn_tokens": (
        turn_tokens,
        "select doc_id, array_to_string(tokens, ' ') as body from ("
        + sql_docs("conversations", "conv_id * 1000 + turn", split_underscore=True, words=T.STOP_WORDS_LONG)
        + ") where len(tokens) >= 2",
    ),
    "paragraph_docs": (
        paragraph_docs,
        f"""
with paras as (select doc_id, list_filter(list_transform({sql_paragraphs('text', "chr(10)")}, lambda p: {sql_tokens('p')}),
                                          lambda x: len(x) >= 2) as ps from documents),
numbered as (select doc_id, unnest(ps) as tokens, unnest(range(len(ps))) as n from paras)
select concat(doc_id, '-', n) as doc_id, array_to_string(tokens, ' ') as body from numbered""",
    ),
    "signed_paragraphs": (
        signed_paragraphs,
        f"""
with signed as (select doc_id, text || E'\\n\\n' || case when doc_id % 2 = 0 then 'Signed-off-by: ' else 'Second paragraph of ' end || source as text
                from documents),
paras as (select doc_id, list_filter(list_transform({sql_paragraphs('text')}, lambda p: {sql_tokens('p')}), lambda x: len(x) >= 2) as ps from signed),
numbered as (select doc_id, unnest(ps) as tokens, unnest(range(len(ps))) as n from paras)
select concat(doc_id, '-', n) as doc_id, array_to_string(tokens, ' ') as body from numbered""",
    ),
    "subjects": (
        subjects,
        "select doc_id, md5(split_part(text, chr(10), 1)) as subject_md5, length(split_part(text, chr(10), 1)) as n_chars from documents",
    ),
    "dedup_groups": (dedup_groups, sql_corpus() + "select first_id, copies, cast(128 as bigint) as hash_len from groups"),
    "content_hashes": (
        content_hashes,
        f"select doc_id, sha256(array_to_string(tokens, ' ')) as hash from ({sql_docs()}) where len(tokens) >= 2",
    ),
    "corpus_ids": (
        corpus_ids,
        sql_corpus() + "select g.corpus_id, d.doc_id from docs d join groups g on g.body = d.body",
    ),
    "doc_freq": (
        doc_freq,
        f"""
with docs as materialized (select any_value(tokens) as tokens from ({sql_docs()}) where len(tokens) >= 2 group by array_to_string(tokens, ' ')),
limits as (select floor(count(*) / 5) as most from docs)
select term, count(*) as df, count(*) > any_value(most) as is_stop from (select unnest(list_distinct(tokens)) as term from docs), limits group by term""",
    ),
    "corpus_docs": (
        corpus_docs,
        sql_corpus()
        + """, sl as (select list(term) as s from stops)
select corpus_id, array_to_string(kept, ' ') as body
from (select corpus_id, list_filter(tokens, lambda t: not coalesce(list_contains(s, t), false)) as kept from uniq, sl)
where len(kept) > 0""",
    ),
    "corpus_stats": (
        corpus_stats,
        sql_corpus()
        + "select count(*) as n_records, count(*) as n_documents, (select count(*) from groups) as n_unique from docs",
    ),
    "stemmed_tokens": (
        stemmed_tokens,
        f"""
with toks as ({sql_docs()}),
stems as (select distinct term, left(term, length(term) - 1) as stem
          from (select unnest(tokens) as term, len(tokens) as n from ({sql_docs('benchmark', 'item_id')}))
          where n >= 2 and term like '%s'),
words as (select doc_id, unnest(tokens) as term, unnest(range(len(tokens))) as pos from toks where len(tokens) >= 2)
select doc_id, string_agg(coalesce(stem, words.term), ' ' order by pos) as body
from words left join stems on stems.term = words.term group by doc_id""",
    ),
}
