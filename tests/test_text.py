"""Cleaning rules on hand-written texts."""

from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators import corpus as C


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def tokens(spark, *texts, **options):
    return {r["doc_id"]: r["tokens"] for r in C.tokenize(docs(spark, *texts), **options).collect()}


def test_signature_and_number_filters(spark):
    text = "Fix a race\n\nSigned-off-by: X\n\n\n\nadd 0x1f lock_dep 42"
    assert tokens(spark, text) == {0: ["fix", "race", "lock_dep"]}
    assert tokens(spark, text, split_underscore=True) == {0: ["fix", "race", "lock", "dep"]}
    # hexadecimal look-alikes go unless the switch keeps them; 0x1f stays then too
    assert tokens(spark, text, drop_hex=False) == {0: ["fix", "race", "add", "0x1f", "lock_dep"]}


def test_cherry_pick_and_upstream_paragraphs(spark):
    text = "one thing\n\n(Cherry Picked from x)\n\ncommit abc upstream\n\nthe commit stays here"
    assert tokens(spark, text) == {0: ["one", "thing", "commit", "stays", "here"]}


def test_one_word_documents_are_dropped(spark):
    assert tokens(spark, "leak", "leak\n\nthe", "", "two words") == {3: ["two", "words"]}


def test_paragraph_documents_are_numbered(spark):
    got = {
        r["doc_id"]: r["tokens"]
        for r in C.tokenize(docs(spark, "first words\n\nleak\n\nmore words here"), by_paragraph=True).collect()
    }
    assert got == {"0-0": ["first", "words"], "0-1": ["more", "words", "here"]}


def test_long_runs_are_cut(spark):
    text = "x" * 260 + " two words"
    assert tokens(spark, text) == {0: ["xxxxx", "two", "words"]}


def test_stop_word_limit_is_floored(spark):
    texts = [f"unique{i:02d}x zz{i:02d}y" for i in range(10)]
    texts[0] += " twice thrice"
    texts[1] += " twice thrice"
    texts[2] += " thrice"
    got = C.tokenize(docs(spark, *texts))
    groups = C.copies(got)
    marked = C.mark_stop_words(C.doc_freq(C.distinct_docs(got, groups)), groups)
    assert [r["term"] for r in marked.filter("is_stop").collect()] == ["thrice"]


def test_copies_share_a_dense_id(spark):
    got = C.tokenize(docs(spark, "same text", "other words", "same  text!", "third words"))
    ids = C.corpus_ids(got)
    index = {r["doc_id"]: r["corpus_id"] for r in C.id_index(got, ids).collect()}
    assert index == {0: 0, 1: 1, 2: 0, 3: 2}


def test_any_stop_list_keeps_rows_and_columns(spark):
    corpus = spark.createDataFrame([(0, 2, ["a", "b", "a", "c"]), (1, 1, ["a"])], "corpus_id long, copies long, tokens array<string>")
    for words in (["a"], ["a", "x"], ["a", *(f"x{i}" for i in range(6000))]):
        kept = C.strip_stop_words(corpus, spark.createDataFrame([(w,) for w in words], "term string"))
        assert kept.columns == corpus.columns and [tuple(r) for r in kept.collect()] == [(0, 2, ["b", "c"])]
    assert C.strip_stop_words(corpus, spark.createDataFrame([], "term string")).count() == 2


def test_no_rules_match_nothing(spark):
    from topicloom.functions import keywords as K

    texts = docs(spark, "a leak", "b")
    some, none = (K.match_rules(texts, rules) for rules in (K.DEFAULT_RULES, []))
    assert none.columns == some.columns and none.count() == 0
    assert K.match_groups(texts, []).count() == 0


def test_crash_detail(spark):
    from topicloom.functions.labels import _error_labels

    asked = spark.createDataFrame([(x,) for x in ("crash", "crash:", "crash:oops", "crash::x", "leak:a")], "e string")
    got = [r[0] for r in asked.select(_error_labels(F.col("e"))).collect()]
    assert [x[1:] for x in got] == [["crash:None"], ["crash:None"], ["crash:oops"], ["crash:"], []]


def test_subject_and_date(spark):
    row = spark.sql("select 'head\nbody' as m, timestamp'2024-01-05 10:00:00' as ts").select(T.subject(F.col("m")), T.slash_date(F.col("ts"))).first()
    assert list(row) == ["head", "2024/01/05"]
