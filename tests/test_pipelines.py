"""Pipelines from commits to reports, end to end on a small set."""

import json

import pytest
from pyspark.sql import functions as F

from topicloom.operators import lda
from topicloom.plans import pipelines as PL
from topicloom.sources import tables as ST

# enough words that none is in a fifth of the documents
WORDS = [f"{a}{b}" for a in ("lock", "page", "driver", "socket", "timer", "inode") for b in ("ing", "er", "table", "queue", "map", "list", "set", "ring")]


@pytest.fixture(scope="module")
def inputs(spark):
    ids = spark.range(60).withColumnRenamed("id", "n")
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = [F.element_at(words, (F.pmod(F.xxhash64("n", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int")) for k in range(6)]
    commits = ids.select(
        F.concat(F.lit("c"), F.col("n")).alias("id"),
        F.timestamp_seconds(F.col("n") * 40_000 + 1_000_000).alias("ts"),
        F.when(F.col("n") % 20 == 19, 2).otherwise(1).alias("n_parents"),
        F.concat(F.lit("Fix leak "), F.concat_ws(" ", *pick), F.lit("\n\nSigned-off-by: x")).alias("message"),
    )
    changes = ids.select(
        F.concat(F.lit("c"), F.col("n")).alias("id"),
        F.lit("MODIFY").alias("status"),
        F.concat(F.lit("drivers/d"), F.col("n") % 3, F.lit("/f.c")).alias("old_path"),
        F.lit("x.c").alias("new_path"),
    )
    tags = spark.createDataFrame([("v3.1", 1_400_000), ("v3.1-rc2", 1_200_000), ("v3.1.4", 2_600_000)], "tag string, s long").select(
        "tag", F.timestamp_seconds("s").alias("ts")
    )
    return commits, changes, tags


def test_from_log_to_cluster_metrics(spark, inputs, tmp_path):
    commits, changes, tags = inputs
    made = PL.corpus_of_log(commits, changes, tags)
    ST.write_corpus(str(tmp_path / "corpus"), **{k: v for k, v in made.items() if k in ST.CORPUS_TABLES})
    corpus = ST.read_corpus(spark, str(tmp_path / "corpus"), "corpus")
    stats = made["stats"].first()
    assert stats["n_records"] == 57
    assert corpus.filter(F.array_contains("tokens", "leak")).count() == 0  # in every document

    topics = PL.train_topics(corpus, topics=3, iterations=5)
    sums = topics["doc_topics"].groupBy("corpus_id").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == corpus.count() and all(r["s"] == pytest.approx(1.0) for r in sums)
    assert all(r["s"] == pytest.approx(1.0) for r in topics["topic_terms"].groupBy("topic").agg(F.sum("p").alias("s")).collect())
    dump = PL.dump_topics(topics["topic_terms"], topics["doc_topics"], 2)
    assert dump["top_terms"].count() == 6

    trend = PL.topic_trend(topics["doc_topics"], made["id_index"], commits, changes, tags)
    PL.save_trend(trend, topics["topic_terms"], tags, str(tmp_path / "trend"))
    saved = ST.read_trend(spark, str(tmp_path / "trend" / "version"), "release")
    assert saved.count() == trend["by_release"].count() and saved.where("label = ''").count() == 0
    folders = list((tmp_path / "trend" / "version").glob("topic=*"))
    when = {r["tag"]: r["ts"] for r in tags.collect()}
    for folder in folders:
        files = sorted(folder.glob("part-*"))
        shown = [line.split(",")[0] for f in files for line in f.read_text().splitlines()[1:]]
        known = [when[t] for t in shown if t in when]
        assert known == sorted(known) and shown
    assert len(list((tmp_path / "trend" / "version").glob("topic=*/part-*"))) <= len(folders) + 16
    for name, key in (("by_release", "release"), ("by_directory", "dir")):
        total = trend[name].groupBy(key).agg(F.sum("p").alias("s")).collect()
        assert total and all(r["s"] == pytest.approx(1.0) for r in total)

    hierarchy = PL.bottom_up(topics["points"], topics["topic_terms"])
    nodes, n = hierarchy["nodes"], corpus.count()
    assert nodes.count() == 2 * n - 1
    files = made["files"]
    assert files.join(made["id_index"], "doc_id", "left_anti").count() == 0  # of kept documents only
    metrics = PL.cluster_metrics(nodes, topics["doc_topics"], made["id_index"], made["commits"], files, cuts=[0.1, 2.0])
    whole = metrics["report"].filter("cut = 2.0 and kind = 'keyword' and name = 'bug.memory.leak'").first()
    assert whole["value"] == n
    PL.save_cluster_metrics(metrics, str(tmp_path / "metrics"))
    whole = next((tmp_path / "metrics" / "clusters" / "cut=2.0").iterdir())
    text = "".join(p.read_text() for p in sorted(whole.glob("part-*")))
    told = json.loads(text)
    assert told["cluster"]["size"] == n and len([p for p in told["points"] if "distance" in p]) == n
    assert sum(d["value"] for d in told["dates"]) == len([p for p in told["points"] if "commit" in p]) == made["id_index"].count()
    far = [p["distance"] for p in told["points"] if "distance" in p]
    assert far == sorted(far) and [t["value"] for t in told["topics"]] == sorted((t["value"] for t in told["topics"]), reverse=True)
    assert {k["keyword"]: k["value"] for k in told["keywords"]}["bug.memory.leak"] == n
    files_written = list((tmp_path / "metrics" / "clusters").glob("*/*/part-*"))
    assert len(files_written) <= metrics["sizes"].count() + spark.sparkContext.defaultParallelism * 4
    back = ST.read_cluster_documents(spark, str(tmp_path / "metrics"))
    assert back.where("cut = 2.0 and entry.point is not null and entry.commit is null").count() == n
    PL.save_cut(nodes, 2.0, str(tmp_path / "cut"))
    assert ST.read_cut(spark, str(tmp_path / "cut")).count() == nodes.count()
    assert [p.name for p in (tmp_path / "cut" / "all" / "cut=2.0").iterdir()] == [whole.name]

    asked = spark.createDataFrame([("c3",)], "doc_id string")
    near = PL.similar_documents(nodes, topics["doc_topics"], made["id_index"], made["commits"], files, asked)
    best = near["chain"].orderBy(F.desc("level")).first()
    assert near["new_points"].count() == best["size"]
    assert near["facts"].filter("doc_id = 'c3'").first()["subject"].startswith("Fix leak")
    rows = PL.document_report(nodes, topics["doc_topics"], made["id_index"], made["commits"], files, asked)
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds["subject"] == 1 and kinds["new_point"] == best["size"] and kinds["chain"] == near["chain"].count()
    ST.write_point_reports(rows, str(tmp_path / "points"))
    again = ST.read_point_reports(spark, str(tmp_path / "points"), "point long, kind string, place int, name string, value double, bucket long")
    assert again.count() == rows.count()


def test_stable_and_listed(spark, inputs):
    commits, changes, tags = inputs
    ids = commits.filter("id in ('c1', 'c2')").select("id")
    assert PL.corpus_of_ids(commits, changes, tags, ids)["stats"].first()["n_records"] == 2
    stable = PL.corpus_of_stable(commits, changes, tags)["commits"]
    assert {r["version"] for r in stable.select("version").distinct().collect()} <= {"v3.1", "v3.1.4"}


def test_listed_merges_stay(spark, inputs):
    commits, changes, tags = inputs
    ids = commits.filter("id in ('c18', 'c19', 'c39')").select("id")  # two of them are merges
    made = PL.corpus_of_ids(commits, changes, tags, ids)
    assert made["stats"].first()["n_records"] == 3 and made["commits"].count() == 3


@pytest.mark.parametrize("all_commits", [False, True])
def test_trend_of_paragraphs(spark, inputs, all_commits):
    commits, changes, tags = inputs
    two = commits.withColumn("message", F.concat("message", F.lit("\n\nSecond part of "), "id"))
    made = PL.corpus_of_log(two, changes, tags, by_paragraph=True)
    index = made["id_index"]
    assert index.filter("record_id = doc_id").count() == 0
    doc_topics = index.select("corpus_id").distinct().select("corpus_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("topic"), F.lit(0.5).alias("p"))
    trend = PL.topic_trend(doc_topics, index, two, changes, tags, all_commits)
    for name, key in (("by_release", "release"), ("by_directory", "dir")):
        rows = trend[name].groupBy(key).agg(F.sum("p").alias("s")).collect()
        assert rows and all(r["s"] == pytest.approx(2.0 if all_commits else 1.0) for r in rows)


def test_topics_are_reproducible(spark):
    rows = [(i, ["lock", "page"] * 3 + ["cache"] * (i % 3)) for i in range(90)] + [(90, ["once"])]
    corpus = spark.createDataFrame(rows, "corpus_id long, tokens array<string>")
    made = [lda.train(corpus, 2, 3, measure_every=1) for _ in range(2)]
    a, b = (m["topic_terms"].orderBy("topic", "term").collect() for m in made)
    assert a == b and {r["term"] for r in a} == {"cache", "lock", "page"}
    measured = made[0]["perplexity"].orderBy("iteration").collect()
    assert [r["iteration"] for r in measured] == [1, 2, 3] and measured[2]["log_perplexity"] > 0
    # a document whose only term is used once stays, with equal topics
    assert made[0]["points"].count() == 91
    assert made[0]["points"].filter("point = 90").first()["v"] == [0.5, 0.5]


def test_no_step_tables_pile_up(spark):
    from pathlib import Path

    from topicloom.scale import shared_folder

    def steps():
        return len(list(Path(shared_folder(spark).removeprefix("file:")).glob("step-*")))

    corpus = spark.createDataFrame([(i, ["lock", "page", f"w{i % 5}"]) for i in range(20)], "corpus_id long, tokens array<string>")
    counts = []
    for iterations in (2, 6):
        before = steps()
        lda.train(corpus, 2, iterations)
        counts.append(steps() - before)
    assert counts[0] == counts[1]


def test_topics_on_tables(spark):
    groups = [["lock", "page", "cache"], ["socket", "timer", "route"]]
    rows = [(i, groups[i % 2] * (1 + i % 3)) for i in range(20)]
    corpus = spark.createDataFrame(rows, "corpus_id long, tokens array<string>")
    made = PL.train_topics(corpus, topics=2, iterations=12, doc_smoothing=0.2)
    for name, key in (("topic_terms", "topic"), ("doc_topics", "corpus_id")):
        total = made[name].groupBy(key).agg(F.sum("p").alias("s")).collect()
        assert total and all(r["s"] == pytest.approx(1.0) for r in total)
    # words that never meet end in different topics
    best = {r["term"]: r["topic"] for r in made["topic_terms"].groupBy("term").agg(F.max_by("topic", "p").alias("topic")).collect()}
    assert len({best[w] for w in groups[0]}) == 1 and len({best[w] for w in groups[1]}) == 1
    assert best["lock"] != best["socket"]


def test_cells_of_topic_training_are_filled():
    # 500 000 documents and 2 000 000 terms with 6 topics were 62 x 245 cells, each a task in every step
    doc_blocks, term_blocks = lda.cells_for(6, 500_000, 2_000_000, 100_000_000, 12)
    assert doc_blocks * term_blocks <= 100
    for topics in (6, 300):
        docs, terms = lda.cells_for(topics, 500_000, 2_000_000, 100_000_000, 12)
        assert max(500_000 / docs, 2_000_000 / terms) * 8 * topics <= lda.CELL_BYTES
        assert 100_000_000 / (docs * terms) <= lda.CELL_WORDS
