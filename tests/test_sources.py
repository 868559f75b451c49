"""Readers on hand-written files."""

import json

from topicloom.operators import crosstab as X
from topicloom.sources import bug_records as B
from topicloom.sources import tables as ST
from topicloom.sources import text_files as TF


def test_separated(spark, tmp_path):
    (tmp_path / "a.txt").write_text("--\n1\n--\n hello\n\nworld \n--\n2\n--\n--\n3\n--\nlost\n")
    got = {r["doc_id"]: r["text"] for r in TF.read_separated(spark, str(tmp_path), "--").collect()}
    assert got == {"1": "hello\n\nworld", "2": ""}


def test_rules(spark, tmp_path):
    (tmp_path / "r.txt").write_text('"a","x+"\n#"b","y"\nbroken\n"a","z"\n  # note\n"c","q,""w"\n')
    got = {r["name"]: r["regex"] for r in TF.read_rules(spark, str(tmp_path)).collect()}
    assert got["a"] == "z" and "b" not in got and len(got) == 2


def test_tags_ids_fields(spark, tmp_path):
    (tmp_path / "t.csv").write_text("d1,x,y,x\n\nd2,z\n")
    got = {(r["row"], r["col"]) for r in TF.read_doc_tags(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("d1", "x"), ("d1", "y"), ("d2", "z")}
    (tmp_path / "i.txt").write_text("5\n7\n5\n")
    assert {r["doc"] for r in TF.read_id_group(spark, str(tmp_path / "i.txt")).collect()} == {5, 7}
    (tmp_path / "f.txt").write_text("a  b\n # c\nd\n")
    assert [r["fields"] for r in TF.read_delimited(spark, str(tmp_path / "f.txt"), " +").collect()] == [["a", "b"], ["d"]]


def test_bug_records(spark, tmp_path):
    fix = {"when": "run:x", "fix": ["drivers/net/e1000/m.c:3", "fs/a.c"], "if": "", "errors": ["crash:oops", "leak"]}
    other = {"when": "boot", "fix": "mm/slab.c", "if": ["race:a"], "errors": "hang"}
    bugs = {
        "s1": {"type": fix},
        "s2": {"type": [fix, other]},
        "s3": {"type": "clean:x"},
        "s4": {"type": {}},
        "s5": {"type": {"when": "build:ld"}},
    }
    (tmp_path / "bugs").mkdir()
    (tmp_path / "bugs" / "group1.json").write_text(json.dumps(bugs, indent=1))
    (tmp_path / "bugs" / "note.txt").write_text("no record")
    (tmp_path / "tax.json").write_text(json.dumps({"hard state": {"memory": ["leak", "crash"]}}))
    taxonomy = B.read_taxonomy(spark, str(tmp_path / "tax.json"))
    records = B.to_records(B.fixes(B.read_bug_files(spark, str(tmp_path / "bugs"))), taxonomy)
    keys = {r["key"]: r["objective"] for r in records.keys.collect()}
    assert keys == {k: "group1" for k in ("s1", "s2-F0", "s2-F1", "s3", "s5")}
    labels = {}
    for r in records.labels.collect():
        labels.setdefault(r["key"], set()).add(r["var"])
    assert labels["s3"] == {"fixclass:clean"} and labels["s5"] == {"fixclass:build"}
    assert labels["s1"] == {
        "fixclass:bug", "failuresite:run", "fixedloc:drivers", "fixedsubloc-drivers:net", "fixedsubsubloc-drivers-net:e1000",
        "fixedloc:fs", "fixedsubloc-fs:.", "trigger:None", "error:crash", "crash:oops", "error:leak",
        "errorclass:hard state", "errorsubclass-hard state:memory", "errorsubsubclass-hard state-memory:crash",
        "errorsubsubclass-hard state-memory:leak",
    }
    assert labels["s2-F1"] >= {"trigger:race", "error:hang", "fixedloc:mm"}
    assert {r["error"]: r["n"] for r in B.unclassified(records.labels, taxonomy).collect()} == {"hang": 1}
    # a record whose labels are all filtered out stays as a row of zeros
    crash = X.binary_wide(X.with_prefix(records, "crash:")).lines.collect()
    assert sorted((r["key"], r["line"]) for r in crash) == [("s1", "1"), ("s2-F0", "1"), ("s2-F1", "0"), ("s3", "0"), ("s5", "0")]


def test_an_id_in_two_files_is_one_record(spark, tmp_path):
    fix = {"when": "run", "fix": "fs/a.c", "if": "", "errors": "leak"}
    (tmp_path / "a.json").write_text(json.dumps({"s1": {"type": fix}, "s2": {"type": "clean"}}))
    (tmp_path / "b.json").write_text(json.dumps({"s1": {"type": "doc:x"}}))
    taxonomy = spark.createDataFrame([], "error string, class string, subclass string")
    records = B.to_records(B.fixes(B.read_bug_files(spark, str(tmp_path))), taxonomy)
    assert {tuple(r) for r in records.keys.collect()} == {("s1", "b"), ("s2", "a")}
    assert {tuple(r) for r in X.contingency(records).collect()} == {("b", "fixclass:doc", 1), ("a", "fixclass:clean", 1)}


def test_malformed_fixes_are_listed(spark, tmp_path):
    whole = {"when": "run", "fix": "fs/a.c", "if": "", "errors": "leak"}
    bugs = {"ok": {"type": whole}, "build": {"type": {"when": "build:x"}}, "class": {"type": "clean"}}
    bugs |= {"no-if": {"type": {k: v for k, v in whole.items() if k != "if"}}, "none": {"type": [whole, {"note": 1}]}}
    (tmp_path / "a.json").write_text(json.dumps(bugs))
    got = B.malformed(B.fixes(B.read_bug_files(spark, str(tmp_path))))
    assert {(r["key"], tuple(r["missing"])) for r in got.collect()} == {("no-if", ("if",)), ("none-F1", ("when", "fix", "if", "errors"))}


def test_wide_tables(spark, tmp_path):
    keys = spark.createDataFrame([("k1", "o"), ("k2", 'o,"x'), ("k3", "p")], "key string, objective string")
    labels = spark.createDataFrame([("k1", f"v{i:05d}") for i in range(12_000)] + [("k2", "v00003"), ("k2", "v11999")], "key string, var string")
    records = X.Records(keys, labels)
    ST.write_crosstab(records, str(tmp_path / "x"))
    back = ST.read_crosstab(spark, str(tmp_path / "x"))
    assert {tuple(r) for r in back.keys.collect()} == {tuple(r) for r in keys.collect()}
    assert {tuple(r) for r in back.labels.collect()} == {tuple(r) for r in labels.collect()}
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "x" / "binary" / "rows")).collect())
    assert {line.count(",") for line in lines if line.startswith(("k1", "k3"))} == {12_001}
    assert lines[0] == "k1,o" + ",1" * 12_000 and lines[2] == "k3,p" + ",0" * 12_000
    counts = X.contingency_wide(records)
    first = {r["objective"]: r["line"].split(",")[:3] for r in counts.lines.collect()}
    assert first == {"o": ["1", "1", "1"], 'o,"x': ["1", "1", "0"], "p": ["0", "0", "0"]}
    # nothing of the plan grows with the columns
    assert len(counts.lines._jdf.queryExecution().optimizedPlan().toString()) < 6_000


def test_wide_tables_without_cells(spark, tmp_path):
    keys = spark.createDataFrame([("k1", "o")], "key string, objective string")
    none = X.Records(keys, spark.createDataFrame([], "key string, var string"))
    ST.write_crosstab(none, str(tmp_path / "x"))
    back = ST.read_crosstab(spark, str(tmp_path / "x"))
    assert [tuple(r) for r in back.keys.collect()] == [("k1", "o")] and back.labels.count() == 0


def test_wide_matrix(spark, tmp_path):
    matrix = spark.createDataFrame([(f"r{i % 2}", f"c{i}", float(i)) for i in range(7)], "row string, col string, value double")
    ST.write_matrix_wide(matrix, str(tmp_path / "m"))
    back = ST.read_wide(spark, str(tmp_path / "m"), ["row"])
    assert [r["name"] for r in back.columns.orderBy("at").collect()] == [f"c{i}" for i in range(7)]
    lines = {r["row"]: [float(c) for c in r["line"].split(",")] for r in back.lines.collect()}
    assert lines == {f"r{k}": [float(i) if i % 2 == k else 0.0 for i in range(7)] for k in (0, 1)}


def test_dendrogram_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "#id,size\n0,1,0.0,2,-1,-1,T1-a,0.7,0\n1,1,0.0,2,-1,-1,1\n2,2,0.5,-1,0,1,T1-a,0.4,T2-b,0.1,0,1\n"
    )
    nodes, centroids = ST.read_dendrogram_csv(spark, str(tmp_path / "c.csv"))
    assert {r["cluster_id"]: (r["parent_id"], r["left_id"]) for r in nodes.collect()} == {0: (2, None), 1: (2, None), 2: (None, 0)}
    assert {(r["cluster_id"], r["topic"], r["p"]) for r in centroids.collect()} == {
        (0, "T1-a", 0.7), (2, "T1-a", 0.4), (2, "T2-b", 0.1),
    }


def test_point_reports(spark, tmp_path):
    rows = spark.createDataFrame([(5, "a"), (20_001, "b")], "point long, subject string")
    path = str(tmp_path / "reports")
    ST.write_point_reports(rows, path)
    schema = "point long, subject string, bucket long"
    got = ST.read_point_reports(spark, path, schema, [20_001]).collect()
    assert [(r["point"], r["bucket"]) for r in got] == [(20_001, 2)]
