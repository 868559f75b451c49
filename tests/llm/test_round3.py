"""Token alignment, whitening and toxicity against brute force, exact sums and held-out rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from topicloom.llm import queries
from topicloom.llm import token_alignment as A
from topicloom.llm import toxicity as X
from topicloom.llm import whitening as W

# Token alignment

TEXTS = [
    (1, "Hello world, this is a plain text."),
    (2, "Grüße aus Köln – naïve café 東京 🙂🙂"),
    (3, ""),
    (4, None),
    (5, "<|endoftext|> and </s> <unk> inside"),
    (6, "a"),
    (7, "  two  spaces\tand\n\nlines "),
    (8, "▁ a piece mark"),
    (8, "word " * 3000),
    (None, "x" * 5000),
    (8, "Hello world, this is a plain text."),
    (9, "\x00 ​ zero ﻿"),
]


@pytest.fixture(scope="module")
def tokenizers():
    return (
        A.Tokenizer.read(queries.vocabulary("byte_bpe_50k.json"), "byte_level"),
        A.Tokenizer.read(queries.vocabulary("piece_bpe_32k.model"), "pieces"),
    )


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    entry = {i: w for w, i in one.get_vocab().items()}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    rows, count = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        parts = [bytes(byte[c] for c in entry[i]) for i in a], [piece(i) for i in b]
        if any(b"".join(p) != (" " + (text or "")).encode() for p in parts):
            a, b, parts = [], [], ([], [])
        ends = [{sum(map(len, p[: k + 1])): k for k in range(len(p))} if len(p) < 200 else None for p in parts]
        if None in ends:
            ends = [dict(zip(np.cumsum([len(x) for x in p]).tolist(), range(len(p)), strict=True)) for p in parts]
        at, links, groups = (-1, -1), [], []
        for e in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, a[at[0] + 1 : x + 1])) + "|" + ",".join(map(str, b[at[1] + 1 : y + 1])))
            links.append((a[x], b[y]))
            at = x, y
        count.update(links)
        rows.append((len(a), len(b), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return [
        (na, nb, len(k), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), sha(s))
        for na, nb, k, s in rows
    ], count


def test_alignment_against_brute_force(spark, tokenizers):
    given = spark.createDataFrame([(*t, "z") for t in TEXTS], "doc_id long, text string, ids_a string").repartition(3)
    got = A.digest_links(given, *tokenizers).collect()
    want, count = brute_alignment([t for _, t in TEXTS])
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *w)) for (i, _), w in zip(TEXTS, want, strict=True))
    assert len(count) <= A.most_pairs(*tokenizers)
    pairs = A.pair_counts(A.align(given, *tokenizers)).collect()
    assert {(r.a, r.b): r.n for r in pairs} == dict(count)
    kept = A.align(given.withColumn("row", given.doc_id), *tokenizers)
    assert kept.columns == ["doc_id", "row", "ids_a", "ids_b", "sizes_a", "sizes_b"]
    assert all(sum(r.sizes_a) == len(r.ids_a) and sum(r.sizes_b) == len(r.ids_b) for r in kept.collect())
    assert A.digest_links(given.limit(0), *tokenizers).collect() == []


def test_alignment_of_a_table(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want, _ = brute_alignment([r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_gallop():
    rng = np.random.default_rng(5)
    for n, m in ((0, 5), (5, 0), (1, 1), (50, 900), (400, 400), (3, 5000)):
        a, b = (np.unique(rng.integers(0, 1200, k)) for k in (n, m))
        at_a, at_b = A.common_ends(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        drift = rng.integers(-10, len(b) + 10, len(a))
        assert b[A.gallop(a, b, drift)[1]].tolist() == a[at_a].tolist()


# Whitening


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 12)) * np.geomspace(1, 0.02, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0, 2.0])]
    again = [(5, x[5].tolist()), (None, x[6].tolist())]
    given = spark.createDataFrame(rows + bad + again, "vec_id long, embedding array<float>").repartition(5)
    got = W.whitened_components(given.selectExpr("*", "'z' row", "'z' whitened")).collect()
    used = np.concatenate([x, x[[5, 6]]])
    whole = np.floor(1024 * used.astype(float)).astype(int) + 100000
    n = len(whole)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, whole.sum(0), strict=True)) for r in whole]
    centred = whole - whole.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    made = centred @ vectors[:, order] / np.sqrt(values[order])
    assert len(got) == n * 8
    by_id = {(r.vec_id, r.component): r for r in got}
    for i in (0, 5, 17, 299):
        for c in range(8):
            r = by_id[i, c + 1]
            assert r.n == n and r.deviation == exact[i] and r.identity_error < 1e-9
            assert abs(r.whitened) == pytest.approx(abs(made[i, c]), abs=1e-8)
            assert r.explained == pytest.approx(values[order[c]] / values.sum(), rel=1e-9)
    assert sum(r.vec_id is None for r in got) == 8 and sum(r.vec_id == 5 for r in got) == 16


def test_whitening_of_few_rows(spark):
    rows = lambda *v: spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    assert W.whitened_components(rows().limit(0)).collect() == []
    assert W.whitened_components(rows([1.0, 2.0])).collect() == []
    assert W.whitened_components(rows([1.0, 2.0], [1.0, 2.0])).collect() == []
    two = W.whitened_components(rows([1.0, 2.0], [3.0, 2.0])).collect()
    assert [(r.component, abs(r.whitened), r.explained) for r in two] == [(1, pytest.approx(1), pytest.approx(1))] * 2


def test_deviation_beyond_doubles():
    x = np.array([[3, 1 << 50], [5, 7]], dtype=np.int64)
    sums = x.sum(0)
    want = [sum((2 * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert W._deviations(x, 2, sums).tolist() == want


@pytest.mark.parametrize("spectrum", [[3.0], [1, 1], [5, 4, 4, 4, 0], np.ones(40), np.geomspace(1e6, 1e-3, 40), [100.0] * 3 + [1.0] * 30, np.linspace(1, 1.001, 60)])
def test_feast_misses_none(spectrum):
    rng = np.random.default_rng(1)
    d = len(spectrum)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * np.array(spectrum, float)) @ q.T
    v = (v + v.T) / 2
    values, vectors = W.leading_eigenpairs(v, 8)
    want = np.sort(np.array(spectrum, float))[::-1][:8]
    want = want[want > 0]
    assert values == pytest.approx(want, rel=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-9 * want[0]
    for shift in (0.5, 1.0005, 3.5, 50):
        assert W.inertia_above(v, shift) == (np.linalg.eigvalsh(v) > shift).sum()


# Toxicity


def invented(count, seed):
    rng = random.Random(seed)
    syllables = ["ba", "ne", "lo", "ti", "ra", "mu", "ke", "so", "vi", "da"]
    rude = ["grumbol", "zackfitz", "worplex", "snargle"]
    docs = []
    for i in range(count):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(rude))
        docs.append((i, " ".join(words), int(toxic)))
    return docs


def test_toxicity(spark, monkeypatch):
    docs = invented(700, 3)
    odd = [(9001, "", None), (9002, None, None), (None, "ba grumbol ne", None), (9003, "ba ne grumboll ti", None), (9004, "BA ZACKFITZ!!", None), (9005, "ba ne lo " * 30_000, None)]
    odd += [(9003, "ba ne grumboll ti", None)]
    given = spark.createDataFrame([(i, t, "z") for i, t, _ in docs + odd], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in docs] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = X.judge(given, labels).collect()
    assert len(rows) == len(docs) + len(odd)
    true = {i: x for i, _, x in docs}
    held = [r for r in rows if r.held_out and r.doc_id in true]
    assert len(held) > 100
    assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].predicted == by_id[9003].predicted == by_id[9004].predicted == 1
    assert by_id[9001].score == by_id[9002].score and by_id[9005].predicted == 0
    assert [r.score for r in rows if r.doc_id == 9003] == [by_id[9003].score] * 2
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in rows)
    # other labels of held-out rows change nothing
    turned = spark.createDataFrame([(i, 1, 1 - x if by_id[i].held_out else x) for i, _, x in docs], labels.schema)
    assert {(r.doc_id, r.score) for r in X.judge(given, turned).collect()} == {(r.doc_id, r.score) for r in rows}
    assert X.judge(given.limit(0), labels).collect() == []
    assert {r.score for r in X.judge(given, labels.limit(0)).collect()} == {0.5}


def test_words_and_grams_by_hand():
    words = X.split(["Ab cd, ab", None, "", "x!", "cd"])
    assert words.starts.tolist() == [0, 3, 3, 3, 4, 5]
    assert words.number[0] == words.number[2] and words.number[1] == words.number[4] and len(words.hashes) == 3
    # <ab>: itself, two of three marks and letters
    assert np.diff(words.gram_starts)[words.number[0]] == 3 and np.diff(words.gram_starts)[words.number[3]] == 1
    alone = X.split_all(["Ab cd, ab", "", "", "x!", "cd"])
    assert alone.number.tolist() == words.number.tolist() and alone.grams.tolist() == words.grams.tolist()


def test_a_written_step_leaves_no_shuffle_files(spark):
    import time

    from topicloom.scale import checkpoint, checkpoint_by

    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
        return {x for x in files if x.startswith("shuffle_")}

    before = left()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    rows = spark.range(1000).selectExpr("id % 7 as k", "id")
    made = checkpoint(rows.groupBy("k").count()), checkpoint_by(rows, "k", 3)
    for _ in range(40):  # files go behind the job
        if not left() - before:
            break
        time.sleep(0.25)
    assert not left() - before
    assert [t.count() for t in made] == [7, 1000] and spark.conf.get(key) == setting
