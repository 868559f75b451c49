"""Fingerprints, near-duplicates, passages and leaks against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from topicloom.llm import decontaminate as D
from topicloom.llm import passages as P
from topicloom.llm import simhash as S
from topicloom.llm import spotsigs as G

SF = "/root/testdata/sf0.001"
VOCABULARY = [f"w{i}" for i in range(3000)]


def some_text(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [some_text(r, r.choice([3, 40, 120, 300])) for _ in range(60)]
    out = {i: t for i, t in enumerate(base)}
    for i in range(20):  # near copies, and passages inside other texts
        words = base[i].split()
        words[r.randrange(len(words))] = "changed"
        out[100 + i] = " ".join(words)
        out[200 + i] = f"{some_text(r, 80)} {' '.join(base[40 + i].split()[:70])} {some_text(r, 80)}"
    out |= {300: base[3], 301: "", 302: None, 303: "  \n", 304: "one", 305: "ONE", 306: "é " * 300, 307: "the " * 30_000, 308: "the " * 30_000}
    return out


@pytest.fixture(scope="module")
def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, fingerprint string, key int")


def classes(count, near):
    parent = list(range(count))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(count):
        for j in range(i):
            if near(i, j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(count)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(frame, texts):
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    lead = classes(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    rows = S.near_duplicates(frame).collect()
    assert len(rows) == len(ids) + 1
    for r in rows:
        k = ids.index(r.doc_id)
        assert r.fp % (1 << 64) == prints[k] and r.component_id == ids[lead[k]]
    kept = S.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted({ids[k] for k in lead})
    assert S.near_duplicates(frame.limit(0)).collect() == []


def test_crowded_segment_values_give_whole_components(spark, monkeypatch):
    r = random.Random(4)
    centre = [r.getrandbits(64) for _ in range(3)]
    prints = sorted({c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for c in centre for _ in range(150)} | {r.getrandbits(64) for _ in range(50)})
    monkeypatch.setattr(S, "FEW", 8)
    monkeypatch.setattr(S, "BLOCK", 16)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    found = S.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    place = {p: i for i, p in enumerate(signed)}
    near = {(place[x.a], place[x.b]) for x in found}
    assert all((prints[i] ^ prints[j]).bit_count() <= 4 for i, j in near)
    assert classes(len(prints), lambda i, j: (i, j) in near or (j, i) in near) == classes(
        len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4
    )


def signature_set(text):
    return set((G.signatures([text]) & 0xFFFFFFFF).tolist())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_of_edited_texts(spark, frame, texts):
    order = sorted(((i, t or "") for i, t in [*texts.items(), (0, texts[0])]), reverse=True)
    rows = G.compare_with_edits(frame).collect()
    got = sorted(((r.doc_id, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint, r.n_chars) for r in rows), reverse=True)
    want = []
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own = signature_set(text)
        want.append((
            doc_id, hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, signature_set(edited)), jaccard(own, signature_set(following)),
            "".join(f"{x:08x}" for x in sorted(own)), len(text),
        ))
    assert got == sorted(want, reverse=True)
    odd = spark.createDataFrame([(None, "a b c d"), (5, None), (None, None)], "doc_id long, text string")
    assert len(G.compare_with_edits(odd).collect()) == 3
    assert G.compare_with_edits(odd.limit(0)).collect() == []


def test_spotsigs_chains():
    assert G.signatures(["the big red dog"], frozenset(["the"]), 2).tolist() == G.signatures(["The, big; RED cat"], frozenset(["the"]), 2).tolist()
    assert len(G.signatures(["the big"], frozenset(["the"]), 2)) == 1 and len(G.signatures(["", None])) == 0


def test_spotsigs_near_duplicates(frame, texts):
    ids = sorted(texts)
    sets = [signature_set(texts[i]) for i in ids]
    lead = classes(len(ids), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    rows = G.near_duplicates(frame.select("doc_id", "text")).collect()
    assert {(r.doc_id, r.class_id) for r in rows} == {(ids[k], ids[lead[k]]) for k in range(len(ids))}


def test_compact_windows_are_the_nodes_of_the_tree():
    r = random.Random(1)
    for _ in range(50):
        made = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 160))) for _ in range(4)]
        tokens, starts = P.tokens_of(made)
        bits = max(1, len(tokens).bit_length())
        for function in range(2):
            got = sorted(zip(*(x.tolist() for x in P.compact_windows(tokens, starts, function)), strict=True))
            value = P.mix(tokens + np.uint64((function + 1) * int(P._BASE) % (1 << 64)))
            want = []
            for text in range(4):
                own = value[starts[text] : starts[text + 1]]
                rank = [(int(x) >> bits, i) for i, x in enumerate(own)]
                for c in range(len(own)):
                    low = high = c
                    while low > 0 and rank[low - 1] > rank[c]:
                        low -= 1
                    while high < len(own) - 1 and rank[high + 1] > rank[c]:
                        high += 1
                    if high - low + 1 >= P.TOKENS:
                        want.append((text, int(own.view(np.int64)[c]), low, c, high))
            assert got == sorted(want)


def exact_repeats(texts):
    """Ids of texts that share a run of PASSAGE_WORDS words with another row."""
    holders = {}
    for i, t in texts:
        words = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
        for k in range(len(words) - P.PASSAGE_WORDS + 1):
            holders.setdefault(tuple(words[k : k + P.PASSAGE_WORDS]), set()).add(i)
    return [h for h in holders.values() if len(h) > 1]


@pytest.mark.parametrize("few", [P.FEW, 1])
def test_passages(frame, texts, few, monkeypatch):
    monkeypatch.setattr(P, "FEW", few)
    rows = P.repeated_passages(frame).collect()
    got = {r.doc_id: r for r in rows}
    shared = exact_repeats(texts.items())
    assert set().union(*shared) - {307, 308} <= set(got)
    assert all(len({got[i].class_id for i in s}) == 1 for s in shared)
    clean = set(range(3, 40)) - set().union(*shared) - {i for i in range(20)}
    assert not clean & set(got)
    assert P.repeated_passages(frame.limit(0)).collect() == []


def test_large_groups_lose_no_text(spark, monkeypatch):
    r = random.Random(11)
    passage, other = some_text(r, 60).split(), some_text(r, 60).split()
    made = []
    for i in range(120):  # each changes a word of its own
        words = list(passage)
        words[i % 60] = f"other{i}"
        made.append(" ".join(words) if i % 2 else f"{some_text(r, 30)} {' '.join(words)} {some_text(r, 30)}")
    made += [f"{some_text(r, 60)} {' '.join(other[:20])} {some_text(r, 60)}" for _ in range(40)]  # too little in common
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = []
    for few, block in ((10_000, 2048), (24, 2048), (1, 16)):
        monkeypatch.setattr(P, "FEW", few)
        monkeypatch.setattr(P, "BLOCK", block)
        found.append({x.doc_id: x.class_id for x in P.repeated_passages(docs).collect()})
    assert set(found[0]) <= set(found[1]) and set(found[0]) <= set(found[2])
    assert set(found[1]) == set(found[2]) and len(found[1]) > 100 and max(found[1]) < 120 and set(found[1].values()) == {min(found[1])}


def test_forest_connects_what_pairs_connect():
    r = random.Random(4)
    rows = []
    for _ in range(6):
        base = np.array([r.getrandbits(60) for _ in range(2 * P.TOKENS - 1)], np.uint64)
        for _ in range(15):
            changed = base.copy()
            for _ in range(r.randrange(0, 9)):
                changed[r.randrange(len(changed))] = r.getrandbits(60)
            rows.append(changed[r.randrange(0, 20) : len(changed) - r.randrange(0, 20)])
    contents = list(range(len(rows)))
    for sides in (np.zeros(len(rows), int), np.arange(len(rows)) % 2):
        one_side = len(set(sides.tolist())) == 1
        links = P.forest(contents, rows, sides)
        near = {(i, j) for i in contents for j in range(i) if (one_side or sides[i] != sides[j]) and P._alike_near(rows[i], rows[j])}
        assert {(j, i) for i, j in links} <= near and len(links) < len(near)
        assert classes(len(rows), lambda i, j: (i, j) in near) == classes(len(rows), lambda i, j: (j, i) in links)


def test_leaks_at_the_largest_distance():
    r = random.Random(3)
    items = [some_text(r, r.randrange(14, 60)) for _ in range(200)]
    made = D.Items(list(range(200)), items)
    missed = 0
    for i, item in enumerate(items):
        words = item.split()
        for k in range(D.edits(len(words))):
            at, kind = r.randrange(len(words)), r.random()
            if kind < 0.34:
                words[at] = f"q{k}"
            elif kind < 0.67:
                del words[at]
            else:
                words.insert(at, f"z{k}")
        text = f"{some_text(r, 100)} {' '.join(words)} {some_text(r, 100)}"
        missed += (0, i) not in {(a, b) for a, b, _ in D.leaks_of(made, pa.array([text]))}
    assert missed <= 2  # recall of at least 0.99


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_best_run_distance():
    r = random.Random(6)
    for _ in range(100):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 7))] for _ in range(2))
        best = min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert D.best_run_distance(np.array(a), np.array(b)) == best


def test_leaks(spark):
    documents, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()))
    items = [(r.item_id, plain(r.text)) for r in benchmark.collect()]
    want = {(r.doc_id, i) for r in documents.collect() for i, t in items if f" {t} " in f" {plain(r.text)} "}
    got = {(r.doc_id, r.item_id) for r in D.leaks(documents, benchmark).collect()}
    assert want and want <= got and all(x in want for x in got)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, items[0][1], 0)], "doc_id long, text string, item_id int")
    assert [(r.doc_id, r.item_id) for r in D.leaks(odd, benchmark.union(spark.createDataFrame([(99, None), (98, ""), (None, "x")], "item_id long, text string"))).collect()] == [(None, items[0][0])]
    assert D.leaks(documents.limit(0), benchmark).collect() == [] == D.leaks(documents, benchmark.limit(0)).collect()
    assert D.without_leaks(odd, benchmark).count() == 2


def test_every_link_of_a_large_group_counts(spark, monkeypatch):
    r = random.Random(23)
    passage, tail = some_text(r, 60).split(), some_text(r, 60).split()
    made = []
    for i in range(60):  # each changes a word of its own
        words = list(passage)
        words[i % 60] = f"other{i}"
        made.append(f"{some_text(r, 10 + i % 7)} {' '.join(words)} {' '.join(tail) if i % 3 == 0 else some_text(r, 30)}")
    made += [made[0], None, ""]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    tokens, starts = P.tokens_of(made[:60])
    near = [tokens[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    want = [sum(bool(len(P._runs(near[i], near[j])) and len(P._runs(near[j], near[i]))) for j in range(60) if j != i) for i in range(60)]
    for few, texts in ((24, 512), (1, 7)):
        monkeypatch.setattr(P, "FEW", few)
        monkeypatch.setattr(P, "CELL_TEXTS", texts, raising=False)
        got = {x.doc_id: x for x in P.repeated_passages(docs).collect()}
        links = [got[i].n_links - (i == 0) for i in range(60)]
        assert max(want) > 20 and all(g <= w for g, w in zip(links, want, strict=True)) and sum(links) >= 0.98 * sum(want)
        assert got[60].n_links == got[0].n_links and got[60].spans == got[0].spans
        # texts with the same end share it from the passage on
        assert all(got[i].spans[-1]["last"] >= 10 + i % 7 + 60 + 50 for i in range(0, 60, 3))


def test_forest_leaves_what_is_joined():
    r = random.Random(5)
    base = np.array([r.getrandbits(60) for _ in range(2 * P.TOKENS - 1)], np.uint64)
    rows, contents = [base] * 6, list(range(6))
    for sides in (np.zeros(6, int), np.arange(6) % 2):
        assert P.forest(contents, rows, sides, np.zeros(6, int)) == []
        assert len(P.forest(contents, rows, sides, np.array([4, 4, 4, 9, 9, 7]))) == 2


def test_pairs_that_go_on_are_those_alike_around_a_spot():
    r = random.Random(9)
    shared = some_text(r, 55)
    made = {1: f"{some_text(r, 90)} {shared} {some_text(r, 400)} {shared}", 2: f"{some_text(r, 20)} {shared}", 3: some_text(r, 300)}
    spots = [[(90, 20), (545, 20)], [(90, 60), (545, 60)], [(10, 5)]]
    pairs, spans = [(1, 2), (1, 3), (2, 3)], (0, 10_000)
    rows = [[{"x": x, "y": y, "f": -1, "la": spans[0], "ha": spans[1], "lb": spans[0], "hb": spans[1]} for x, y in some] for some in spots]
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in P._SPOT]))
    one = lambda side, end: pa.array([made[p[end]] for p in pairs])
    given = [pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), pa.array(rows, kind)]
    near = next(P._near_first(iter([pa.RecordBatch.from_arrays([*given, one("a", 0)], names=["a", "b", "spots", "text_a"])])))
    got = list(P._near_second(iter([pa.RecordBatch.from_arrays([*near.columns, one("b", 1)], names=[*near.schema.names, "text_b"])])))
    assert [(x["a"], x["b"]) for b in got for x in b.to_pylist()] == [(1, 2)]
