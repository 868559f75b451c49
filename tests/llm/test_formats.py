"""Chat format, license scans, page text: round trips and brute force."""

import hashlib
import random
import re

import numpy as np
from topicloom.llm import chat_format as C
from topicloom.llm import html_text as H
from topicloom.llm import license_scan as L
from topicloom.llm.queries import HOSTILE

PARTS = ["\\", "###", " ", "</turn>", "\n", ": ", "a", "ok", "<", "#", ":", "</turn>\n", "### user: ", "é"]


def test_any_turn_reads_back():
    r = random.Random(1)
    for _ in range(3000):
        role = "".join(r.choice(PARTS) for _ in range(r.randint(0, 4)))
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 8)))
        assert C.parse(C.render_turn(role, text)) == [(role, text)]


def test_plain_turns_are_not_escaped():
    assert C.render_turn("user", "hello # 1 < 2") == "### user: hello # 1 < 2</turn>\n"
    assert C.parse(C.render_turn("user", HOSTILE) + C.render_turn("assistant", "")) == [("user", HOSTILE), ("assistant", "")]


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 0, "user", "one"), (2, 0, None, None), (None, 0, "assistant", HOSTILE),
        (3, 0, "assistant", "x" * 200_000), (3, None, "user", "first"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in C.conversation_digests(C.format_turns(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        one = got[conv]
        assert one.n_turns == len(own) and one.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert one.loss_chars == len(loss) and one.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert one.formatted_chars == sum(len(C.render_turn(r[2] or "", r[3] or "")) for r in own)
    assert C.conversation_digests(C.format_turns(df.limit(0))).collect() == []


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_licenses(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [
        (i, label)
        for phrase, label in L.BASE_PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. cc-by cc by by", None, "", "MIT",
        "Released under the MIT License. mit license", "SPDX-License-Identifier: GPL-3.0-only", "mit Ümit license mité license",
        "This work is licensed under the GNU General Public License, version 3.", "word " * 50_000 + "Apache license", "der mit dem",
    ]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x")], "doc_id long, text string, score int, labels string")
    rows = L.scan_licenses(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted([0, *range(len(texts))])
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[0] == "apache,apache-2.0" and labels[1].startswith("cc-by,cc-by-nc-4.0")
    assert labels[5] == "mit" and labels[6] == "gpl-3.0" and labels[8] == "gpl,gpl-3.0" and labels[10] == ""


def shortest_and_longest(pattern):
    """Texts of every alternative of a pattern, without and with all its optional parts."""
    import itertools
    import re._parser as parser

    def texts(parts, whole):
        return ["".join(x) for x in itertools.product(*(of(p, whole) for p in parts))]

    def of(part, whole):
        kind, value = part
        name = str(kind)
        if name == "LITERAL":
            return [chr(value)]
        if name == "IN":
            first = value[0]
            return ["1"] if str(first[0]) == "CATEGORY" else [chr(first[1])]
        if name == "BRANCH":
            return [t for option in value[1] for t in texts(option, whole)]
        if name == "SUBPATTERN":
            return texts(value[-1], whole)
        assert name == "MAX_REPEAT", name
        return texts(value[2], whole) if whole or value[0] else [""]

    tree = list(parser.parse(pattern))
    return {t for whole in (False, True) for t in texts(tree, whole)}


def test_every_rule_passes_its_own_gates():
    rules = L.default_rules()
    for rule in rules:
        for text in shortest_and_longest(rule.pattern):
            assert re.fullmatch(rule.pattern, text)
            assert all(L.holds(f" {text} ", k) for k in rule.keywords) and any(k in f"{text} ".encode() for k in L.ANY_KEYWORD), (rule, text)
    scanner = L.Scanner(rules)
    assert "cc-by-sa-4.0" in scanner.scan("licensed under the Creative Commons Attribution ShareAlike 4.0 International License")[5]
    assert scanner.scan("Creative Commons Zero 1.0 Universal")[5] == "cc0-1.0"


def test_contained_detections_go():
    found = [(70, 5, 20, "a", 0.8), (90, 0, 20, "b", 0.9), (70, 15, 30, "c", 0.8), (70, 5, 20, "a", 0.8)]
    assert [d[3] for d in L.suppress(found)] == ["b", "c"]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_places_are_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(500):
        a, b = ([r.randrange(5) for _ in range(r.randrange(9))] for _ in range(2))
        places = H.common_places(np.array(a, np.int64), np.array(b, np.int64))
        rest = iter(b)
        assert len(places) == lcs(a, b) and all(any(x == y for y in rest) for x in (a[i] for i in places))


def test_lines_and_zones():
    page = (
        '<html><head><title>no</title></head><header>Top</header><div class="cookie-notice">We use</div><main><h1>T &amp; x</h1>'
        '<p>a\n b<p>c <script>if(a<b){"</p>"}</script>d</p><div>teaser</div><section id="comments"><p>nice</p></section>'
        '<form><input value=">">go</form></main><div>after</div><footer>f'
    )
    text = H.main_text(H.lines_of(page), None)
    assert text == "T & x\na b\nc d\nteaser"
    assert H.main_text(H.lines_of(page), H._hashes([("teaser", 0), ("a b", 0)])) == "T & x\na b\nc d"
    for odd in ("", "<", "<p", "x<!-- y", "</div></p>", "<a \"" * 100, "&#0;&#x110000;"):
        H.lines_of(odd)


def test_pages_without_article_lose_what_neighbours_share(spark):
    def page(body):
        return f"<body><div>Home</div><div>News</div>{body}<div>Imprint</div></body>"

    rows = [
        (1, "http://a.org/x/1", page("<div>one</div>")), (2, "http://a.org/x/2?q", page("<div>two</div>")),
        (2, "http://a.org/x/2?q", page("<div>two</div>")), (3, "http://b.org/x/1", page("<div>alone</div>")), (4, None, None), (None, "", ""),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, key int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [(0, "", 0), (1, "one", 3), (2, "two", 3), (2, "two", 3), (3, "Home\nNews\nalone\nImprint", 23), (4, "", 0)]
    assert H.extract(df.limit(0)).collect() == []


def test_article_is_kept_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (re.sub(r"\s+", " ", H.entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
