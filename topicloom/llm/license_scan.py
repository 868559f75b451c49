"""License scans by ordered signature rules.

Texts become sequences of lower-case words. A rule is a regular expression over the words joined by one space, a
label, a priority and a keyword; it runs only on texts that hold its keyword, and no rule runs on texts
without any keyword. Detections are taken by priority, longer ones first; one that lies inside a taken
detection is suppressed. The four base phrases are looked up by themselves and are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.batches import TO_WORDS, slices
from topicloom.scale import ship_with_tasks

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, pattern of the name over normalised words, pattern of the short identifier, keyword of the name;
# a keyword with | asks for one of several.
LICENSES = [
    ("apache-2.0", r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?", r"apache 2(?: 0)?", "apache"),
    ("apache-1.1", r"apache (?:software )?licen[cs]e (?:version |v )?1 1", r"apache 1 1", "apache"),
    ("gpl-3.0", r"gnu general public licen[cs]e (?:version |v)?3(?: 0)?", r"gpl ?v?3(?: 0)?", "gnu"),
    ("gpl-2.0", r"gnu general public licen[cs]e (?:version |v)?2(?: 0)?", r"gpl ?v?2(?: 0)?", "gnu"),
    ("gpl-1.0", r"gnu general public licen[cs]e (?:version |v)?1(?: 0)?", r"gpl ?v?1(?: 0)?", "gnu"),
    ("lgpl-3.0", r"gnu lesser general public licen[cs]e (?:version |v)?3(?: 0)?", r"lgpl ?v?3(?: 0)?", "lesser"),
    ("lgpl-2.1", r"gnu lesser general public licen[cs]e (?:version |v)?2 1", r"lgpl ?v?2 1", "lesser"),
    ("lgpl-2.0", r"gnu library general public licen[cs]e (?:version |v)?2(?: 0)?", r"lgpl ?v?2 0", "library"),
    ("agpl-3.0", r"gnu affero general public licen[cs]e (?:version |v)?3(?: 0)?", r"agpl ?v?3(?: 0)?", "affero"),
    ("gfdl-1.3", r"gnu free documentation licen[cs]e (?:version |v)?1 3", r"gfdl 1 3", "documentation"),
    ("gfdl-1.2", r"gnu free documentation licen[cs]e (?:version |v)?1 2", r"gfdl 1 2", "documentation"),
    ("mit", r"(?:the )?mit licen[cs]e", r"mit", "mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", r"mit 0", "attribution"),
    ("bsd-2-clause", r"(?:bsd 2 clause|simplified bsd|freebsd) licen[cs]e", r"bsd 2 clause", "bsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd) licen[cs]e", r"bsd 3 clause", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|original bsd) licen[cs]e", r"bsd 4 clause", "bsd"),
    ("isc", r"isc licen[cs]e", r"isc", "isc"),
    ("zlib", r"zlib licen[cs]e", r"zlib", "zlib"),
    ("mpl-2.0", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?", r"mpl 2 0", "mozilla"),
    ("mpl-1.1", r"mozilla public licen[cs]e (?:version |v )?1 1", r"mpl 1 1", "mozilla"),
    ("epl-2.0", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?", r"epl 2 0", "eclipse"),
    ("epl-1.0", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?", r"epl 1 0", "eclipse"),
    ("cddl-1.0", r"common development and distribution licen[cs]e(?: version)?(?: 1 0)?", r"cddl 1 0", "distribution"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version)? 1 2", r"eupl 1 2", "european"),
    ("artistic-2.0", r"artistic licen[cs]e(?: version)? 2(?: 0)?", r"artistic 2 0", "artistic"),
    ("unlicense", r"(?:the )?unlicen[cs]e", r"unlicense", "unlicen"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", r"wtfpl", "want"),
    ("bsl-1.0", r"boost software licen[cs]e(?: version)?(?: 1 0)?", r"bsl 1 0", "boost"),
    ("ofl-1.1", r"sil open font licen[cs]e(?: version)?(?: 1 1)?", r"ofl 1 1", "font"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[cs]e", r"odbl(?: 1 0)?", "database"),
    ("odc-by-1.0", r"open data commons attribution licen[cs]e", r"odc by(?: 1 0)?", "commons"),
    ("psf-2.0", r"python software foundation licen[cs]e", r"psf 2 0", "python"),
    ("openssl", r"openssl licen[cs]e", r"openssl", "openssl"),
    ("postgresql", r"postgresql licen[cs]e", r"postgresql", "postgresql"),
    ("cc0-1.0", r"(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", r"cc0 1 0", "creative commons|cc0"),
    ("cc-by-nc-nd-4.0", r"(?:creative commons attribution noncommercial noderivatives|cc by nc nd)(?: 4 0)", r"cc by nc nd 4 0", "creative commons|cc by"),
    ("cc-by-nc-sa-4.0", r"(?:creative commons attribution noncommercial sharealike|cc by nc sa)(?: 4 0)", r"cc by nc sa 4 0", "creative commons|cc by"),
    ("cc-by-nc-4.0", r"(?:creative commons attribution noncommercial|cc by nc)(?: 4 0)", r"cc by nc 4 0", "creative commons|cc by"),
    ("cc-by-nd-4.0", r"(?:creative commons attribution noderivatives|cc by nd)(?: 4 0)", r"cc by nd 4 0", "creative commons|cc by"),
    ("cc-by-sa-4.0", r"(?:creative commons attribution sharealike|cc by sa)(?: 4 0)", r"cc by sa 4 0", "creative commons|cc by"),
    ("cc-by-sa-3.0", r"(?:creative commons attribution sharealike|cc by sa)(?: 3 0)", r"cc by sa 3 0", "creative commons|cc by"),
    ("cc-by-4.0", r"(?:creative commons attribution|cc by)(?: 4 0)", r"cc by 4 0", "creative commons|cc by"),
    ("cc-by-3.0", r"(?:creative commons attribution|cc by)(?: 3 0)", r"cc by 3 0", "creative commons|cc by"),
]

# Patterns around a name or an identifier, their priority and weight, and a keyword of their own.
FORMS = [
    (r"spdx licen[cs]e identifier {id}(?: only| or later)?", 100, 1.0, "spdx"),
    (r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}(?: or (?:any )?later(?: version)?)?", 90, 0.95, "under"),
    (r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?{id}(?: licen[cs]e)?", 80, 0.9, "under"),
    (r"{name}", 70, 0.8, ""),
    (r"licen[cs]e (?:is )?{id}", 60, 0.7, "licen"),
    (r"{id} licen[cs]ed?", 50, 0.6, "licen"),
]

# Notices that name no license; label, pattern, priority, weight, keyword.
NOTICES = [
    ("all-rights-reserved", r"all rights reserved", 40, 0.5, "reserved"),
    ("copyright", r"copyright (?:c |© )?(?:19|20)\d\d", 35, 0.4, "copyright"),
    ("public-domain", r"(?:dedicated to|released into|in) the public domain", 45, 0.6, "domain"),
    ("no-warranty", r"without warrant(?:y|ies) (?:of any kind|or conditions)", 30, 0.3, "warrant"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 45, 0.6, "proprietary"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    weight: float
    keywords: tuple[str, ...]  # all of them must be in the text; of one with | an alternative


def holds(line: str, keyword: str) -> bool:
    return any(k in line for k in keyword.split("|"))


def default_rules() -> list[Rule]:
    """Every form of every license, and the notices, in the order in which they are tried."""
    rules = [
        Rule(label, form.format(name=name, id=short), priority, weight, tuple(k for k in (own, key if "{name}" in form else short.split()[0].split("(")[0].rstrip("?v ")) if k))
        for form, priority, weight, own in FORMS
        for label, name, short, key in LICENSES
    ]
    rules += [Rule(label, pattern, priority, weight, (key,)) for label, pattern, priority, weight, key in NOTICES]
    return sorted(rules, key=lambda r: -r.priority)


# A text with none of these can meet no rule and no base phrase.
ANY_KEYWORD = (b"licen", b"spdx", b"under ", b"cc ", b"cc0", b"reserved", b"copyright", b"domain", b"warrant",
               b"proprietary", b"attribution", b"creative")


def phrase_places(joined: bytes, phrase: str) -> list[int]:
    """Word numbers at which the words of a phrase stand; ``joined`` is space-joined with a space at both ends."""
    mark, places, at, word, seen = f" {phrase} ".encode(), [], 0, 0, 0
    while (at := joined.find(mark, at)) >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        places.append(word)
        at += 1
    return places


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Keep detections (priority, start, end, label, weight) that lie inside no detection taken before them."""
    taken: list[tuple[int, int, int, str, float]] = []
    for one in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if not any(t[1] <= one[1] and one[2] <= t[2] for t in taken):
            taken.append(one)
    return taken


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = [(re.compile(rf"(?<= )(?:{r.pattern})(?= )"), r) for r in rules]
        self.keywords = sorted({k for r in rules for k in r.keywords})

    def scan(self, text: str | None) -> tuple:
        spaced = (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS)
        words = spaced.split()
        if not any(k in spaced for k in ANY_KEYWORD):
            return len(words), 0, None, None, "", "", 0.0, []
        joined = b" " + b" ".join(words) + b" "
        base = {label: phrase_places(joined, phrase) for phrase, label in BASE_PHRASES.items()}
        places = [p for ps in base.values() for p in ps]
        line, found = joined.decode("utf-8", "replace"), []
        present = {k for k in self.keywords if holds(line, k)}
        for pattern, rule in self.rules:
            if present.issuperset(rule.keywords):
                found += [(rule.priority, m.start(), m.end(), rule.label, rule.weight) for m in pattern.finditer(line)]
        taken = suppress(found)
        base_labels = sorted(label for label, ps in base.items() if ps)
        missed = 1.0
        for *_, weight in taken:
            missed *= 1.0 - weight
        score = max(1.0 - missed, 0.8 if places else 0.0)
        spans = sorted((label, line.count(" ", 0, a) - 1, line.count(" ", 0, b) - 1) for _, a, b, label, _ in taken)
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base_labels),
            ",".join(sorted({*base_labels, *(d[3] for d in taken)})), score, spans,
        )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label string, first_word long, last_word long>>"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
     ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("detections", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])))]
)


def scan_licenses(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: words, base phrases, labels after suppression, a score and the detections kept.

    Null texts are empty. Word numbers count from 0, ends included. Rows are independent: repeated ids give
    repeated rows, other columns are ignored, an empty table gives no rows.
    """
    chosen = default_rules() if rules is None else rules

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(i, *scanner.scan(t)) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                keys = ("label", "first_word", "last_word")
                rows = [(*r[:-1], [dict(zip(keys, d, strict=True)) for d in r[-1]]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)


ship_with_tasks(__name__)
