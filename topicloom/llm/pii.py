"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Three labelers vote on each: the strict form of its kind (regex), word lists (gazetteer) and
the words before it (context); each says yes, no or nothing. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, kind by kind, without labels. Its posteriors then train a
naive Bayes classifier over votes, length and neighbouring characters, which decides on every proposed span.
Base spans that pass their checks are always kept; the classifier adds spans of the other kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.scale import checkpoint

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "iban", "hidden", "name")
KINDS = BASE + EXTRA

# First names for the gazetteer labeler and the name pattern.
FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph "
    "Jessica Thomas Sarah Charles Karen Anna Peter Hans Klaus Ursula Wolfgang Jean Marie Pierre Claire Luc "
    "Carlos Lucia Javier Carmen Miguel Sofia"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Sr Sra".split()
# Top-level domains that the gazetteer knows.
DOMAINS = "com org net edu gov int io co info biz eu de fr es it uk nl ch at be pl us ca br mx ar au jp cn in ru".split()
# Words before a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|escri|écri|schreib|from:|to:",
    "ip": "ip|host|server|address|addr|client|login",
    "card": "card|visa|master|credit|carte|karte|tarjeta|pay",
    "phone": "tel|phone|call|fax|mobile|mobil|handy|whatsapp",
    "secret": "key|token|secret|pass|auth|cred|login",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "hidden": "mail|contact|write|escri|écri|schreib",
    "name": "dear|name|contact|by|from|von|par|de|signed|regards",
}
AGAINST = "version|release|chapter|section|figure|isbn|issn|article|§"

# A run of characters is entered at its first one only, and repetitions give nothing back: the matches are those of
# the plain patterns, but a long run costs one pass instead of one per character.
_LOCAL = "[A-Za-z0-9._%+-]"
# A capitalised word of any alphabet with its hyphens and apostrophes, but without a genitive.
_SURNAME = r"\p{Lu}(?=['’]?\p{L})[\p{L}\p{M}]*+(?:['’-](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits with at least 14 of them: shorter ones fail their check anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|(?i:password|passwd|secret|api_?key|token)[=:][^\s\x00-\x20]{6,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "hidden": r"(?<![A-Za-z0-9])[A-Za-z0-9._+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "name": rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?|(?:{'|'.join(FIRST_NAMES)}))\x20{_SURNAME}",
}
GATES = {
    "email": "contains(text, '@')",
    "ip": "text rlike '[0-9][.][0-9]'",
    "card": "text rlike '[0-9](?:[ -]?[0-9]){13}'",
    "phone": "contains(text, '+')",
    "secret": "contains(text, '=') or contains(text, ':') or contains(text, 'AKIA')",
    "iban": "text rlike '[A-Z]{2}[0-9]{2}'",
    "hidden": "contains(text, '(at)') or contains(text, '[at]')",
    "name": f"text rlike '(?<![A-Za-z])(?=[A-Z])(?:{'|'.join(TITLES + FIRST_NAMES)})[. ]'",
}
CONTEXT_CHARS = 24
ROUNDS = 50


def row_key() -> Column:
    """Equal for equal rows; id and text are hashed together."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _proposed(kind: str) -> Column:
    """Per span of one kind the piece of text before it; behind the last span one more piece, with a null span."""
    cut = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
    both = F.zip_with(
        cut,
        F.split(F.col("text"), PATTERNS[kind], -1),
        lambda span, piece: F.struct(
            span.alias("span"), F.length(piece).alias("gap"), F.right(piece, F.lit(CONTEXT_CHARS)).alias("before"), F.left(piece, F.lit(1)).alias("first")
        ),
    )
    placed = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["span"].alias("span"), x["gap"].alias("gap"), x["before"].alias("before"), x["first"].alias("first")))
    return F.when(F.expr(GATES[kind]) & F.col("text").rlike(PATTERNS[kind]), placed).otherwise(F.array().cast(_PROPOSED))


_PROPOSED = "array<struct<kind:string,i:int,span:string,gap:int,before:string,first:string>>"


def candidates(documents: DataFrame) -> DataFrame:
    """``key, kind, i, span, start, end, before, after``: what the patterns propose, places in code points.

    ``documents`` has ``doc_id, text``. A pattern splits a text; the lengths of pieces and spans add up to the places.
    """
    keyed = documents.select(row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = keyed.select("key", F.inline(F.concat(*(_proposed(kind) for kind in KINDS))))
    found = found.groupBy("key", "kind", "i").agg(*(F.first(c).alias(c) for c in ("span", "gap", "before", "first")))
    order = Window.partitionBy("key", "kind").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("span"), F.lit(0))).over(upto).cast("long")
    return (
        found.withColumns({"end": end, "after": F.lead("first").over(order)})
        .where("span is not null")  # behind the last span there is one more piece
        .select("key", "kind", "i", "span", (F.col("end") - F.length("span")).alias("start"), "end", "before", F.coalesce("after", F.lit("")).alias("after"))
    )


def _digits() -> Column:
    return F.regexp_replace("span", "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes() -> Column:
    """The check of the base kinds; null for the others."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    n = F.length(_digits())
    kind = F.col("kind")
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.col("span").rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(n.between(14, 19), luhn(_digits())).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
    )


def votes() -> dict[str, Column]:
    """1 yes, 0 no, 2 nothing."""
    kind, span = F.col("kind"), F.col("span")
    form = (
        F.when(kind.isin(*BASE), passes())
        .when(kind == "secret", span.rlike("^AKIA|[0-9]"))
        .when(kind == "iban", F.length(F.regexp_replace("span", " ", "")).between(15, 34) & (F.length(_digits()) >= 8))
        .when(kind == "hidden", span.rlike("[A-Za-z]{2,}$"))
        .when(kind == "name", span.rlike(r" \p{Lu}['’\p{L}\p{M}-]*\p{Ll}[\p{L}\p{M}]$"))
    )
    tail = F.lower(F.regexp_extract("span", "([A-Za-z]+)$", 1))
    word_list = (
        F.when(kind.isin("email", "hidden"), tail.isin(*DOMAINS))
        .when(kind == "ip", ~span.rlike(r"^(?:0|127|255)\.|\.(?:0|255)$"))
        .when(kind == "card", span.rlike("^[3-6]"))
        .when(kind == "phone", span.rlike(r"^\+(?:1|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"))
        .when(kind == "secret", span.rlike("(?i)^AKIA|^pass|^secret|key|token"))
        .when(kind == "iban", span.rlike("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"))
        .when(kind == "name", span.rlike(f"^(?:{'|'.join(FIRST_NAMES)}) "))
    )
    before = F.lower("before")
    near = F.lit(None).cast("boolean")
    for k, words in CONTEXT.items():
        near = F.when((kind == k) & before.rlike(words), True).otherwise(near)
    near = F.when(before.rlike(AGAINST), False).otherwise(near)
    as_vote = lambda c: F.when(c.isNull(), 2).when(c, 1).otherwise(0)
    return {"form": as_vote(form), "word_list": as_vote(word_list), "near": as_vote(near)}


LABELERS = ("form", "word_list", "near")


def fit_labelers(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of "personal data" for each vote pattern, by expectation-maximisation over their counts.

    The labelers are independent given the truth. They start as better than chance, so that yes means yes. There are
    3 ** labelers patterns at most.
    """
    yes = [{0: 0.15, 1: 0.55, 2: 0.3} for _ in LABELERS]
    no = [{0: 0.55, 1: 0.15, 2: 0.3} for _ in LABELERS]
    prior, total = 0.5, sum(n for _, n in patterns)
    after: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes_, _ in patterns:
            a = prior * math.prod(t[v] for t, v in zip(yes, votes_, strict=True))
            b = (1 - prior) * math.prod(t[v] for t, v in zip(no, votes_, strict=True))
            after[votes_] = a / (a + b)
        right = sum(n * after[v] for v, n in patterns)
        prior = (right + 1) / (total + 2)
        for k in range(len(LABELERS)):
            for value in (0, 1, 2):
                # pseudocounts keep the tables near their start while a kind is rare
                a = sum(n * after[v] for v, n in patterns if v[k] == value)
                b = sum(n * (1 - after[v]) for v, n in patterns if v[k] == value)
                yes[k][value] = (a + 10 * (0.15, 0.55, 0.3)[value]) / (right + 10)
                no[k][value] = (b + 10 * (0.55, 0.15, 0.3)[value]) / (total - right + 10)
    return after


def features() -> dict[str, Column]:
    """Few values each, so that the classifier's tables are small."""
    sort = lambda c: F.when(c == "", "edge").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("other")
    return {
        "votes": F.concat_ws("", *LABELERS),
        "length": F.least(F.lit(12), F.floor(F.length("span") / 4)).cast("string"),
        "left": sort(F.right("before", F.lit(1))),
        "right": sort(F.col("after")),
    }


def judged(found: DataFrame) -> DataFrame:
    """Add ``base`` (a base span that passes) and ``chance`` (of personal data) to the candidates."""
    seen = checkpoint(found.withColumn("base", F.coalesce(passes(), F.lit(False))).withColumns(votes()).withColumns(features()))
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    counted: dict[str, list] = {}
    # at most kinds x 3 ** labelers rows
    for r in seen.groupBy("kind", *LABELERS).count().collect():
        counted.setdefault(r["kind"], []).append((tuple(r[x] for x in LABELERS), float(r["count"])))
    for kind, patterns in counted.items():
        for pattern, chance in fit_labelers(sorted(patterns)).items():
            posterior[kind, pattern] = chance
    if not posterior:
        return seen.withColumn("chance", F.lit(0.0))
    soft = F.create_map(*(F.lit(x) for (kind, pattern), p in sorted(posterior.items()) for x in (kind + "".join(map(str, pattern)), p)))
    taught = seen.withColumn("p", F.element_at(soft, F.concat("kind", "votes")))
    # the classifier: soft counts of each feature value, at most a few hundred rows
    shown = taught.select("kind", "p", F.explode(F.create_map(*(x for name in features() for x in (F.lit(name), F.col(name))))).alias("feature", "value"))
    rows = shown.groupBy("kind", "feature", "value").agg(F.round(F.sum("p"), 6).alias("yes"), F.round(F.sum(1 - F.col("p")), 6).alias("no")).collect()
    prior = {r["kind"]: r for r in taught.groupBy("kind").agg(F.round(F.sum("p"), 6).alias("yes"), F.round(F.sum(1 - F.col("p")), 6).alias("no")).collect()}
    odds = {}
    for r in rows:
        all_of = prior[r["kind"]]
        odds[f"{r['kind']}/{r['feature']}/{r['value']}"] = math.log((r["yes"] + 0.5) / (all_of["yes"] + 1)) - math.log((r["no"] + 0.5) / (all_of["no"] + 1))
    start = F.create_map(*(F.lit(x) for k, r in sorted(prior.items()) for x in (k, math.log((r["yes"] + 0.5) / (r["no"] + 0.5)))))
    table = F.create_map(*(F.lit(x) for k, v in sorted(odds.items()) for x in (k, v)))
    total = F.element_at(start, F.col("kind"))
    for name in features():
        total = total + F.coalesce(F.try_element_at(table, F.concat_ws("/", F.col("kind"), F.lit(name), F.col(name))), F.lit(0.0))
    return seen.withColumn("chance", 1 / (1 + F.exp(-total)))


def spans(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """``key, spans, n_base...``: one row per text with spans; ``spans`` is sorted by start, then kind as in ``KINDS``."""
    found = judged(candidates(documents)).where(F.col("base") | (F.col("kind").isin(*EXTRA) & (F.col("chance") >= least)))
    number = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    one = F.struct(F.col("start"), number.alias("number"), F.col("end"), F.col("kind"), F.col("base"))
    # bounded by the spans of one text
    return found.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def _joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def find(documents: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, a digest of them, and all spans.

    Null texts are empty. Repeated rows are reported each; rows with one id and different texts apart. Other
    columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = checkpoint(spans(texts))
    keys = texts.select("doc_id", row_key().alias("key"))
    out = keys.join(known, "key", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as " + known.schema["spans"].dataType.simpleString() + ")")))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one.

    Columns and rows stay; a text without spans is not touched, a null text stays null.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = checkpoint(spans(texts)).select(F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    state = F.struct(F.lit("").alias("made"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"].cast("int") + 1, F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["made"], gap, mark)).otherwise(acc["made"]).alias("made"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    whole = F.aggregate("_spans", state, step)
    marked = documents.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    out = marked.join(known, "_key", "left").withColumn("_made", F.when(F.col("_spans").isNotNull(), whole))
    rest = F.substring(F.col("text"), F.col("_made.at").cast("int") + 1, F.length("text"))
    return out.withColumn("text", F.when(F.col("_made").isNotNull(), F.concat("_made.made", rest)).otherwise(F.col("text"))).select(*documents.columns)
