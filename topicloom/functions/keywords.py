"""Keyword rules: named patterns looked for in lower-cased text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.scale import spread

# The default rules, name and pattern.
DEFAULT_RULES = [
    ("ref.cve", r"cve-[0-9]+-[0-9]+"),
    ("ref.linux.bugzilla", r"http(s)*://bugzilla\.kernel\.org/show_bug\.cgi\?id=[0-9]+"),
    ("linux.oops.null", r"bug: unable to handle kernel null pointer dereference at"),
    ("linux.oops.pagefault", r"bug: unable to handle kernel paging request at"),
    ("linux.oops.assert", r"kernel bug at"),
    ("linux.oops.generalprotection", r"general protection fault:"),
    ("linux.warn.lockdep", r"info: possible circular locking dependency detected"),
    ("linux.newdev", r"add support for|quirk"),
    ("linux.feature.page", r"page"),
    ("linux.feature.xattr", r"xattr"),
    ("linux.feature.io", r"io"),
    ("prog.numtype", r"\s+(int|long|short|char|double|float|void)\s"),
    ("prog.func", r"[a-z][0-9a-z_]*\([^\(\)]*\)"),
    ("prog.bit", r"bit mask"),
    ("prog.endian", r"endian"),
    ("prog.cast", r"cast"),
    ("prog.align", r"alignment|padding"),
    ("bug.error.check", r"check(s|ed)* (null|error)"),
    ("bug.error.return", r"(wrong|incorrect) (return|error) (code|value)"),
    ("prog.path.error", r"(error|failure) path"),
    ("prog.path.exit", r"exit"),
    ("bug.memory.null", r"null (pointer )*deref|check .*null"),
    ("bug.memory.init", r"uninitial|miss(ing)* initial"),
    ("bug.memory.overflow", r"(buffer|array) (ov|und)er(flow|run)"),
    ("bug.memory.dangling", r"use[- ]after[- ]free|dangling"),
    ("bug.memory.doublefree", r"double free"),
    ("bug.memory.leak", r"leak|miss(ing)* (k|v)*free"),
    (
        "bug.memory.boundary",
        r"(index[- ])*out[- ]of[- ]bound[s]*|off[- ]by[- ]one[- ]|integer overflow|string termination",
    ),
    ("bug.concurrency.race", r"[^tg]rac(e|y|ing)|miss(ing)* [^(un)]*lock"),
    ("bug.concurrency.missunlock", r"miss(ing)* .*unlock"),
    ("bug.concurrency.doubleunlock", r"double .*unlock"),
    ("bug.concurrency.deadlock", r"deadlock"),
    ("bug.concurrency.wronglock", r"(wrong|fix) \w*lock"),
    ("bug.concurrency.sleepinatomic", r"sleep in atomic"),
    ("gen.conseq.crash", r"crash|oops|hang|infinite loop"),
    ("gen.conseq.corruption", r"data corruption"),
    ("gen.conseq.infoleak", r"info(rmation)* leak(age)*"),
]

RULES_PER_PASS = 256

Rules = Iterable[tuple[str, str]] | DataFrame


def _slices(rules: Rules) -> Iterator[list[tuple[str, str]]]:
    """Rules become literal patterns (compiled once per task), a bounded number in each expression."""
    if isinstance(rules, DataFrame):
        rules = ((r["name"], r["regex"]) for r in rules.select("name", "regex").orderBy("name").toLocalIterator())
    rules = iter(rules)
    while part := list(islice(rules, RULES_PER_PASS)):
        yield part


def _per_slice(rules: Rules, one_pass) -> DataFrame:
    passes = [one_pass(part) for part in _slices(rules)]
    # without rules there is no row, but the columns are the same
    return reduce(DataFrame.unionByName, passes) if passes else one_pass([("", "(?!)")]).limit(0)


def matched_names(low: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of the rules that occur in a lower-cased text."""
    return F.array_compact(F.array(*[F.when(low.rlike(regex), F.lit(name)) for name, regex in rules]))


def _lowered(docs: DataFrame, text_col: str) -> tuple[list[str], DataFrame]:
    keep = [c for c in docs.columns if c != text_col]
    return keep, spread(docs, keep[0]).select(*keep, F.lower(F.col(text_col)).alias("_low"))


def match_rules(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """One row per document and matching rule: the columns of ``docs`` but the text, and ``rule``."""
    keep, low = _lowered(docs, text_col)
    return _per_slice(rules, lambda part: low.select(*keep, F.explode(matched_names(F.col("_low"), part)).alias("rule")))


def match_groups(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """As :func:`match_rules`, with all matched strings in ``matches``."""
    keep, low = _lowered(docs, text_col)

    def one_pass(part):
        found = F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    F.regexp_extract_all(F.col("_low"), F.lit(regex), F.lit(0)).alias("matches"),
                )
                for name, regex in part
            ]
        )
        hits = F.filter(found, lambda m: F.size(m["matches"]) > 0)
        return low.select(*keep, F.explode(hits).alias("_hit")).select(*keep, "_hit.rule", "_hit.matches")

    return _per_slice(rules, one_pass)


def rule_counts(hits: DataFrame, group: str, point: str, groups: DataFrame | None = None, rules: Rules = ()) -> DataFrame:
    """``(group, rule, n)``: points of the group with one or more matching originals.

    With ``groups`` and ``rules`` the pairs without a match are listed with 0.
    """
    counts = hits.select(group, "rule", point).distinct().groupBy(group, "rule").agg(F.count("*").alias("n"))
    if groups is None:
        return counts
    every = _per_slice(
        rules,
        lambda part: groups.select(group, F.explode(F.array(*[F.lit(n) for n, _ in part])).alias("rule")),
    )
    return every.join(counts, [group, "rule"], "left").fillna(0, ["n"])
