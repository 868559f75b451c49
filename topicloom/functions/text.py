"""Cleaning of messages: paragraphs, signature paragraphs, tokens, content hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, short list.
STOP_WORDS_SHORT = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
).split()

# English stop words, long list.
STOP_WORDS_LONG = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()

# Marks of a paragraph that holds signatures or bookkeeping.
SIGNATURE_MARKS = ["signed-off-by:", "cc:", "git-svn-id:", "bitkeeper revision", "cherry pick"]
SIGNATURE_MARK_PAIR = ("commit", "upstream")

# Token length limits; a run of word characters is cut every 255 characters.
MIN_TOKEN, MAX_TOKEN, MAX_RUN = 2, 20, 255
NUMBER_PATTERN = "^(?:[0-9]+|[a-f0-9]+|0x[a-f0-9]+)$"


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Lower-cased paragraphs in order; the default separator is a blank line."""
    return F.split(F.lower(text), separator)


def is_signature(paragraph: Column) -> Column:
    """True for blank paragraphs and for paragraphs that hold signatures or bookkeeping."""
    blank = ~paragraph.rlike(r"[^\x00-\x20]")
    marked = blank
    for mark in SIGNATURE_MARKS:
        marked = marked | F.contains(paragraph, F.lit(mark))
    first, second = SIGNATURE_MARK_PAIR
    return marked | (F.contains(paragraph, F.lit(first)) & F.contains(paragraph, F.lit(second)))


def word_runs(text: Column, split_underscore: bool = False) -> Column:
    """Maximal runs of letters, digits and (unless split) underscores."""
    word = r"[\p{IsAlphabetic}\p{Nd}]" if split_underscore else r"[\p{IsAlphabetic}\p{Nd}_]"
    return F.regexp_extract_all(text, F.lit(f"({word}{{1,{MAX_RUN}}})"), F.lit(1))


def keep_token(token: Column, stop_words: list[str] | None = None, drop_hex: bool = True) -> Column:
    """Length, stop-word and number filter of one token."""
    number = NUMBER_PATTERN if drop_hex else "^[0-9]+$"
    words = STOP_WORDS_SHORT if stop_words is None else stop_words
    keep = F.length(token).between(MIN_TOKEN, MAX_TOKEN)
    if words:
        keep = keep & ~token.isin(words)
    return keep & ~token.rlike(number)


def paragraph_tokens(
    text: Column,
    *,
    split_underscore: bool = False,
    stop_words: list[str] | None = None,
    drop_hex: bool = True,
    separator: str = "\n\n",
) -> Column:
    """Array of token arrays, one for each paragraph that is not a signature."""
    kept = F.filter(paragraphs(text, separator), lambda p: ~is_signature(p))
    return F.transform(
        kept,
        lambda p: F.filter(
            word_runs(p, split_underscore), lambda t: keep_token(t, stop_words, drop_hex)
        ),
    )


def document_tokens(text: Column, **options) -> Column:
    """Tokens of all paragraphs in order. ``options`` as for :func:`paragraph_tokens`."""
    return F.flatten(paragraph_tokens(text, **options))


def content_hash(tokens: Column, bits: int = 512) -> Column:
    """SHA-512 (or another SHA-2) of the cleaned text, in hex."""
    return F.sha2(F.concat_ws(" ", tokens), bits)


def subject(message: Column) -> Column:
    """First line of a message."""
    return F.split_part(message, F.lit("\n"), F.lit(1))


def slash_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")
