"""Alignment of two tokenizers over the bytes of a text, by galloping intersection of their token ends.

Each text is encoded by both tokenizers. Byte offsets where tokens of both end cut the two token lists into groups
that cover the same bytes; the two tokens that end at a cut are linked. A link's weight is how often its pair of ids
is linked in the whole corpus.

Neither kind of tokenizer merges across a single space between two other characters, so a text is the sequence of its
words, each with the space before it: words are encoded and aligned once per task and texts put together from them.

Two tokens that end together, read backwards, agree until the shorter one ends, so the shorter is a suffix of the
longer. The number of different pairs is therefore at most the number of bytes in both vocabularies
(:func:`most_pairs`), whatever the size of the corpus, and a table of pairs may be sent to every task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.batches import slices
from topicloom.scale import checkpoint, ship_with_tasks

SLICE_BYTES = 1 << 20  # text in work at a time; encodings take about a hundred bytes a token
KEPT_WORDS = 150_000  # words that a task remembers before it starts anew

# A space between two characters that are neither white space nor the mark that stands for a space in pieces.
BETWEEN_WORDS = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")
ALONE = re.compile("^[\\s\u2581]|[\\s\u2581]\\Z|^\\Z")  # begin or end of a text that is no such place
WORDS_AT_ONCE = 4096
WEIGHED_ROWS = 256  # documents whose links are looked up at a time

# Bytes that a byte-level vocabulary writes as themselves; the others are U+0100 and up, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_LOADED: dict[int, tuple[Callable, pa.Array, bool]] = {}


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file, read on the driver and sent to the tasks. ``kind``: ``byte_level`` (JSON) or ``pieces`` (model).

    A byte-level tokenizer encodes the text behind one space, as the other kind does by itself.
    """

    kind: str
    content: bytes = field(repr=False)

    @staticmethod
    def read(path: str, kind: str) -> Tokenizer:
        with open(path, "rb") as f:
            return Tokenizer(kind, f.read())

    def load(self) -> tuple[Callable[[list[str]], list[list[int]]], pa.Array, bool]:
        """Function from texts to id lists, the bytes of every id, and whether words can be encoded one by one.

        Made once in a process.
        """
        key = hash((self.kind, self.content))
        if key not in _LOADED:
            _LOADED[key] = (_byte_level if self.kind == "byte_level" else _pieces)(self.content)
        return _LOADED[key]


def _byte_level(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    import tokenizers

    model = tokenizers.Tokenizer.from_buffer(content)
    model.encode_special_tokens = True  # their strings in a text are plain text
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    byte_of = {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    entries = model.get_vocab()
    written = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        if all(c in byte_of for c in entry):
            written[i] = bytes(byte_of[c] for c in entry)

    def encode(texts):
        return [e.ids for e in model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]

    made = json.loads(content)
    plain = {"type": "ByteLevel", "use_regex": True}
    by_word = not made.get("normalizer") and plain.items() <= ({"use_regex": True} | (made.get("pre_tokenizer") or {})).items()
    return encode, pa.array(written, pa.large_binary()), by_word


def _pieces(content: bytes):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)

    def spelled(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    written = [spelled(i) for i in range(model.get_piece_size())]
    inside = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    keeps_spaces = b"".join(written[i] for i in model.encode("a  b c ")) == b" a  b c "
    return lambda texts: model.encode(texts, num_threads=1), pa.array(written, pa.large_binary()), keeps_spaces and not inside


def most_pairs(a: Tokenizer, b: Tokenizer) -> int:
    """Upper bound of the different pairs of ids that can end together."""
    return sum(int(pc.sum(pc.binary_length(t.load()[1])).as_py()) for t in (a, b))


def gallop(drive: np.ndarray, into: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``drive`` and in ``into`` (both rising, no repeats) of their common values.

    Every value of ``drive`` starts at its place in ``start`` (in proportion, if not given), doubles its step until it
    has passed its value, and halves the bracket; all values move at once.
    """
    n = len(into)
    if n == 0 or len(drive) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(drive)) * n // len(drive) if start is None else np.clip(start, 0, n - 1)
    below = into[at] < drive
    low, high = np.where(below, at, -1), np.where(below, n, at)  # into[low] < value <= into[high]
    step = 1
    for up in (True, False):
        moving = np.flatnonzero(below == up)
        step = 1
        while len(moving):
            to = (low[moving] + step) if up else (high[moving] - step)
            inside = (to < n) if up else (to >= 0)
            moving, to = moving[inside], to[inside]
            passed = (into[to] >= drive[moving]) if up else (into[to] < drive[moving])
            (high if up else low)[moving[passed]] = to[passed]
            moving = moving[~passed]
            (low if up else high)[moving] = to[~passed]
            step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = into[middle] < drive[open_]
        low[open_[less]], high[open_[~less]] = middle[less], middle[~less]
        open_ = open_[high[open_] - low[open_] > 1]
    found = np.flatnonzero(high < n)
    found = found[into[high[found]] == drive[found]]
    return found, high[found]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ends in both lists; the shorter list drives the search into the longer one."""
    if len(ends_a) <= len(ends_b):
        return gallop(ends_a, ends_b)
    in_b, in_a = gallop(ends_b, ends_a)
    return in_a, in_b


@dataclass
class _Coded:
    """Tokens of some texts in one flat list: ids, ends in bytes over all texts, number of tokens of each text."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def only(self, keep: np.ndarray, written: pa.Array) -> _Coded:
        ids = self.ids[np.repeat(keep, self.counts)]
        return _Coded(ids, np.cumsum(pc.binary_length(written).to_numpy()[ids]), np.where(keep, self.counts, 0))


def _encode(tokenizer: Tokenizer, texts: list[str], given: list[bytes]) -> tuple[_Coded, np.ndarray]:
    """Tokens of the texts, and whether each text's tokens spell its bytes ``given``."""
    encode, written, _ = tokenizer.load()
    lists = encode(texts)
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in lists)])
    whole, ends = _spelled(written, ids)
    last = np.concatenate([[0], ends])[np.cumsum(counts)].tolist()
    same = [whole[x:y] == g for x, y, g in zip([0, *last], last, given)]
    return _Coded(ids, ends, counts), np.array(same, bool)


def _spelled(written: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All bytes of the tokens, and where each token ends."""
    _, places, data = written.take(pa.array(ids)).buffers()
    ends = np.frombuffer(places, np.int64)[1 : len(ids) + 1] if len(ids) else np.zeros(0, np.int64)
    return data.to_pybytes() if data else b"", ends


def _encode_words(tokenizer: Tokenizer, words: list[str], given: list[bytes]) -> tuple[_Coded, np.ndarray]:
    """As :func:`_encode`, for words that may stand side by side: few long texts are faster than many short ones."""
    encode, written, _ = tokenizer.load()
    lists = encode([" ".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
    ids = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in lists)])
    whole, ends = _spelled(written, ids)
    word_ends = np.cumsum([len(g) for g in given], dtype=np.int64)
    if whole != b"".join(given):
        return _encode(tokenizer, words, given)  # some word is not spelled exactly
    counts = np.diff(np.searchsorted(ends, word_ends, side="right"), prepend=0)
    return _Coded(ids, ends, counts), np.ones(len(words), bool)


@dataclass
class _Lists:
    """Lists one after the other in ``flat``; list i begins at ``starts[i]``."""

    flat: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, counts: np.ndarray) -> _Lists:
        return _Lists(flat.astype(np.int32), np.concatenate([[0], np.cumsum(counts)]))

    def append(self, other: _Lists) -> _Lists:
        return _Lists(np.concatenate([self.flat, other.flat]), np.concatenate([self.starts, other.starts[1:] + self.starts[-1]]))

    def joined(self, of: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Lists made of ``counts[k]`` of the lists ``of`` each."""
        lengths = np.diff(self.starts)[of]
        before = np.cumsum(lengths) - lengths
        flat = self.flat[np.repeat(self.starts[:-1][of] - before, lengths) + np.arange(lengths.sum())]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def _aligned(words: list[str], a: Tokenizer, b: Tokenizer, encode: Callable) -> tuple[list[_Lists], np.ndarray]:
    """``ids_a, ids_b, sizes_a, sizes_b`` of each word (behind a space), and whether both tokenizers spell it exactly."""
    given = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
    (coded_a, whole_a), (coded_b, whole_b) = (encode(t, words, given) for t in (a, b))
    keep = whole_a & whole_b
    coded_a, coded_b = coded_a.only(keep, a.load()[1]), coded_b.only(keep, b.load()[1])
    at_a, at_b = common_ends(coded_a.ends, coded_b.ends)  # words end in both lists, so no group spans two of them
    groups = np.bincount(np.searchsorted(np.cumsum(coded_a.counts), at_a, side="right"), minlength=len(words))
    made = [(coded_a.ids, coded_a.counts), (coded_b.ids, coded_b.counts), (np.diff(at_a, prepend=-1), groups), (np.diff(at_b, prepend=-1), groups)]
    return [_Lists.of(*m) for m in made], keep


class _Aligner:
    """Aligns texts word by word and remembers the words."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b
        self.by_word = a.load()[2] and b.load()[2]
        self.split = BETWEEN_WORDS.split if self.by_word else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.lists, self.whole = [_Lists(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in range(4)], np.zeros(0, bool)

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        """``ids_a, ids_b, sizes_a, sizes_b``, empty where a text is null, empty or not spelled exactly."""
        words = [self.split(t) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        if len(self.place) > KEPT_WORDS:
            self.forget()
        unknown = dict.fromkeys(w for w in flat if w not in self.place)
        alone = [w for w in unknown if ALONE.search(w)] if self.by_word else list(unknown)
        for new, encode in ((list(unknown.keys() - set(alone)), _encode_words), (alone, _encode)):
            if not new:
                continue
            found, whole = _aligned(new, self.a, self.b, encode)
            self.place.update(zip(new, range(len(self.whole), len(self.whole) + len(new)), strict=True))
            self.lists, self.whole = [x.append(y) for x, y in zip(self.lists, found, strict=True)], np.concatenate([self.whole, whole])
        of = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        text = np.repeat(np.arange(len(words)), counts)
        good = np.bincount(text[~self.whole[of]], minlength=len(words)) == 0
        if not good.all():
            of, counts = of[good[text]], np.where(good, counts, 0)
        return [x.joined(of, counts) for x in self.lists]


GROUPS = "ids_a array<int>, ids_b array<int>, sizes_a array<int>, sizes_b array<int>"


def align(documents: DataFrame, a: Tokenizer, b: Tokenizer) -> DataFrame:
    """Token ids of both tokenizers and the groups that common ends cut them into, row by row.

    The columns other than ``text`` are kept; new columns are ``ids_a, ids_b`` and ``sizes_a, sizes_b``, the numbers of
    tokens of each group. All four are empty for a text that is null, empty, or not spelled exactly by its tokens. Rows
    are independent of each other: repeated rows and null ids give repeated rows and null ids. Columns of the
    input named like new ones are replaced.
    """
    new = T._parse_datatype_string(GROUPS).fieldNames()
    carried = [c for c in documents.columns if c not in (*new, "text")]
    rows = documents.select(F.struct(*carried).alias("row") if carried else F.lit(0).alias("row"), F.col("text").cast("string"))
    shared = documents.sparkSession.sparkContext.broadcast((a, b))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(*shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                made = aligner(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], ["row", *new])

    row = rows.schema["row"].dataType.simpleString() if not carried else None
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *T._parse_datatype_string(GROUPS).fields])
    made = rows.mapInArrow(task, schema)
    return made.select(*([] if row else ["row.*"]), *new)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's values begin (one more entry than rows)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``a << 32 | b`` of the ids that end each group, and where each row's pairs begin."""
    (ids_a, _), (ids_b, _) = (_flat(batch.column(c)) for c in ("ids_a", "ids_b"))
    (sizes_a, starts), (sizes_b, _) = (_flat(batch.column(c)) for c in ("sizes_a", "sizes_b"))
    last_a, last_b = np.cumsum(sizes_a, dtype=np.int64) - 1, np.cumsum(sizes_b, dtype=np.int64) - 1
    return ids_a[last_a].astype(np.int64) << 32 | ids_b[last_b], starts


def _part_rows(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` tokens, one row at least."""
    tokens = pc.list_value_length(batch.column("ids_a")).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(tokens) // limit, prepend=0)) if len(tokens) else []
    edges = [0, *(int(c) for c in cuts if c), batch.num_rows]
    for x, y in zip(edges, edges[1:], strict=False):
        if y > x:
            yield batch.slice(x, y - x)


class _Counter:
    """How often each pair was seen in a task; never more of them than :func:`most_pairs`."""

    def __init__(self):
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray) -> None:
        new, n = np.unique(pairs, return_counts=True)
        self.pairs, where = np.unique(np.concatenate([self.pairs, new]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, n]), len(self.pairs)).astype(np.int64)


def _summed_pairs(partial: DataFrame) -> DataFrame:
    """``(a, b, n, best)`` of partial counts ``(pair, n)``; ``best``: no other a is linked to this b more often."""
    summed = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counts = checkpoint(summed.select(F.shiftright("pair", 32).cast("int").alias("a"), low.cast("int").alias("b"), "n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, n, best)``: how often ids are linked, and whether no other a is linked to this b more often.

    A task sends a pair once, so the shuffle moves at most tasks x :func:`most_pairs` rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counter()
        for batch in batches:
            for part in _part_rows(batch):
                seen.add(_links(part)[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.pairs), pa.array(seen.counts)], ["pair", "n"])

    lists = aligned.select("ids_a", "ids_b", "sizes_a", "sizes_b")
    return _summed_pairs(lists.mapInArrow(task, "pair long, n long"))


def _digests(batch: pa.RecordBatch, words: tuple[pa.Array, int]) -> list[str]:
    """Hex digest of each row's groups, written ``a1,a2|b1;a3|b2,b3``; '' for a row without tokens."""
    (ids_a, from_a), (ids_b, from_b) = (_flat(batch.column(c)) for c in ("ids_a", "ids_b"))
    (sizes_a, from_g), (sizes_b, _) = (_flat(batch.column(c)) for c in ("sizes_a", "sizes_b"))
    table, kinds = words
    ends_a, ends_b = np.cumsum(sizes_a, dtype=np.int64), np.cumsum(sizes_b, dtype=np.int64)
    code = np.zeros(len(ids_a) + len(ids_b), np.int64)
    group_a, group_b = np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)
    place_a = np.arange(len(ids_a)) + (ends_b - sizes_b)[group_a]  # behind the b tokens of earlier groups
    place_b = np.arange(len(ids_b)) + ends_a[group_b]
    code[place_a], code[place_b] = ids_a.astype(np.int64) * kinds, ids_b.astype(np.int64) * kinds
    code[place_a[ends_a - 1]] += 1  # |
    code[place_b[ends_b - 1]] += 2  # ;
    last = ends_b[from_g[1:][from_g[1:] > from_g[:-1]] - 1] - 1
    code[place_b[last]] += 1  # nothing
    written = table.take(pa.array(code))
    _, places, data = written.buffers()
    ends = np.frombuffer(places, np.int64)[: len(code) + 1] if len(code) else np.zeros(1, np.int64)
    edges, whole = ends[from_a + from_b].tolist(), data.to_pybytes() if data else b""
    return [hashlib.sha256(whole[x:y]).hexdigest() if y > x else "" for x, y in zip(edges, edges[1:], strict=False)]


def _words(a: Tokenizer, b: Tokenizer) -> tuple[pa.Array, int]:
    ends = (",", "|", ";", "")
    most = max(len(t.load()[1]) for t in (a, b))
    return pa.array([f"{i}{e}" for i in range(most) for e in ends], pa.large_string()), len(ends)


def digest_links(documents: DataFrame, a: Tokenizer, b: Tokenizer) -> DataFrame:
    """One row per document with ``doc_id``: counts of tokens, groups and links, weights of its links, digest of its groups.

    ``n_best`` counts links whose pair is the one most often linked to its b id (ties included), ``count_sum`` adds
    up the corpus counts of the links. Texts without tokens (see :func:`align`) have zeros and an empty digest. An empty
    table gives an empty table.

    Texts are encoded once: a task writes each document's links, and behind them the counts of the pairs it has met. A second
    pass looks the corpus counts up.
    """
    shared = documents.sparkSession.sparkContext.broadcast((a, b))
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair", "n"]
    kind = documents.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        aligner, seen, words = _Aligner(a, b), _Counter(), _words(a, b)
        wide, number = _multiplier(b), _number(a, b)
        ids = pa.null()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = part.column("doc_id").type
                made = pa.RecordBatch.from_arrays(aligner(part.column("text").to_pylist()), ["ids_a", "ids_b", "sizes_a", "sizes_b"])
                links, starts = _links(made)
                seen.add(links)
                n_a, n_b = (pc.list_value_length(made.column(c)).cast(pa.int64()) for c in ("ids_a", "ids_b"))
                packed = ((links >> 32) * wide + (links & 0xFFFFFFFF)).astype(number)
                listed = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(packed))
                none = pa.nulls(made.num_rows, pa.int64())
                columns = [part.column("doc_id"), n_a, n_b, pa.array(np.diff(starts)), pa.array(_digests(made, words), pa.string()), listed, none, none]
                yield pa.RecordBatch.from_arrays(columns, names)
        count = len(seen.pairs)
        blank = [pa.nulls(count, t) for t in (ids, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.from_numpy_dtype(number)))]
        if count:
            yield pa.RecordBatch.from_arrays([*blank, pa.array(seen.pairs), pa.array(seen.counts)], names)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            links, starts = _flat(batch.column(batch.schema.get_field_index("links")))
            sums = [np.zeros(len(starts) - 1, np.int64) for _ in (best, n)]
            for at in range(0, len(starts) - 1, WEIGHED_ROWS):
                edges = starts[at : at + WEIGHED_ROWS + 1]
                place = np.searchsorted(pairs, links[edges[0] : edges[-1]])
                for total, x in zip(sums, (best, n), strict=True):
                    running = np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)])
                    total[at : at + WEIGHED_ROWS] = np.diff(running[edges - edges[0]])
            given = {c: batch.column(batch.schema.get_field_index(c)) for c in names[:5]}
            told = given | {"n_links": given["n_groups"], "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays([told[c] for c in result], result)

    counts = "n_a long, n_b long, n_groups long"
    links = "int" if _number(a, b) is np.int32 else "long"
    made = checkpoint(
        documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
            encode, f"doc_id {kind}, {counts}, groups_sha256 string, links array<{links}>, pair long, n long"
        )
    )
    table = _summed_pairs(made.where("pair is not null").select("pair", "n")).toArrow()  # at most most_pairs(a, b) rows
    pairs = table["a"].to_numpy().astype(np.int64) * _multiplier(b) + table["b"].to_numpy()
    order = np.argsort(pairs)
    known = documents.sparkSession.sparkContext.broadcast((pairs[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]))
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return made.where("pair is null").select(*names[:6]).mapInArrow(
        weigh, f"doc_id {kind}, {counts}, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def _multiplier(b: Tokenizer) -> int:
    """Pairs are written as a x this + b, which keeps the numbers short on disk."""
    return len(b.load()[1])


def _number(a: Tokenizer, b: Tokenizer) -> type:
    """The numbers of pairs take half the room where both vocabularies are small enough."""
    return np.int32 if len(a.load()[1]) * _multiplier(b) < 1 << 31 else np.int64


ship_with_tasks(__name__)
