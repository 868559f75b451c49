"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (its ends marked) and of itself; n-grams share hashed vectors, so a
misspelled word has most of its vector in common with the word it stands for. The vectors of a window of words are
averaged and go through a linear softmax. A text is judged by its worst window, so that a few words in a long
text are not averaged away; in training the first rounds take the whole text as one bag, the later ones its worst window.

The model is fitted by one task on a bounded sample of labelled texts (``SAMPLE`` toxic and as many others, of at most
``LONGEST`` characters, weighted back to their shares); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.batches import U64, mix, slices
from topicloom.scale import checkpoint, drop_step, ship_with_tasks

SAMPLE = 6000
LONGEST = 20_000
GRAMS = (3, 4, 5, 6)  # code points, with a mark at each end of the word
BUCKETS = 1 << 18
DIMS = 8
WINDOW = 3  # words; longer ones average single words away
WHOLE_ROUNDS, WORST_ROUNDS = 1, 10
BATCH = 128
RATE = 0.25
LEAST_TEXTS = 5  # n-grams of fewer sampled texts keep no vector
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20

_SEED = 20


# Words and their n-grams, by code points


def _letters() -> np.ndarray:
    """Whether a code point belongs to a word: letters, digits and marks."""
    if "table" not in _CACHE:
        _CACHE["table"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _CACHE["table"]


_CACHE: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15  # odd
_MARKS = np.array([0x110000, 0x110001], np.uint32)  # no code points: begin and end of a word


@dataclass
class Words:
    """Words of some texts: hash and distinct number of each word, where each text's words begin, the distinct words."""

    number: np.ndarray  # of each word: its place among the distinct ones
    starts: np.ndarray  # one more than there are texts
    hashes: np.ndarray  # of the distinct words
    grams: np.ndarray  # buckets of all n-grams of the distinct words
    gram_starts: np.ndarray  # one more than there are distinct words


def split_all(texts: list[str]) -> Words:
    """:func:`split` of many texts, a slice of them at a time."""
    parts, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE_BYTES:
            parts.append(split(held))
            held, size = [], 0
    parts.append(split(held))
    hashes, first = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True)
    owner = np.concatenate([np.full(len(p.hashes), i) for i, p in enumerate(parts)])[first]
    before = np.cumsum([0, *(len(p.hashes) for p in parts)])
    grams, counts = [None] * len(parts), np.zeros(len(hashes), np.int64)
    for i, p in enumerate(parts):
        mine = np.flatnonzero(owner == i)
        local = first[mine] - before[i]
        counts[mine] = np.diff(p.gram_starts)[local]
        grams[i] = mine, _taken(p, local)[0]
    gram_starts = np.concatenate([[0], np.cumsum(counts)])
    buckets = np.empty(gram_starts[-1], np.int64)
    for mine, found in grams:
        buckets[np.repeat(gram_starts[mine] - np.cumsum(counts[mine]) + counts[mine], counts[mine]) + np.arange(len(found))] = found
    number = np.concatenate([np.searchsorted(hashes, p.hashes)[p.number] for p in parts])
    lengths = np.concatenate([np.diff(p.starts) for p in parts])
    return Words(number, np.concatenate([[0], np.cumsum(lengths)]), hashes, buckets, gram_starts)


def _hash(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of code points, from prefix sums of digits to a fixed base."""
    powers = np.full(len(codes), _BASE, U64)
    powers[:1] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((codes.astype(U64) + U64(1)) * powers)])
    back = np.full(len(codes) + 1, pow(_BASE, -1, 1 << 64), U64)
    back[:1] = 1
    return mix((sums[end] - sums[begin]) * np.cumprod(back)[begin])


def split(texts: list[str | None]) -> Words:
    """Words of the texts in lower case. Null and empty texts have none."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in lower], dtype=np.int64)])
    inside = _letters()[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[ends] = True  # a word ends with its text
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    hashes, first, number = np.unique(_hash(codes, begin, end), return_index=True, return_inverse=True)
    grams, gram_starts = _grams(codes, begin[first], end[first])
    return Words(number.reshape(-1), np.searchsorted(begin, ends), hashes, grams, gram_starts)


def _grams(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of marked words and of each whole word, and where each word's begin."""
    lengths = end - begin + 2
    stops = np.cumsum(lengths)
    starts = stops - lengths
    total = int(lengths.sum())
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(total) - starts[word]
    marked = np.empty(total, np.uint32)
    inner = (place > 0) & (place < lengths[word] - 1)
    marked[starts], marked[stops - 1] = _MARKS
    marked[inner] = codes[(begin[word] + place - 1)[inner]]
    owners, found = [np.arange(len(lengths))], [_hash(marked, starts, stops)]
    for n in GRAMS:
        at = np.flatnonzero((place + n <= lengths[word]) & (n < lengths[word]))  # the whole word is there already
        owners.append(word[at])
        found.append(_hash(marked, at, at + n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(found) % U64(BUCKETS)).astype(np.int64)
    return buckets[order], np.searchsorted(owner[order], np.arange(len(lengths) + 1))


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of each run of values; no run is empty."""
    return np.add.reduceat(values, starts[:-1]) / np.diff(starts) if len(starts) > 1 else np.zeros(0)


def _windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window begins (one more than there are), and its text; a text's last window may be shorter."""
    counts = np.diff(starts)
    each = -(-counts // WINDOW)
    text = np.repeat(np.arange(len(counts)), each)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return np.append(starts[text] + turn * WINDOW, starts[-1:]), text


# The model


@dataclass(frozen=True)
class Model:
    """Vectors of the n-gram buckets that have one, softmax weights [class, dim] and biases [class]."""

    buckets: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def margins(self) -> np.ndarray:
        """What each bucket adds to the log odds of the toxic class; zero for buckets without a vector."""
        out = np.zeros(BUCKETS, np.float64)
        out[self.buckets] = self.vectors @ (self.weights[1] - self.weights[0])
        return out

    def bias(self) -> float:
        return float(self.biases[1] - self.biases[0])


def scores(words: Words, margins: np.ndarray, bias: float) -> np.ndarray:
    """Chance of the toxic class for each text, by its worst window; a text without words has what the bias says."""
    odds = np.zeros(len(words.starts) - 1)
    if len(words.number):
        word = _means(margins[words.grams], words.gram_starts)
        starts, text = _windows(words.starts)
        worst = np.full(len(odds), -np.inf)
        np.maximum.at(worst, text, _means(word[words.number], starts))
        odds = np.where(np.isfinite(worst), worst, 0.0)
    return 1 / (1 + np.exp(-np.clip(odds + bias, -50, 50)))


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Vectors and softmax by Adagrad on the cross-entropy of the texts, each with its weight."""
    words = split_all(texts)
    rng = np.random.default_rng(_SEED)
    # n-grams of too few texts get no vector: they would only learn their texts by heart
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.starts))
    distinct = max(1, len(words.hashes))
    seen = np.unique(text_of * distinct + words.number)
    gram_counts = np.diff(words.gram_starts)
    texts_with = np.zeros(BUCKETS, np.int64)
    edges = np.searchsorted(seen, np.arange(0, len(texts) + BATCH, BATCH) * distinct)
    for part in (seen[x:y] for x, y in zip(edges, edges[1:], strict=False)):
        grams, _ = _taken(words, part % distinct)
        both = np.unique(np.repeat(part // distinct, gram_counts[part % distinct]) * BUCKETS + grams)
        texts_with += np.bincount(both % BUCKETS, minlength=BUCKETS)
    known = texts_with >= LEAST_TEXTS
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMS)) / DIMS * known[:, None]
    weights, biases = rng.normal(0, 0.1, (2, DIMS)), np.zeros(2)
    square_v, square_w, square_b = np.zeros(BUCKETS), np.full((2, DIMS), 1e-8), np.full(2, 1e-8)
    starts, window_text = _windows(words.starts)
    full = np.flatnonzero(np.diff(words.starts) > 0)
    empty = np.flatnonzero(np.diff(words.starts) == 0)
    for turn in range(WHOLE_ROUNDS + WORST_ROUNDS):
        first, last = words.starts[:-1].copy(), words.starts[1:].copy()
        if turn >= WHOLE_ROUNDS and len(window_text):
            margin = _means((vectors @ (weights[1] - weights[0]))[words.grams], words.gram_starts)
            value = _means(margin[words.number], starts)
            order = np.lexsort((value, window_text))
            worst = order[np.flatnonzero(np.diff(window_text[order], append=-1))]
            first[window_text[worst]], last[window_text[worst]] = starts[worst], starts[worst + 1]
        rate = RATE * (1 - turn / (WHOLE_ROUNDS + WORST_ROUNDS))
        texts_in_turn = rng.permutation(np.concatenate([full, empty]))
        for begin in range(0, len(texts_in_turn), BATCH):
            batch = texts_in_turn[begin : begin + BATCH]
            counts = (last - first)[batch]
            place = np.repeat(first[batch], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            number = words.number[place]
            grams, share = _taken(words, number)
            owner = np.repeat(np.repeat(np.arange(len(batch)), counts), gram_counts[number])
            share = share / np.maximum(counts, 1)[owner]
            bag = np.zeros((len(batch), DIMS))
            for k in range(DIMS):
                bag[:, k] = np.bincount(owner, share * vectors[grams, k], len(batch))
            logits = bag @ weights.T + biases
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            error = chance
            error[np.arange(len(batch)), toxic[batch]] -= 1
            error *= weight[batch][:, None]
            used, slot = np.unique(grams, return_inverse=True)
            by_class = np.stack([np.bincount(slot, share * error[owner, k], len(used)) for k in (0, 1)], 1)
            change = (by_class @ weights) * known[used][:, None]
            by_weight = error.T @ bag
            square_v[used] += (change**2).mean(1)
            square_w += by_weight**2
            square_b += error.sum(0) ** 2
            vectors[used] -= rate * change / np.sqrt(square_v[used] + 1e-10)[:, None]
            weights -= rate * by_weight / np.sqrt(square_w)
            biases -= rate * error.sum(0) / np.sqrt(square_b)
    kept = np.flatnonzero(known)
    return Model(kept, vectors[kept].astype(np.float32), weights, biases)


def _taken(words: Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of some of the distinct words, one after the other, and each one's share of its word."""
    counts = np.diff(words.gram_starts)[number]
    before = np.cumsum(counts) - counts
    at = np.repeat(words.gram_starts[:-1][number] - before, counts) + np.arange(counts.sum())
    return words.grams[at], np.repeat(1 / np.maximum(counts, 1), counts)


# On Spark


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(text, toxic, weight)``: at most ``most`` different texts of each class, the first by a hash of the text.

    Learns from rows that are not held out and have a label; a text is toxic if any of its rows is. The weight of a class is
    its share of the labelled texts over its share of the sample.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic"))
    texts = documents.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    given = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= LONGEST))
    key = F.struct(F.xxhash64("text").alias("a"), F.md5(F.col("text").cast("binary")).alias("b"))
    keyed = given.select("doc_id", key.alias("key")).join(marks, "doc_id")
    classes = checkpoint(keyed.groupBy("key").agg(F.when(F.max("toxic") == 1, 1).otherwise(0).alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in classes.groupBy("toxic").count().collect()}
    chosen = classes.limit(0).withColumn("weight", F.lit(1.0))
    for kind, size in sorted(sizes.items()):
        taken = classes.where(F.col("toxic") == kind).orderBy("key").limit(most)
        chosen = chosen.unionByName(taken.withColumn("weight", F.lit(size / min(size, most))))
    chosen = F.broadcast(checkpoint(chosen))  # at most 2 x most rows
    picked = given.select("text", key.alias("key")).join(chosen, "key").dropDuplicates(["key"])
    made = checkpoint(picked.select("key", "text", "toxic", "weight"))
    drop_step(classes)
    return made


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model of the bounded sample, trained in one task; a lost task trains the same model again.

    Without labelled texts every text gets a chance of one half; with one class only, nearly 0 or 1.
    """
    rows = sample(documents, labels, most)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema).sort_by("key")
        texts, toxic = table["text"].to_pylist(), table["toxic"].to_numpy()
        weight = table["weight"].to_numpy()
        if len(texts):
            model = train(texts, toxic, weight / weight.mean())
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([*["v"] * len(model.buckets), "w", "w", "b"]),
                "at": pa.array([*model.buckets.tolist(), 0, 1, 0], pa.int64()),
                "x": pa.array([*model.vectors.tolist(), *model.weights.tolist(), model.biases.tolist()], pa.list_(pa.float64())),
            })

    schema = pa.schema([("key", pa.string()), ("text", pa.string()), ("toxic", pa.int32()), ("weight", pa.float64())])
    given = rows.select(F.col("key.b").alias("key"), "text", F.col("toxic").cast("int").alias("toxic"), F.col("weight").cast("double"))
    made = checkpoint(given.coalesce(1).mapInArrow(task, "kind string, at long, x array<double>"))  # at most 2 x most rows
    found = made.toArrow().to_pydict()  # at most BUCKETS + 3 rows
    by = {k: [(a, x) for kind, a, x in zip(found["kind"], found["at"], found["x"], strict=True) if kind == k] for k in "vwb"}
    drop_step(rows, made)
    if not by["b"]:
        return Model(np.zeros(0, np.int64), np.zeros((0, DIMS), np.float32), np.zeros((2, DIMS)), np.zeros(2))
    weights = np.array([x for _, x in sorted(by["w"])])
    buckets, vectors = [a for a, _ in by["v"]], [x for _, x in by["v"]]
    return Model(np.array(buckets, np.int64), np.array(vectors, np.float32).reshape(-1, DIMS), weights, np.array(by["b"][0][1]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of the input and ``score``, the chance that the text is toxic. Equal texts have equal scores.

    Null and empty texts, and texts without words, have the score of the bias alone.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.margins(), model.bias()))
    carried = [c for c in documents.columns if c != "score"]
    rows = documents.select(F.struct(*carried).alias("row"), F.col("text").cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, bias = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                made = scores(split(part.column("text").to_pylist()), margins, bias)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(made)], ["row", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(task, schema).select("row.*", "score")


def judge(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of the documents, from a model of the labelled rows.

    Repeated rows and null ids stay; an empty table gives an empty table.
    """
    # equal texts get equal scores whatever their rows, so neither id nor source reaches a score
    rows = score(documents.select("doc_id", "text"), fit(documents, labels))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


ship_with_tasks(__name__)
