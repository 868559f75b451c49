"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document leaks an item if some run of its words is within ``floor(0.2 * words of the item)`` word edits of the
item. An item cut into that many pieces plus one must share a whole piece with such a run, so windows of
the item's size are laid only where a piece stands in the document; this loses nothing. The CGK random
walk maps item and window to sequences whose Hamming distance follows their edit distance, and a window goes
on if, in any repetition, the sampled places of both are equal. What goes on is verified by the edit distance
of the item to its best run around the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.batches import U64, hashed_words, mix, slices
from topicloom.scale import checkpoint, ship_with_tasks

EDIT_SHARE = 0.2
REPETITIONS, SAMPLES = 64, 2  # recall over 0.99 at the largest distance; see tests/llm
ITEM_WORDS = 500_000  # words of benchmark that one pass over the documents takes along
SEED = 20260

_STEP = U64(0x9E3779B97F4A7C15)
_WRAP = (1 << 64) - 1


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * _STEP + words[k : k + n]
    return mix(out)


def edits(size: int) -> int:
    return int(EDIT_SHARE * size)


def best_run_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Least number of word edits between the item and any run of words in the region."""
    row = np.zeros(len(region) + 1, np.int64)  # a run may begin anywhere
    steps = np.arange(len(region) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


class Items:
    """The items of one pass: their words, the pieces that point to them, and their sampled walks."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        words, offsets = hashed_words(pa.array(texts, pa.string()))
        parts = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        kept = [(i, w) for i, w in zip(ids, parts, strict=True) if len(w)]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for number, w in enumerate(self.words):
            count = edits(len(w)) + 1
            width = len(w) // count
            hashes = grams(w, width)
            pieces.setdefault(width, []).extend((int(hashes[k * width]), number, k * width) for k in range(count))
        self.pieces = {width: _Lookup(rows) for width, rows in pieces.items()}
        self.keys = [sampled(w[None, :], len(w))[0] for w in self.words]


class _Lookup:
    def __init__(self, rows: list[tuple[int, int, int]]) -> None:
        rows = sorted(rows)
        self.key = np.array([r[0] for r in rows], U64)
        self.item = np.array([r[1] for r in rows])
        self.place = np.array([r[2] for r in rows])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.key >> U64(44)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions that hold a piece, with the piece's item and its place in the item."""
        at = np.flatnonzero(self.maybe[hashes >> U64(44)])
        low, high = np.searchsorted(self.key, hashes[at]), np.searchsorted(self.key, hashes[at], side="right")
        n = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[rows], self.place[rows]


def sampled(windows: np.ndarray, size: int) -> np.ndarray:
    """CGK walks of equally long windows (rows of word hashes): per repetition a hash of the sampled places.

    A walk has 3 * size steps. It writes the word that it stands on, and a random bit of (repetition, step, word)
    says whether it moves on; behind the last word it writes 0.
    """
    count = len(windows)
    padded = np.concatenate([windows, np.zeros((count, 1), U64)], axis=1)
    seeds = mix(np.arange(REPETITIONS, dtype=U64) + U64(SEED))
    rng = np.random.default_rng(SEED + size)
    places = np.sort(np.stack([rng.choice(3 * size, min(SAMPLES, 3 * size), replace=False) for _ in range(REPETITIONS)]), axis=1)
    at = np.zeros((count, REPETITIONS), np.int64)
    key = np.zeros((count, REPETITIONS), U64)
    rows = np.arange(count)[:, None]
    for step in range(int(places.max()) + 1):
        word = padded[rows, at]
        here = (places == step).any(axis=1)
        key[:, here] = mix(key[:, here] * _STEP + word[:, here])
        at = np.minimum(at + ((mix(word + seeds + U64(step * int(_STEP) & _WRAP)) & U64(1)) == 1), size)
    return key


def leaks_of(items: Items, texts: pa.Array) -> list[tuple[int, int, int]]:
    """(text number, item number, edits) of every leak."""
    words, offsets = hashed_words(texts)
    tried: set[tuple[int, int, int]] = set()  # text, item, start of the window
    for width, lookup in items.pieces.items():
        at, item, place = lookup.hits(grams(words, width))
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + width <= offsets[text + 1]
        tried.update(zip(text[inside].tolist(), item[inside].tolist(), (at - place)[inside].tolist(), strict=True))
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for one in tried:
        by_size.setdefault(len(items.words[one[1]]), []).append(one)
    found: dict[tuple[int, int], int] = {}
    for size, all_of_size in by_size.items():
        for first in range(0, len(all_of_size), 256):
            ones = all_of_size[first : first + 256]
            windows = np.zeros((len(ones), size), U64)
            for row, (text, _, start) in zip(windows, ones, strict=True):
                low, high = max(start, offsets[text]), min(start + size, offsets[text + 1])
                row[low - start : high - start] = words[low:high]
            keys = sampled(windows, size)
            for (text, item, start), window, key in zip(ones, windows, keys, strict=True):
                if not (key == items.keys[item]).any():
                    continue
                if (window == items.words[item]).all():
                    found[text, item] = 0
                    continue
                most = edits(size)
                low, high = max(start - most, offsets[text]), min(start + size + most, offsets[text + 1])
                distance = best_run_distance(items.words[item], words[low:high])
                if distance <= min(most, found.get((text, item), most)):
                    found[text, item] = distance
    return sorted((text, item, distance) for (text, item), distance in found.items())


def _passes(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one after the other; one block unless it is very large."""
    sized = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna().distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (4 * ITEM_WORDS)
    for block in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows])


def leaks(documents: DataFrame, benchmark: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per document and leaked item: the key columns (``doc_id``), ``item_id`` and ``edits``.

    Null or empty items and texts leak nothing. Repeated documents give repeated rows; other columns do not count.
    A benchmark of over about ``ITEM_WORDS`` words is taken in several passes over the documents.
    """
    keys = keys or ["doc_id"]
    picked = documents.select(*keys, F.col("text").cast("string").alias("text"))
    out = None
    for items in _passes(benchmark):
        part = picked.mapInArrow(_search(items, keys), _schema(picked, keys))
        out = part if out is None else out.union(part)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, columns as they are."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = documents.withColumn("_key", key)
    found = checkpoint(leaks(marked, benchmark, ["_key"]).select("_key").distinct())
    return marked.join(found, "_key", "left_anti").select(*documents.columns)


def _schema(picked: DataFrame, keys: list[str]) -> str:
    types = dict(picked.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys) + ", item_id long, edits long"


def _search(items: Items, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = leaks_of(items, part.column("text"))
                if found:
                    rows = pa.array([t for t, _, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k).take(rows) for k in keys), pa.array([items.ids[i] for _, i, _ in found], pa.int64()),
                         pa.array([d for _, _, d in found], pa.int64())],
                        names=[*keys, "item_id", "edits"],
                    )

    return run


ship_with_tasks(__name__)
