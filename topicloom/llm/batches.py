"""Arrow helpers of the operators: bounded slices of a batch, words of a slice, seeds for hashing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from topicloom.scale import ship_with_tasks

SLICE_BYTES = 4 << 20  # text that one step of a task holds; a longer single text is a slice of its own

U64 = np.uint64


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


@contextmanager
def rows_per_batch(spark: SparkSession, most: int):
    """Smaller Arrow batches for the jobs run inside, whose rows are whole texts; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one flat array, and the place where each text's words begin.

    The second result has one more entry than there are texts. Null texts have no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


# Bytes that are no letter, digit or part of a character beyond ASCII become spaces; A-Z become a-z.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


_TABLE = np.frombuffer(TO_WORDS, np.uint8)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse among 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, U64)
    out[:1] = 1
    return np.cumprod(out)


def hashed_words(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word without case and punctuation, and where each text's words begin.

    The bytes of a word are digits of a number to a fixed base; sums over all bytes give every word at once.
    """
    array = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())
    _, places, data = array.buffers()
    ends = np.frombuffer(places, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if len(raw) == 0:
        return np.zeros(0, U64), np.zeros(len(array) + 1, np.int64)
    plain = _TABLE[raw]
    inside = np.concatenate([plain != 0x20, [False]])
    edge = np.zeros(len(raw) + 1, bool)  # a word ends with its text
    edge[ends] = True
    begins = inside & (edge | ~np.concatenate([[False], inside[:-1]]))
    first = np.flatnonzero(begins)
    last = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((plain.astype(U64) + U64(1)) * _powers(_BASE, len(raw)))])
    values = mix((sums[last] - sums[first]) * _powers(_INVERSE, len(raw))[first])
    return values, np.concatenate([[0], np.cumsum(begins)])[ends]


def mix(values: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (xor-shift and multiply), for hashing integers."""
    x = values.astype(U64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U64(shift))) * U64(factor)
    return x ^ (x >> U64(31))


ship_with_tasks(__name__)
