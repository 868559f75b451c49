"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits in three segments. Two that differ in at most 4 bits differ in at most 1 bit of
the first segment, or in at most 1 bit of the second, or not at all in the third: otherwise they would differ
in 2 + 2 + 1 bits. So each fingerprint looks up, in a table of segments, the Hamming ball of radius 1 around its
first two segments and the third as it is, and whole distances are verified.

Only different fingerprints are compared, copies having one row. What shares a segment value is compared in
blocks of bounded size, and a block gives back a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.batches import ascii_words, slices
from topicloom.llm.components import smallest_reachable
from topicloom.scale import checkpoint, ship_with_tasks

SEED, SHINGLE, DISTANCE = 42, 4, 4

# (first bit, bits, radius): the radii plus 1 add up to more than DISTANCE.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))

BLOCK = 1024  # rows of one side that meet in one step
FEW = 64  # fingerprints with one segment value up to which a join compares them


def fingerprints_of(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """SimHash of each text over its word shingles, as unsigned 64-bit numbers."""
    words, offsets = ascii_words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if len(words) == 0:
        return out
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.large_string()))
    joined = memoryview(pc.binary_join(whole, pa.scalar(" ", pa.large_string()))[0].as_buffer())
    counts = np.diff(offsets)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
    last = np.minimum(first + width, np.repeat(offsets[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first)
    )
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    at = 0
    for i, n in enumerate(shingles.tolist()):
        votes = np.zeros(64, np.int64)
        for start in range(at, at + n, 1 << 16):  # a very long text in steps
            part = hashes[start : min(start + (1 << 16), at + n)]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = place[2 * votes > n].sum() if n else 0
        at += n
    return out


def row_key() -> Column:
    """Equal for equal rows; id and text are hashed together."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """``key, doc_id, fp``: the fingerprint of every whole text as a signed long; null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints_of(part.column("text")).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), pa.array(fp)], names=["key", "doc_id", "fp"]
                )

    picked = documents.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "key long, doc_id long, fp long")


def _lookups(fps: DataFrame) -> DataFrame:
    """``key, fp, probe``: the table rows and the ball around them, keyed by segment number and value."""

    def part(first: int, bits: int):
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

    def key(number: int, value):
        return F.shiftleft(F.lit(number).cast("long"), 32).bitwiseOR(value)

    entries = []
    for number, (first, bits, radius) in enumerate(SEGMENTS):
        entries.append(F.struct(key(number, part(first, bits)).alias("key"), F.lit(False).alias("probe")))
        if radius:
            entries += [
                F.struct(key(number, part(first, bits).bitwiseXOR(F.lit(1 << b))).alias("key"), F.lit(True).alias("probe"))
                for b in range(bits)
            ]
    return fps.select("fp", F.inline(F.array(*entries)))


def forest(left: np.ndarray, right: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs (left, right) that differ in at most ``distance`` bits."""
    values = np.unique(np.concatenate([left, right]))
    parent = np.arange(len(values))
    a, b = np.searchsorted(values, left), np.searchsorted(values, right)
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(right ^ left[i]) <= distance)
        here = root(a[i])
        for j in b[near].tolist():
            other = root(j)
            if other != here:
                parent[other] = here
                links.append((int(values[a[i]]), int(values[j])))
    return links


def _links(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    fp, probe = group["fp"].to_numpy().view(np.uint64), group["probe"].to_numpy()
    found = forest(fp[probe], fp[~probe])
    out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that connect whatever ``DISTANCE`` connects, among different fingerprints (column ``fp``).

    Where few fingerprints share a segment value, a join compares them. Where many do, they are cut into
    blocks, and each pair of blocks is a group of its own that gives back a forest, so that no group holds more
    than about two blocks and no value emits all its pairs.
    """
    rows = _lookups(fps)
    entries = rows.where("not probe")
    held = entries.groupBy("key").agg(F.count("*").alias("entries"))
    crowded = checkpoint(held.where(F.col("entries") > FEW))
    few = rows.join(crowded, "key", "left_anti").withColumnRenamed("fp", "a")
    table = entries.select(F.col("key").alias("entry"), F.col("fp").alias("b"))
    # both ends look each other up, so one direction is enough
    pairs = few.join(table, F.expr(f"key = entry and a > b and bit_count(a ^ b) <= {DISTANCE}"))
    met = rows.join(crowded, "key")
    many = met.groupBy("key").agg(
        F.ceil(F.count_if(~F.col("probe")) / BLOCK).cast("int").alias("right"), F.ceil(F.count("*") / BLOCK).cast("int").alias("left")
    )
    met = met.join(checkpoint(many), "key").withColumn("spot", F.pmod(F.xxhash64("fp", "probe"), F.lit(1 << 30)).cast("int"))
    # every row looks up from one left block into all right blocks; entries also stand in a right block
    lefts = met.select(
        "key", F.pmod("spot", "left").alias("x"), F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("y"),
        "fp", F.lit(True).alias("probe"),
    )
    rights = met.where("not probe").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("x"), F.pmod("spot", "right").alias("y"),
        "fp", F.lit(False).alias("probe"),
    )
    blocks = lefts.unionByName(rights).groupBy("key", "x", "y").applyInPandas(_links, "a long, b long")
    return pairs.select("a", "b").union(blocks.where("a <> b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``key, doc_id, fp, component_id``: the smallest id that a document reaches over links, itself included.

    Repeated ids give repeated rows. A null id takes part in links and is never the smallest, unless there is
    no other. Texts that are null, empty or blank share the fingerprint 0, which links like any other.
    """
    marked = checkpoint(fingerprints(documents))
    fps = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = checkpoint(links(fps.select("fp")).distinct())
    classes = smallest_reachable(found, "a", "b", "fp")
    named = fps.join(classes, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class")
    )
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    return marked.join(checkpoint(named.join(least, "class").select("fp", "component_id")), "fp")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest id stays.

    Of several texts with that id, and of equal rows, one stays. Columns stay as they are.
    """
    found = near_duplicates(documents)
    chosen = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_id")
        .agg(F.min(F.struct("fp", "key")).alias("least"))
        .select(F.col("least.key").alias("_key"))
    )
    marked = documents.withColumn("_key", row_key())
    return marked.join(checkpoint(chosen), "_key", "left_semi").dropDuplicates(["_key"]).select(*documents.columns)


ship_with_tasks(__name__)
