"""SpotSigs fingerprints: chains of content words behind common words.

An anchor is a common word of one of four languages; its signature is the anchor with the next ``CHAIN`` content words
(words that are no anchors). A text's fingerprint is the set of its signatures, as sorted 32-bit hashes in
hexadecimal. A text without a whole chain has one signature, of all its words; a text without words has
none. Fingerprints are compared by Jaccard similarity, and by length first: sets whose lengths differ too much
cannot be similar, so similar sets lie in the same or in neighbouring length partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.batches import U64, hashed_words, mix, slices
from topicloom.llm.components import smallest_reachable
from topicloom.scale import checkpoint, ship_with_tasks

CHAIN = 2
SIMILAR = 0.8
BUCKETS_PER_TASK = 4

# The common words that serve as anchors.
ANCHORS = (
    "a an the and or of to in on for with by at from as is are was were be been that this it its not but have has had "
    "der die das den dem des ein eine einer und oder von zu im mit auf für ist sind nicht sich als auch an "
    "le la les un une du de et ou en dans pour par sur avec est sont que qui ne pas il au aux ce "
    "el los las una y o del al por con para es son no se lo como su más"
).split()


def signatures(texts: list[str | None], anchors: frozenset[str] = frozenset(ANCHORS), chain: int = CHAIN) -> np.ndarray:
    """Sorted different numbers ``text << 32 | signature`` of all texts."""
    own, offsets = hashed_words([(t or "").lower() for t in texts])
    if len(own) == 0:
        return np.zeros(0, np.int64)
    anchor = np.isin(own, hashed_words(sorted(anchors))[0])
    before = np.concatenate([[0], np.cumsum(~anchor)])  # content words before each word
    content = own[~anchor]
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(anchor)
    first, last = before[at], before[offsets[1:]][text[at]]
    whole = first + chain <= last
    at, first = at[whole], first[whole]
    sig = mix(own[at])
    for k in range(chain):
        sig = mix(sig + content[first + k])
    owner = text[at]
    bare = np.flatnonzero((np.bincount(owner, minlength=len(counts)) == 0) & (counts > 0))
    rest = [mix(_folded(own[offsets[t] : offsets[t + 1]])[None])[0] for t in bare]
    keys = (np.concatenate([owner, bare]) << 32) | (np.concatenate([sig, np.array(rest, U64)]) >> U64(32)).astype(np.int64)
    return np.unique(keys)


def _folded(words: np.ndarray) -> np.uint64:
    """One number for a sequence, depending on its order."""
    place = mix(np.arange(1, len(words) + 1, dtype=U64))
    return np.bitwise_xor.reduce(mix(words + place))


def likeness(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """Jaccard similarity of ``count`` pairs of sets, given as sorted numbers ``pair << 32 | signature``."""
    shared = np.intersect1d(left, right, assume_unique=True)
    n = [np.bincount(x >> 32, minlength=count) for x in (left, right, shared)]
    union = n[0] + n[1] - n[2]
    return np.where(union > 0, n[2] / np.maximum(union, 1), 1.0)


def hex_sets(keys: np.ndarray, count: int) -> list[str]:
    raw = (keys & 0xFFFFFFFF).astype(">u4").tobytes()
    ends = 4 * np.searchsorted(keys >> 32, np.arange(count + 1))
    return [raw[a:b].hex() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def fingerprints(documents: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and ``fingerprint`` of every whole text; null texts are empty."""
    types = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = hex_sets(signatures(part.column("text").to_pylist()), part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(made, pa.string())], names=[*keys, "fingerprint"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", fingerprint string"
    return documents.select(*keys, F.col("text").cast("string")).mapInArrow(run, schema)


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each bucket closed by the row that follows it; one row is held back for its successor."""
    held: list[tuple[int | None, str, bool]] = []
    for batch in batches:
        for part in slices(batch, "text"):
            columns = (part.column(c).to_pylist() for c in ("doc_id", "text", "closing"))
            rows = held + list(zip(*columns, strict=True))
            held = rows[-1:]
            if len(rows) > 1:
                yield _compare(rows)


def _compare(rows: list[tuple[int | None, str, bool]]) -> pa.RecordBatch:
    texts = [t or "" for _, t, _ in rows]
    n = len(rows) - 1
    edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts[:-1], texts[1:], strict=True)]
    keys = signatures(texts + edited)
    cut, last = np.searchsorted(keys, np.array([n << 32, (n + 1) << 32]))
    own, after = keys[:cut], keys[last:] - ((n + 1) << 32)
    following = keys[np.searchsorted(keys, 1 << 32) : last] - (1 << 32)
    real = [i for i, row in enumerate(rows[:-1]) if not row[2]]
    out = {
        "doc_id": pa.array([row[0] for row in rows[:-1]], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        "fingerprint": pa.array(hex_sets(own, n), pa.string()),
        "edited_fingerprint": pa.array(hex_sets(after, n), pa.string()),
        "near_edited": pa.array(likeness(own, after, n)),
        "near_next": pa.array(likeness(own, following, n)),
    }
    return pa.RecordBatch.from_pydict(out).take(pa.array(real, pa.int64()))


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are; see ``EDIT_SCHEMA``.

    The edited text has its last third replaced by the beginning of the next document, in descending order of
    id (equal ids by descending text, null ids last; the first follows the last). A document by itself
    follows itself. Ids are cut into buckets at quantiles, a bucket gets the document that follows it as its closing
    row, and tasks stream buckets in order: texts are shuffled once. Repeated rows are kept, other columns ignored.
    """
    spark = documents.sparkSession
    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = BUCKETS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = [i / count for i in range(1, count)]
    bounds = sorted(set(picked.agg(F.percentile_approx("doc_id", marks)).first()[0] or []))
    rows = picked.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")
    heads = checkpoint(rows.groupBy("bucket").agg(F.max(order).alias("head")))  # a row per bucket
    upward = Window.orderBy("bucket")
    followed = heads.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("bucket"),
        F.coalesce(F.lag("head.text").over(upward), F.last("head.text").over(upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("text"),
        F.lit(True).alias("closing"),
    )
    both = rows.withColumn("closing", F.lit(False)).unionByName(followed)
    sorted_rows = both.repartition("bucket").sortWithinPartitions("bucket", "closing", F.desc_nulls_last("doc_id"), F.desc("text"))
    return sorted_rows.mapInArrow(_compared, EDIT_SCHEMA)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the value, by halving; 0 for null."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > bounds[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))


def near_duplicates(documents: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``doc_id, fingerprint, class_id, n_links``: the smallest id among what is linked, and the other different
    fingerprints that this one is similar to.

    Equal fingerprints are one set. Sets meet if they share one of their rarest signatures (so many that similar sets
    must share one) and lie in the same or in neighbouring length partitions; whole similarities decide.
    Sets without signatures are similar to each other only.
    """
    marked = checkpoint(fingerprints(documents.select(F.col("doc_id").cast("long"), "text"), ["doc_id"]))
    sets = checkpoint(
        marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
        .withColumns({"set_id": F.xxhash64("fingerprint"), "sigs": F.regexp_extract_all("fingerprint", F.lit("[0-9a-f]{8}"), F.lit(0))})
    )
    each = sets.select("set_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    by_rarity = Window.partitionBy("set_id").orderBy("often", "sig")  # the signatures of one text
    rare = (
        each.join(often, "sig").withColumn("place", F.row_number().over(by_rarity))
        .where((F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1) & (F.col("often") > 1))
        .withColumn("part", F.floor(F.log("n") / -math.log(least)))
    )
    right = rare.select("sig", F.col("part").alias("p"), F.col("set_id").alias("b"), F.col("n").alias("m"))
    left = rare.select("sig", F.explode(F.array("part", F.col("part") - 1, F.col("part") + 1)).alias("p"), F.col("set_id").alias("a"), "n")
    met = left.join(right, ["sig", "p"]).where((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m"))).select("a", "b").distinct()
    one = sets.select(F.col("set_id").alias("a"), F.col("sigs").alias("x"))
    two = sets.select(F.col("set_id").alias("b"), F.col("sigs").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    links = checkpoint(
        met.join(one, "a").join(two, "b").where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("a", "b")
    )
    classes = smallest_reachable(links, "a", "b", "set_id")
    counted = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    named = sets.select("set_id", "fingerprint", "least").join(classes, "set_id", "left").join(counted, "set_id", "left")
    named = checkpoint(named.withColumn("class", F.coalesce("component", "set_id")))
    ids = named.groupBy("class").agg(F.min("least").alias("class_id"))
    of_set = named.join(ids, "class").select("fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return marked.join(of_set, "fingerprint").select("doc_id", "fingerprint", "class_id", "n_links")


ship_with_tasks(__name__)
