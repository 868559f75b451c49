"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sources have weights; a target in words is shared out by weight, no source above twice its size. In a source a
document's expected copies follow its own weight, at most two, so that the copies of all documents make up the
target. Its whole copies are certain; for the rest documents are ranked by random odds divided by inclusion
odds, and taken in that order until the words that are still missing are there; the last one is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.scale import checkpoint, ordered_index

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # by place of the source, repeating
SHARE = 1.5  # of all words
MOST = 2  # copies of a source or a document
SEED = "mix-1"
SUMS = "decimal(38,0)"
WEIGHT_UNIT = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source, a null source being one).

    Sources take the weights in code point order, null last. Words above twice a source's size are shared
    again by weight among the others, round by round, until no source is above.
    """
    placed = ordered_index(sources, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    open_ones = checkpoint(placed.select("source", "source_size", weight.cast("double").alias("weight")))
    total = open_ones.agg(F.sum(F.col("source_size").cast(SUMS))).first()[0] or 0
    full, level = F.lit(False), 0.0
    while True:
        # the full sources stay full: the level only rises
        spent, weight_left = open_ones.agg(
            F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0).cast(SUMS)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not weight_left:
            break
        level = (share * float(total) - float(spent)) / weight_left
        over = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        if not open_ones.where(over & ~full).limit(1).count():
            break
        full = full | over
    target = F.when(full, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return open_ones.select("source", "source_size", target.alias("target"))


def expected_copies(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``copies``: weight times the level of the source, at most ``MOST``, adding up to the source's target."""
    level = sources.where("source_size > 0").select("source", "target", F.lit(0.0).alias("level"))
    reached = F.col("weight") * F.col("level")
    joined = documents.where("size > 0").join(F.broadcast(level) if _few(level) else level, documents.source.eqNullSafe(level.source), "left").drop(level.source)
    while True:
        sums = joined.withColumn("full", reached >= MOST).groupBy("source").agg(
            F.first("target").alias("target"),
            F.max("level").alias("before"),
            F.sum(F.when(F.col("full"), MOST * F.col("size")).otherwise(0).cast(SUMS)).alias("spent"),
            F.sum(F.when(F.col("full"), 0).otherwise(F.col("size") * F.round(F.col("weight") * WEIGHT_UNIT).cast("long")).cast(SUMS)).alias("left"),
        )
        left = F.col("left").cast("double") / WEIGHT_UNIT
        raised = F.when(left > 0, (F.col("target") - F.col("spent").cast("double")) / left).otherwise(F.col("before"))
        level = checkpoint(sums.select("source", "target", "before", F.greatest(raised, "before").alias("level")))
        joined = documents.where("size > 0").join(F.broadcast(level) if _few(level) else level, documents.source.eqNullSafe(level.source), "left").drop(level.source)
        if not level.where("level > before * (1 + 1e-9)").limit(1).count():
            break
    return joined.select(*documents.columns, F.least(F.lit(float(MOST)), reached).alias("copies"))


def _few(sources: DataFrame) -> bool:
    from topicloom.scale import SMALL_ROWS, count_within

    return count_within(sources, SMALL_ROWS) is not None


def running_sum(df: DataFrame, keys: list[str], order_by: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to this one; a hot key is summed by many tasks."""
    sorted_parts = df.repartitionByRange(*keys, *order_by).withColumn("_part", F.spark_partition_id())
    placed = checkpoint(sorted_parts)
    sums = placed.groupBy("_part", *keys).agg(F.sum(F.col(value).cast(SUMS)).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offsets = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_within", F.sum(F.col(value).cast(SUMS)).over(within))
    same = own["_part"] == offsets["_part"]
    for k in keys:
        same = same & own[k].eqNullSafe(offsets[k])
    joined = own.join(offsets, same, "left").select(*(own[c] for c in df.columns), (own["_within"] + offsets["_before"]).alias(name))
    return joined


def uniform(seed: str) -> Column:
    """A number in (0, 1) from the document's id, size and the seed; the same in every run."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    digits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 48))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of which something is taken, with ``size, source_size, target, taken, copies``.

    Equal rows become one row with the words taken of all of them. Columns named like the added ones are replaced.
    """
    added = ["size", "source_size", "target", "taken", "copies"]
    marked = documents.drop(*added).withColumn("_key", row_key())
    found = mix(documents, **options).groupBy(F.col("key").alias("_key")).agg(
        *(F.first(c).alias(c) for c in added[:3]), F.sum("taken").alias("taken"), F.sum("copies").alias("copies")
    )
    return marked.dropDuplicates(["_key"]).join(found.where("taken > 0"), "_key").drop("_key")


def row_key() -> Column:
    """Equal for equal rows; id, source and text are hashed together."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def mix(documents: DataFrame, weight: Column | None = None, weights: Sequence[int] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """``key, doc_id, source, size, source_size, target, taken`` and ``copies``, the copies expected of the document.

    ``weight`` is a positive expression over ``size``; without it longer documents weigh a little less, so that a few
    long ones are not repeated most. Null and blank texts have size 0 and nothing of them is taken. Rows with
    the same id are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    own = F.lit(1.0) / F.log(F.col("size") + F.lit(20.0)) if weight is None else weight
    sized = checkpoint(
        documents.select(
            row_key().alias("key"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size"),
        )
    ).withColumn("weight", own.cast("double"))
    sources = checkpoint(targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share))
    spread = expected_copies(sized, sources)
    whole = F.floor("copies").cast("long")
    chance = F.col("copies") - F.floor("copies")
    u = uniform(seed)
    rank = F.when(chance > 0, (u / (1 - u)) / (chance / (1 - chance))).otherwise(F.lit(float("inf")))
    ranked = running_sum(
        spread.select("key", "doc_id", "source", "size", "copies", whole.alias("whole"), rank.alias("rank")),
        ["source"], ["rank", "doc_id", "size", "key"], "size", "upto",
    )
    certain = spread.groupBy("source").agg(F.sum((whole * F.col("size")).cast(SUMS)).alias("certain"))
    known = sources.join(certain, sources.source.eqNullSafe(certain.source), "left").select(
        sources.source.alias("_source"), "source_size", "target",
        F.greatest(F.lit(0), F.round("target").cast(SUMS) - F.coalesce("certain", F.lit(0).cast(SUMS))).alias("missing"),
    )
    known = checkpoint(known)
    picked = ranked.join(F.broadcast(known) if _few(known) else known, ranked.source.eqNullSafe(F.col("_source")), "left")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("missing") - (F.col("upto") - F.col("size")))).cast("long")
    extra = F.when(F.col("copies") >= MOST, F.lit(0)).otherwise(extra)
    out = picked.select("key", "doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), "copies")
    blank = sized.where("size = 0")
    blank = blank.join(F.broadcast(known) if _few(known) else known, blank.source.eqNullSafe(F.col("_source")), "left").select(
        "key", "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0.0).alias("copies")
    )
    return out.unionByName(blank)
