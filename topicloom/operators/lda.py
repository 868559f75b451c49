"""Topics of a token corpus ``(corpus_id, tokens)``: dictionary, training, tables of the result.

Training is zero-order collapsed variational Bayes on tables, at every size: a topic vector per document and one per
term are rows. The word counts lie in a grid, blocks of documents by blocks of terms, dealt out once. In an iteration a
vector travels once to each cell that has words of its document or term, never once per word, and a cell gives back one
row of sums per document, then per term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.scale import checkpoint, checkpoint_by, drop_step, ordered_index, ship_with_tasks

ship_with_tasks(__name__)

# Topics, iterations, document smoothing 50 / k, term smoothing, least uses of a term, iterations
# between two measurements, one document in so many that is measured.
TOPICS, ITERATIONS, DOC_SMOOTHING, TERM_SMOOTHING, MIN_USES = 300, 1000, 50.0, 0.1, 2
MEASURE_EVERY, MEASURED = 10, 10
# Bytes of vectors of one kind and word rows that meet in a cell, on average, and word rows that a task works on at a time.
CELL_BYTES, CELL_WORDS, CHUNK_ROWS = 20 << 20, 1 << 21, 16_384
MEASURES = "iteration int, words double, log_perplexity double"


def dictionary(corpus: DataFrame, min_uses: int = MIN_USES) -> DataFrame:
    """``(term, term_id)``: terms used at least twice in all, in name order."""
    uses = corpus.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("uses"))
    return ordered_index(uses.filter(F.col("uses") >= min_uses).select("term"), ["term"], "term_id")


def term_counts(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """``(corpus_id, term_id, n)``: the term frequency vectors as a table."""
    words = corpus.select("corpus_id", F.explode("tokens").alias("term")).groupBy("corpus_id", "term").agg(F.count("*").alias("n"))
    return words.join(terms, "term").select("corpus_id", "term_id", "n")


def row_ids(corpus: DataFrame) -> DataFrame:
    """``(corpus_id, row_id)``: dense row numbers in id order."""
    return ordered_index(corpus.select("corpus_id"), ["corpus_id"], "row_id")


def draw(of: Column, span: int) -> Column:
    """A number from 0 to span - 1 that depends on a string only, the same in every engine with MD5."""
    return F.conv(F.substring(F.md5(of), 1, 7), 16, 10).cast("long") % span


@dataclass(frozen=True)
class Grid:
    """``words(cell, corpus_id, term_id, n, tested)`` bucketed by cell, and which cells each document and term has words in."""

    words: DataFrame
    cells_of: dict[str, DataFrame]  # of corpus_id and of term_id: (id, cell)
    count: int


def cells_for(topics: int, documents: int, terms: int, words: int, cores: int) -> tuple[int, int]:
    """Blocks of documents and of terms, so that a cell holds a bounded number of bytes of vectors and of word rows.

    A block is a number of bytes and not of vectors: every cell costs a task in every step, and vectors of few topics are short.
    """
    vectors = max(1, CELL_BYTES // (8 * topics))
    term_blocks = max(1, -(-terms // vectors))
    doc_blocks = max(1, -(-documents // vectors), -(-words // (CELL_WORDS * term_blocks)), min(cores, documents // 256))
    return doc_blocks, term_blocks


def grid(counts: DataFrame, topics: int, documents: int, terms: int) -> Grid:
    """Deal the word counts into blocks of documents x blocks of terms, see :func:`cells_for`."""
    cores = counts.sparkSession.sparkContext.defaultParallelism
    doc_blocks, term_blocks = cells_for(topics, documents, terms, counts.count(), cores)
    block = {k: F.pmod(F.xxhash64(k), F.lit(n)) for k, n in (("corpus_id", doc_blocks), ("term_id", term_blocks))}
    cell = (block["corpus_id"] * term_blocks + block["term_id"]).cast("int").alias("cell")
    tested = draw(F.col("corpus_id").cast("string"), MEASURED) == 0
    words = checkpoint_by(
        counts.select(cell, "corpus_id", "term_id", F.col("n").cast("double").alias("n"), tested.alias("tested")), "cell", doc_blocks * term_blocks
    )
    cells_of = {k: checkpoint(words.select(F.col(k).alias("id"), "cell").distinct()) for k in block}
    return Grid(words, cells_of, doc_blocks * term_blocks)


def _vectors(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of the documents (0) or terms (1) of a cell, and their vectors."""
    mine = table.filter(pa.compute.equal(table["kind"], kind)).sort_by("id")
    flat = mine["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return mine["id"].to_numpy(), flat.reshape(mine.num_rows, -1)


def _chunks(words: pa.Table, vectors: pa.Table, columns: list[str]):
    """Runs of a cell's words: places of document and term among the cell's vectors, and the given columns."""
    (docs, doc_v), (terms, term_v) = _vectors(vectors, 0), _vectors(vectors, 1)
    at = [np.searchsorted(ids, words[c].to_numpy()) for ids, c in ((docs, "corpus_id"), (terms, "term_id"))]
    held = [words[c].to_numpy() for c in columns]
    for start in range(0, words.num_rows, CHUNK_ROWS):
        part = slice(start, start + CHUNK_ROWS)
        yield docs, doc_v, at[0][part], terms, term_v, at[1][part], *(h[part] for h in held)


def _shares(key: str, total: np.ndarray, alpha: float, eta: float, n_terms: int):
    """Task that gives each word's count to the topics and sums over the cell by ``key``."""

    def task(words: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, sums = np.zeros(0, np.int64), np.zeros((0, len(total)))
        for docs, doc_v, d, terms, term_v, t, n in _chunks(words, vectors, ["n"]):
            if not len(ids):
                ids = docs if key == "corpus_id" else terms
                sums = np.zeros((len(ids), len(total)))
            share = (doc_v[d] + alpha) * (term_v[t] + eta) / (total + eta * n_terms)
            share *= (n / share.sum(1))[:, None]
            place = d if key == "corpus_id" else t
            order = np.argsort(place, kind="stable")
            found, starts = np.unique(place[order], return_index=True)
            sums[found] += np.add.reduceat(share[order], starts, axis=0)
        listed = pa.FixedSizeListArray.from_arrays(sums.ravel(), len(total)).cast(pa.list_(pa.float64()))
        return pa.table({"id": pa.array(ids, pa.int64()), "s": listed})

    return task


def _likelihood(total: np.ndarray, eta: float, n_terms: int):
    """Task that sums words of tested documents and their logarithmic likelihood."""

    def task(words: pa.Table, vectors: pa.Table) -> pa.Table:
        count, logs = 0.0, 0.0
        for _, doc_v, d, _, term_v, t, n, tested in _chunks(words, vectors, ["n", "tested"]):
            d, t, n = d[tested], t[tested], n[tested]
            count += n.sum()
            logs += (n * np.log((doc_v[d] * (term_v[t] + eta) / (total + eta * n_terms)).sum(1))).sum()
        return pa.table({"words": [count], "logs": [logs]})

    return task


def _meet(cells: Grid, by_doc: DataFrame, by_term: DataFrame, task, schema: str) -> DataFrame:
    """Run ``task(words, vectors)`` on every cell. Only vectors move."""
    sent = [
        vectors.select(F.col(key).alias("id"), "v").join(cells.cells_of[key], "id").select("cell", F.lit(kind).alias("kind"), "id", "v")
        for kind, (key, vectors) in enumerate((("corpus_id", by_doc), ("term_id", by_term)))
    ]
    return cells.words.groupBy("cell").cogroup(sent[0].unionByName(sent[1]).groupBy("cell")).applyInArrow(task, schema)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of equal ids, which come one after the other; the last id of a batch may go on in the next."""

    def told(ids: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        listed = pa.FixedSizeListArray.from_arrays(sums.ravel(), sums.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), listed], names=["id", "v"])

    held: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        ids = ids[starts]
        sums = np.add.reduceat(batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), starts, axis=0)
        if held is not None and held[0][0] == ids[0]:
            sums[0] += held[1][0]
        elif held is not None:
            yield told(*held)
        if len(ids) > 1:
            yield told(ids[:-1], sums[:-1])
        held = ids[-1:], sums[-1:]
    if held is not None:
        yield told(*held)


def _summed(partial: DataFrame, key: str) -> DataFrame:
    """One row per id; equal ids are sorted by their values, so that sums do not depend on how rows arrive."""
    dealt = partial.repartition("id").sortWithinPartitions("id", "s")
    return dealt.mapInArrow(_added_up, "id long, v array<double>").select(F.col("id").alias(key), "v")


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y))


def train(
    corpus: DataFrame,
    topics: int = TOPICS,
    iterations: int = ITERATIONS,
    seed: int = 42,
    measure_every: int = MEASURE_EVERY,
    doc_smoothing: float = DOC_SMOOTHING,
) -> dict[str, DataFrame]:
    """``topic_terms``, ``doc_topics``, ``points`` and ``perplexity`` of a corpus.

    Terms start from numbers drawn for (term, topic, seed), documents with equal topics; a document without terms of
    the dictionary keeps equal topics. Only the topic totals pass through the driver. The vector of a frequent term goes to every
    block of documents once, whatever the number of its words. Every ``measure_every`` iterations the
    perplexity of a tenth of the documents is taken with the model as it is; no model is trained twice.
    """
    alpha, eta = doc_smoothing / topics, TERM_SMOOTHING
    terms = checkpoint(dictionary(corpus))
    counts = checkpoint(term_counts(corpus, terms))
    n_terms = terms.count()
    at = F.sequence(F.lit(0), F.lit(topics - 1))
    span = 1 << 28
    start = F.transform(at, lambda t: (draw(F.concat_ws(":", "term", t.cast("string"), F.lit(str(seed))), span) + 1) / float(span))
    by_term = checkpoint(terms.select("term_id", start.alias("v")))
    equal = F.transform(at, lambda t: F.lit(1.0 / topics))
    documents = checkpoint(corpus.select("corpus_id").distinct())
    by_doc = checkpoint(documents.withColumn("v", equal))

    def totals() -> np.ndarray:
        found = by_term.agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("t")).first()["t"] if n_terms else None
        return np.array(found if found is not None else np.ones(topics))

    cells = grid(counts, topics, documents.count(), n_terms)
    sums = "id long, s array<double>"
    measured = []
    total = totals()
    for step in range(1, iterations + 1):
        old = by_doc, by_term
        shares = _meet(cells, by_doc, by_term, _shares("corpus_id", total, alpha, eta, n_terms), sums)
        summed = _summed(shares, "corpus_id").withColumn("v", _unit(F.col("v")))
        by_doc = checkpoint(documents.join(summed, "corpus_id", "left").withColumn("v", F.coalesce("v", equal)))
        by_term = checkpoint(_summed(_meet(cells, by_doc, by_term, _shares("term_id", total, alpha, eta, n_terms), sums), "term_id"))
        for table in old:
            drop_step(table)
        total = totals()
        if measure_every and step % measure_every == 0:
            likely = _meet(cells, by_doc, by_term, _likelihood(total, eta, n_terms), "words double, logs double")
            seen, logs = likely.agg(F.sum("words"), F.sum("logs")).first()
            if seen:
                measured.append((step, float(seen), -float(logs) / float(seen)))
    norm = F.array(*[F.lit(float(t)) for t in total])
    weights = by_term.join(terms, "term_id").select("term", F.posexplode(F.zip_with("v", norm, lambda a, b: a / b)).alias("topic", "p"))
    return {
        "topic_terms": weights.select("topic", "term", "p"),
        "doc_topics": by_doc.select("corpus_id", F.posexplode("v").alias("topic", "p")),
        "points": by_doc.select(F.col("corpus_id").alias("point"), "v"),
        "perplexity": corpus.sparkSession.createDataFrame(measured, MEASURES),
    }
