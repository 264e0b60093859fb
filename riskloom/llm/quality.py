"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed byte trigrams of the lower-cased text, hashed trigrams of its
shape (letters, capitals, digits and spaces as classes, punctuation as it is)
and two counts of repeated words. Weights are term counts times inverse document
frequency over all documents; a truncated SVD of a bounded sample of labelled
texts gives the latent space. The labelled vectors, of bounded number, go to all
tasks, where each document's cosines with all of them are computed in blocks;
its nearest labels vote with their similarities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import packed
from ._text import LOWER, NOT_SPACE, WordHash, flat, slices, words

#: Labelled rows that are learned, half of each label where there are enough: the bound of the sample.
SAMPLE_ROWS = 2_048
DIMENSIONS = 64
NEIGHBOURS = 15
TRIGRAM_CELLS = 1_024
TERMS = 2 * TRIGRAM_CELLS + 2
#: Texts whose dense term rows are held at once.
BLOCK_ROWS = 512
WORD_HASH = WordHash(9)

SHAPE = np.full(256, ord("a"), np.uint8)
SHAPE[:128] = np.arange(128)
SHAPE[0x41:0x5B], SHAPE[0x61:0x7B], SHAPE[0x30:0x3A] = ord("A"), ord("a"), ord("0")
SHAPE[[9, 11, 12, 13]] = ord(" ")


def term_counts(column: pa.Array) -> np.ndarray:
    """One row of term counts for each text (null: no terms)."""
    data, offs = flat(column)
    n, out = len(column), np.zeros((len(column), TERMS), np.float32)
    if not len(data):
        return out
    owner = np.repeat(np.arange(n), np.diff(offs))
    whole = owner[:-2] == owner[2:]
    row = owner[:-2][whole] * TRIGRAM_CELLS
    for k, view in enumerate((LOWER[data], SHAPE[data])):
        c = view.astype(np.uint32)
        h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        cell = row + (h[whole] % np.uint32(TRIGRAM_CELLS))
        out[:, k * TRIGRAM_CELLS:(k + 1) * TRIGRAM_CELLS] = np.bincount(cell, minlength=n * TRIGRAM_CELLS).reshape(n, TRIGRAM_CELLS)
    begin, end, first = words(data, offs, NOT_SPACE)
    h, owner = WORD_HASH(LOWER[data], begin, end), np.repeat(np.arange(n), np.diff(first))
    out[:, -2] = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n)  # a word again at once
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    out[:, -1] = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n)  # a word again anywhere
    return out


def _blocks(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            for a in range(0, part.num_rows, BLOCK_ROWS):
                block = part.slice(a, BLOCK_ROWS)
                yield block, term_counts(block.column("text"))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def document_frequency(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term: over all rows."""

    def run(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for block, counts in _blocks(batches):
            total += (counts > 0).sum(0)
            n += block.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS), pa.int32()), pa.array(np.append(n, total), pa.int64())], ["term", "n"])

    got = {r[0]: r[1] for r in texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect()}  # one row for each term
    return got.get(-1, 0), np.array([got.get(t, 0) for t in range(TERMS)], np.int64)


#: Unit vectors are rounded to multiples of 1 / GRID: sums of their products stay whole numbers under 2 ** 53, alike in any order.
GRID = 1 << 25
#: Texts whose votes are counted at once.
VOTE_ROWS = 64
#: Cosines are rounded to multiples of 1 / COSINES.
COSINES = 1 << 30


def on_grid(rows: np.ndarray) -> np.ndarray:
    return np.rint(rows.astype(np.float64) * GRID)


class Votes:
    """Labelled latent vectors, in the order of their ids, and the vote of those nearest to a text.

    A text's score depends on nothing but the text: not on the others of its
    block. Of equal cosines the smaller id is nearer.
    """

    def __init__(self, counts: np.ndarray, labels: np.ndarray, documents: int, frequency: np.ndarray, prior: float):
        self.idf = (np.log((1 + documents) / (1 + frequency)) + 1).astype(np.float32)
        weighted = unit(counts * self.idf)
        self.axes = np.linalg.svd(weighted, full_matrices=False)[2][:DIMENSIONS].T.astype(np.float32) if len(counts) else np.zeros((TERMS, 1), np.float32)
        self.vectors, self.labels, self.prior = self.latent(counts).astype(np.float32), labels.astype(np.float32), prior

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of texts in the latent space."""
        return unit(on_grid(unit(counts * self.idf)) @ on_grid(self.axes))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        return np.concatenate([self._vote(counts[a:a + VOTE_ROWS]) for a in range(0, max(1, len(counts)), VOTE_ROWS)])

    def _vote(self, counts: np.ndarray) -> np.ndarray:
        cosine = np.rint(on_grid(self.latent(counts)) @ on_grid(self.vectors).T * (COSINES / GRID / GRID))
        n = len(self.labels)
        k = min(NEIGHBOURS, n)
        near = np.argpartition(np.arange(n) - cosine * n, k - 1, axis=1)[:, :k]  # no two are equal
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0)
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, vote, self.prior), 0, 1)


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Votes:
    """Learns from at most SAMPLE_ROWS labelled rows that are not held out, and from the term statistics of all docs.

    The sample takes the rows of least id hash of each label. Rows without an
    id or a label teach nothing; an id with several labels has the largest, one
    with several texts the least of their term counts, as bytes. No
    usable label: every score is 0.5.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)") \
        .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    usable = usable.join(texts.select("id").distinct(), "id", "left_semi")
    share = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    prior = share.get(1, 0) / sum(share.values()) if share else 0.5
    quota = {c: min(share.get(c, 0), max(SAMPLE_ROWS // 2, SAMPLE_ROWS - share.get(1 - c, 0))) for c in (0, 1)}
    picked = [(r[0], c) for c in (0, 1) for r in usable.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(quota[c]).select("id").collect()]
    sample = F.broadcast(spark.createDataFrame(picked, "id long, label int"))  # SAMPLE_ROWS rows at most

    def run(batches):
        for block, counts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("label"), pa.array([r.tobytes() for r in counts], pa.binary())], ["id", "label", "counts"])

    rows = sorted((r[0], r[1], bytes(r[2])) for r in texts.join(sample, "id").mapInArrow(run, "id long, label int, counts binary")
                  .groupBy("id", "label").agg(F.min("counts").alias("counts")).collect())
    documents, frequency = document_frequency(texts.select("text"))
    counts = np.stack([np.frombuffer(r[2], np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    return Votes(counts, np.array([r[1] for r in rows], np.int64), documents, frequency, prior)


def score(docs: DataFrame, votes: Votes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the other columns), id, text, score of every whole text, from 0 to 1.

    A text without terms (null, empty, under three bytes) or without any similar
    label has the share of label 1 among the labels. Equal texts score exactly
    alike, however the rows are dealt. Rows come out once each, repeated ones too;
    no row moves.
    """
    rows = packed(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(votes)

    def run(batches):
        for block, counts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("row"), block.column("id"), block.column("text"), pa.array(shared.value(counts), pa.float64())], ["row", "id", "text", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
