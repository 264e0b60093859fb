"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

1. quality: documents that the nearest-neighbour classifier rejects go;
2. line_dedup: lines of 10 code points or more that several documents hold stay
   only in the document of smallest id (a document whose lines all go stays, with
   an empty text); n_chars follows the text;
3. near_dedup: one document of each SimHash group stays, that of smallest id;
4. decontaminate: documents with a ten-word window of a benchmark item go;
5. bpe: each text is encoded and decoded: doc_id, n_tokens, ids_sha256,
   decoded_sha256.

All but the last return the columns of documents. Null texts pass the stages as
texts without lines, words or tokens; null ids count as the least id; an empty
table gives an empty table. Other columns are carried along unread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from riskloom.llm._tables import unpacked, written
from riskloom.session import run_folder

#: A kept document's score at least.
GOOD = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of the labelled ones score GOOD or better; an empty text scores as the share of good labels."""
    votes = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(quality.score(docs, votes).where(F.col("score") >= GOOD), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a document of smaller id holds; a null text stays null, n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of least id, then least text; texts without words are one component."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; null and empty texts stay."""
    found = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(found.where("n_hit = 0"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text has no tokens."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Votes, SimHash's XXH64 and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i + 1 < len(STAGES):
            rows = written(rows, f"pipeline-{name}")
    return rows


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """run(), written as Parquet to path; the tables between the stages are deleted when it is done."""
    with run_folder(spark):
        run(spark, sf_dir).write.parquet(path)
