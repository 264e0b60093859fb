"""Small tables with every awkward case, and brute-force helpers."""

import re

from pyspark.sql import types as T

SPACES = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SENTENCE = "the quick brown fox jumps over a lazy dog while seven green birds sing in the old garden near the river"
ROWS = [
    (1, "First line of text here\n" + SENTENCE + "\nlast line of the first one"),
    (2, SENTENCE + "\nAnother line that is mine alone\n  LAST line OF the first one\t"),
    (3, SENTENCE + "\nAnother line that is mine alone\n  LAST line OF the first one\t"),
    (3, SENTENCE + "\nAnother line that is mine alone\n  LAST line OF the first one\t"),  # a repeated row
    (4, ""), (5, None), (6, " \t\n\x0b "), (None, SENTENCE), (None, None),
    (7, "one"), (8, "short\nshort\nshort"), (9, "x"), (10, "Één zin met ÀÉÎ en tekens: €uro 日本語 <|endoftext|> 𝒳"),
    (11, "word " * 3000 + SENTENCE), (12, ("ab" * 40 + " ") * 50), (-5, SENTENCE + " ending in another way"), (13, "\n\n\n"), (14, "y" * 5000),
]
#: Names that the operators use themselves.
CLASHES = ["id", "row", "key", "shard", "slot", "batch", "hits", "items", "n_words", "score", "fp", "n_tokens", "bytes", "doc", "drops", "at", "before", "label", "n", "Text_"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in CLASHES]])


def odd_docs(spark, rows=None):
    return spark.createDataFrame([(i, t, None, "src", None if t is None else len(t), *range(len(CLASHES))) for i, t in (ROWS if rows is None else rows)], SCHEMA).repartition(3)


def plain_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(text):
    return re.findall(SPACES, text or "")


def read(sf_dir, name):
    import pyarrow.parquet as pq
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pandas()


def order(i):
    """Null ids come first."""
    return (i is not None, i or 0)
