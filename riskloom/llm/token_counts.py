"""Token counts through a digest cache.

Texts are keyed by a digest of their normalised content, and counts are stored
under that key and the tokenizer's version digest. A run joins its keys to the
cache, encodes one text of each missing key, and appends the counts.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import fresh_path, lookup, text_digest, written
from ._text import slices

CACHE_SCHEMA = "key binary, tokenizer string, n_tokens long"
#: Distinct words whose counts a Python worker remembers, in each of two generations.
WORDS_KEPT = 300_000


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def one_space(text: Column) -> Column:
    """Normalised content for tokenizers that read any run of white space as one space."""
    return F.regexp_replace(text, "[ \\t\\n\\r]+", " ")


def as_is(text: Column) -> Column:
    return text


def normaliser(path: str) -> Callable[[Column], Column]:
    """The content normaliser that leaves this tokenizer's counts alone."""
    steps = json.load(open(path, encoding="utf-8")).get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    return one_space if any(s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps) else as_is


class Counter:
    """Counts tokens as the tokenizers library does, without special tokens added.

    Where the tokenizer cuts texts by a removing pattern, merges never cross
    words, so a text's count is the sum over its words, and a word already met
    is not encoded again. The words are cut here only in texts whose characters
    all classify alike everywhere (printable ASCII and Latin letters); any other
    text, and any text with a special string, goes to the library as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        norms = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        by_word = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and norms == ["NFC", "Replace", "Lowercase"]
        self.cut = regex.compile(cut["pattern"]["Regex"]).findall if by_word else None
        self.plain = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*").fullmatch
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.new, self.old = {}, {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        out, at, cuts = [0] * len(texts), [], []
        other = []
        for i, text in enumerate(texts):
            if self.cut and self.plain(text) and not any(s in text for s in self.special):
                at.append(i)
                cuts.append(self.cut(text.lower()))
            else:
                other.append(i)
        for i, n in zip(other, self.whole([texts[i] for i in other])):
            out[i] = n
        unseen = set().union(*cuts).difference(self.new) if cuts else set()
        self.new |= {w: self.old[w] for w in unseen if w in self.old}
        ask = [w for w in unseen if w not in self.old]
        self.new.update(zip(ask, self.whole(ask)))
        for i, ws in zip(at, cuts):
            out[i] = sum(map(self.new.__getitem__, ws))
        if len(self.new) > WORDS_KEPT:
            self.new, self.old = {}, self.new
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, normalise: Callable[[Column], Column] | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row (null text: empty, 0 bytes).

    cache_path names the cache to use and extend, by default a new one; several
    runs and tokenizers may share it. normalise must leave counts unchanged
    (default: by the tokenizer's own normaliser). The file at tokenizer_path
    must be there on every executor. Repeated rows and null ids are kept, one
    row out for each row in. Appends are one committed write; if a job repeats
    after a loss, equal entries may be stored twice and count once. Other
    columns are not read.
    """
    spark = docs.sparkSession
    version, normalise = tokenizer_version(tokenizer_path), normalise or normaliser(tokenizer_path)
    cache_path = cache_path or fresh_path(spark, "token-counts")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def cached() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        return rows.where(F.col("tokenizer") == version).groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.withColumn("key", text_digest(normalise(F.col("text"))))
    rows = written(keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    missing = keys.join(cached(), "key", "left_anti")
    # one row holds each missing key; the join is by id, so that no key's copies meet in one task
    pick = missing.select(F.col("key").alias("k"), F.col("doc_id").alias("i"))
    todo = keyed.join(pick, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi").select("key", "text")

    def encode(batches):
        count = counter(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["key", "tokenizer", "n_tokens"])

    todo.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return lookup(rows, cached(), "key", keys.select("key", "n")).select("doc_id", "n_bytes", "n_tokens")
