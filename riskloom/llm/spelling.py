"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, so that words one edit apart have reduced
words at most one edit apart. Every distinct reduced word generates its full
one-edit neighbourhood as 64-bit keys (a polynomial of the symbols, so each
neighbour costs the same at any length); those are joined with the reduced
vocabulary, and the words behind both ends are verified on their own letters.
Reduced words that many words share are too coarse: their words take a second,
finer alphabet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import written
from ._text import mix, spread

#: Symbols of the two alphabets; a reduced word of more words than HOT_WORDS goes to the finer one.
COARSE, FINE = 8, 32
HOT_WORDS = 1000
#: Neighbours made at once.
BATCH_KEYS = 1 << 20
#: An odd base of the polynomials, its inverse modulo 2**64, and a factor for lengths.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LENGTH = 0xD6E8FEB86659FD93
#: Seeds the coarse hash of letters such that frequent ones fall on different symbols.
LETTER_SEED = 742 << 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that count as words, before lower-casing (a fixed value).
RUN_PATTERN = "[A-Za-zÀ-ÿ]+"


def count_words(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, least_length: int = 6, least_count: int = 5,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of all whole texts, A-Z lower-cased, with their number of occurrences.

    change(id, run) replaces each lower-cased run (it may drop code points, one at most,
    but adds none). Words of fewer than least_length code points or
    least_count occurrences are left out. Null and empty texts have no words;
    repeated rows count each time; null ids reach change as null. Other columns are not read.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN_PATTERN), F.lit(0))).alias("run"))
    # before the costlier steps; a run that change makes longer isn't foreseen
    runs = runs.where(F.length("run") >= least_length).withColumn("run", F.translate("run", UPPER, LOWER))
    words = runs.select((change(F.col("id"), F.col("run")) if change else F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def drop_letter(every: int) -> Callable[[Column, Column], Column]:
    """A change for count_words: where ``every`` divides the CRC-32 h of "id:run", the code point at h modulo the length goes (null id: no text before the colon)."""
    def change(id_: Column, run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = F.pmod(h, F.length(run).cast("long")).cast("int")
        cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)

    return change


def symbols(code_points: np.ndarray, alphabet: int) -> np.ndarray:
    """The symbol of each code point; the finer alphabet keeps the letters a to z apart."""
    if alphabet == FINE:
        return (code_points % FINE).astype(np.uint64)
    return mix(code_points.astype(np.uint64) + np.uint64(LETTER_SEED)) % np.uint64(alphabet)


def reduced(words: list[str], alphabet: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the words of each length: their places in the list, and their symbols as a matrix."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = symbols(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), alphabet)
    start = np.cumsum(size) - size
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[spread(start[at], size[at])].reshape(len(at), n)


def keys(s: np.ndarray) -> np.ndarray:
    """A key of each reduced word."""
    n = s.shape[1]
    return mix(((s + np.uint64(1)) * _powers(n)[:n][::-1]).sum(1, dtype=np.uint64) + _length(n))


def neighbours(s: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every reduced word at most one edit from each row's, each once."""
    m, n = s.shape
    value, power = s + np.uint64(1), _powers(n + 1)
    term = value * power[:n][::-1]
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
    total, after = before[:, -1], before[:, -1:] - before
    rows, found = [np.arange(m)], [total + _length(n)]

    def add(keep: np.ndarray, key: np.ndarray, length: int) -> None:
        rows.append(np.flatnonzero(keep) // keep.shape[1])
        found.append(key[keep] + _length(length))

    if n:
        # of a run of one symbol, any one deleted leaves the same word
        first = np.concatenate([np.ones((m, 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
        add(first, before[:, :-1] * np.uint64(INVERSE) + after[:, 1:], n - 1)
    for x in map(np.uint64, range(alphabet)):
        if n:
            add(s != x, total[:, None] + (x - s) * power[:n][::-1], n)
        # a symbol put before an equal one is the same as put behind it
        place = np.concatenate([s != x, np.ones((m, 1), bool)], axis=1)
        add(place, before * np.uint64(BASE) + (x + np.uint64(1)) * power[:n + 1][::-1] + after, n + 1)
    return np.concatenate(rows), mix(np.concatenate(found))


def _length(n: int) -> np.uint64:
    return np.uint64(n * LENGTH % (1 << 64))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)


def _keyed(words: DataFrame, alphabet: int) -> DataFrame:
    """word, n and the key of the word's reduced form."""
    def run(batches):
        for batch in batches:
            listed = batch.column("word").to_pylist()
            key = np.zeros(len(listed), np.uint64)
            for at, s in reduced(listed, alphabet):
                key[at] = keys(s)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(key.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def _neighbourhoods(forms: DataFrame, alphabet: int, half: bool) -> DataFrame:
    """key, near: the keys at most one edit from each reduced form (key, word: any word that has the form).

    half: only near >= key, as being near is mutual.
    """
    def run(batches):
        for batch in batches:
            own = batch.column("key").to_numpy()
            for at, s in reduced(batch.column("word").to_pylist(), alphabet):
                step = max(1, BATCH_KEYS // ((2 * alphabet + 1) * (s.shape[1] + 1)))
                for i in range(0, len(at), step):
                    row, near = neighbours(s[i:i + step], alphabet)
                    key, near = own[at[i:i + step]][row], near.view(np.int64)
                    keep = near >= key if half else slice(None)
                    yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(near[keep])], ["key", "near"])

    return forms.select("key", "word").mapInArrow(run, "key long, near long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words (word, n) exactly one inserted, deleted or replaced code point apart, once.

    Words must be distinct, without null. Where a reduced word stands for more
    than HOT_WORDS words, theirs meet all others over the finer alphabet.
    """
    words = written(_keyed(words, COARSE), "spelling-words")
    forms = words.groupBy("key").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("size"))
    hot = written(forms.where(F.col("size") > HOT_WORDS).select("key"), "spelling-hot")
    few = forms.join(hot, "key", "left_anti")
    edges = _neighbourhoods(few, COARSE, True).join(few.select(F.col("key").alias("near")), "near")
    one_edit = F.levenshtein("a", "b", 1) == 1
    pairs = _joined(edges, words, one_edit & ((F.col("key") != F.col("near")) | (F.col("a") < F.col("b"))))
    if hot.isEmpty():
        return pairs
    fine = written(_keyed(words, FINE).join(words.join(hot, "key", "left_semi").select("word", F.lit(True).alias("hot")), "word", "left"), "spelling-fine")
    forms = fine.where("hot").groupBy("key").agg(F.min("word").alias("word"))
    edges = _neighbourhoods(forms, FINE, False).join(fine.select(F.col("key").alias("near")).distinct(), "near")
    # a hot word as a; two hot words meet twice
    return pairs.unionByName(_joined(edges, fine, one_edit & F.col("hot_a") & (F.col("hot_b").isNull() | (F.col("a") < F.col("b")))))


def _joined(edges: DataFrame, words: DataFrame, verified: Column) -> DataFrame:
    """The words of both ends of each edge, verified in the join itself."""
    hot = F.col("hot") if "hot" in words.columns else F.lit(None)
    a = words.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), hot.alias("hot_a"))
    b = words.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("n_b"), hot.alias("hot_b"))
    met = edges.join(a, "key")
    return met.join(b, "near").where(verified).select("a", "n_a", "b", "n_b")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of each distinct word (word, n).

    n_near counts the words one edit away. form is the near word of largest n
    (ties: the smallest in code-point order) if that n is at least ratio times
    the word's own, else null; form_n is its n. root follows forms to the last.
    An empty table gives an empty table; other columns are not read.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-vocabulary")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left")
    formed = -F.col("best.n") >= F.col("n") * ratio
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                     F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))
    out = written(out, "spelling-forms")
    roots = _roots(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: each link followed to its end. A round doubles the steps; counts at least multiply by the ratio, so rounds are few."""
    links = written(links, "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(onward, "root", "left_semi").isEmpty():
            return links
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
