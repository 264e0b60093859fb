"""Benchmark passages in documents by a prefix-filtered set join.

A benchmark item gives windows of ten words (an item of fewer words is one
window). A window is the ordered set of its word shingles (three words, or the
whole of a shorter window). Shingles are ordered by rarity, which is counted over
all documents; a document that contains a window must contain its rarest
shingles, so only those prefixes are joined with the documents' shingles. A
match fixes where the window would lie: it must begin and end inside the
document (positional and length bounds), and then the whole window is verified,
first by word hashes and then by its bytes.

The benchmark's side is taken in blocks of bounded size, each sent to all tasks;
documents are read once to count rarity and once to join, and never move.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import packed, written
from ._text import ALNUM, LOWER, WordHash, flat, mix, slices, spread, windows, words

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: Text bytes of benchmark items in one block: the bound of what is broadcast.
BLOCK_BYTES = 1_000_000
WORD_HASH = WordHash(8)
BASE = np.uint64(0xD6E8FEB86659FD93)
SIEVE_BITS = 20


def word_view(column: pa.Array):
    """Lower-cased bytes, word begins and ends, each text's first word, word hashes."""
    data, offs = flat(column)
    data = LOWER[data]
    begin, end, first = words(data, offs, ALNUM)
    return data, begin, end, first, WORD_HASH(data, begin, end)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    return mix(windows(h, k, BASE) + np.uint64(k))


class Sieve:
    """Where the values of a sorted table occur in an array: a bitmap first, then binary search."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << SIEVE_BITS, bool)
        self.bits[(table >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in values, and the table's entry there."""
        at = np.flatnonzero(self.bits[(values >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        entry = np.minimum(np.searchsorted(self.table, values[at]), len(self.table) - 1)
        same = self.table[entry] == values[at]
        return at[same], entry[same]


class Block:
    """The distinct windows of some items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        column = pa.array([t for _, t in items], pa.string())
        data, begin, end, first, h = word_view(column)
        windows_, owners = {}, {}
        for i, (item, _) in enumerate(items):
            a, b = int(first[i]), int(first[i + 1])
            size = min(window, b - a)
            for s in range(a, b - size + 1 if size else a):
                body = b" ".join(data[begin[j]:end[j]].tobytes() for j in range(s, s + size))
                windows_.setdefault(body, h[s:s + size])
                owners.setdefault(body, set()).add(item)
        self.body = list(windows_)
        self.items = [sorted(owners[b]) for b in self.body]
        self.size = np.array([len(windows_[b]) for b in self.body], np.int64)
        self.hashes = np.zeros((len(self.body), window), np.uint64)
        for i, b in enumerate(self.body):
            self.hashes[i, :self.size[i]] = windows_[b]
        # every shingle of every window: its value, its window and its place in it
        value, win, place = [], [], []
        for i in range(len(self.body)):
            own = self.hashes[i, :self.size[i]]
            s = shingles(own, min(SHINGLE_WORDS, len(own)))
            value.append(s)
            win.append(np.full(len(s), i))
            place.append(np.arange(len(s)))
        self.value, self.win, self.place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((value, np.uint64), (win, np.int64), (place, np.int64)))
        self.lengths = sorted({min(SHINGLE_WORDS, int(n)) for n in self.size})
        self.distinct = np.unique(self.value)

    def order_by_rarity(self, count: dict[int, int]) -> None:
        """Keeps each window's prefix: as a whole window must be met, its one rarest shingle."""
        rarity = np.array([count.get(int(v), 0) for v in self.value.astype(np.int64)], np.int64) if len(self.value) else np.zeros(0, np.int64)
        order = np.lexsort((self.place, self.value, rarity, self.win))
        order = order[np.concatenate([[True], np.diff(self.win[order]) != 0])] if len(order) else order
        order = order[np.argsort(self.value[order], kind="stable")]
        self.value, self.win, self.place = self.value[order], self.win[order], self.place[order]
        self.distinct = np.unique(self.value)
        self.begin = np.searchsorted(self.value, self.distinct)
        self.many = np.diff(np.append(self.begin, len(self.value)))


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int):
    """The items in blocks of about BLOCK_BYTES of text; one block at a time reaches the driver."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(n):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield Block(sorted({(r[0], r[1]) for r in own.collect()}), window)


def _count(block: Block):
    def run(batches):
        sieve, total = Sieve(block.distinct), np.zeros(len(block.distinct), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h = word_view(part.column("text"))[4]
                for k in block.lengths:
                    total += np.bincount(sieve(shingles(h, k))[1], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block.distinct[met].view(np.int64)), pa.array(total[met])], ["value", "n"])

    return run


def _join(block: Block):
    def run(batches):
        sieve = Sieve(block.distinct)
        for batch in batches:
            for part in slices(batch, "text"):
                data, begin, end, first, h = word_view(part.column("text"))
                start, win = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in block.lengths:
                    at, entry = sieve(shingles(h, k))
                    own = spread(block.begin[entry], block.many[entry])
                    s = np.repeat(at, block.many[entry]) - block.place[own]
                    w = block.win[own]
                    fits = np.minimum(block.size[w], SHINGLE_WORDS) == k
                    start.append(s[fits])
                    win.append(w[fits])
                start, win = np.concatenate(start), np.concatenate(win)
                # positional and length bounds: the whole window lies in the text that holds its first word
                ok = (start >= 0) & (start + block.size[win] <= len(h))
                start, win = start[ok], win[ok]
                text = np.searchsorted(first, start, "right") - 1
                ok = start + block.size[win] <= first[text + 1]
                start, win, text = start[ok], win[ok], text[ok]
                ok = np.ones(len(start), bool)
                for j in range(block.hashes.shape[1]):
                    inside = j < block.size[win]
                    ok &= ~inside | (h[np.minimum(start + j, len(h) - 1)] == block.hashes[win, j])
                start, win, text = start[ok], win[ok], text[ok]
                ok = np.array([b" ".join(data[begin[j]:end[j]].tobytes() for j in range(s, s + len_)) == block.body[w]
                               for s, w, len_ in zip(start.tolist(), win.tolist(), block.size[win].tolist())], bool)
                if len(ok):
                    start, win, text = start[ok], win[ok], text[ok]
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + block.size[win], -1)
                hit = np.cumsum(edge[:-1]) > 0
                found: list[set[str]] = [set() for _ in range(part.num_rows)]
                spans: list[list[int]] = [[] for _ in range(part.num_rows)]
                for t, w in zip(text.tolist(), win.tolist()):
                    found[t].update(block.items[w])
                for t in np.unique(text):
                    own = hit[first[t]:first[t + 1]]
                    spans[t] = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                before_items, before_spans = part.column("items").to_pylist(), part.column("hits").to_pylist()
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("id"), part.column("text"), pa.array(np.diff(first), pa.int64()),
                    pa.array([_union(a, b) for a, b in zip(before_spans, spans)], pa.list_(pa.int64())),
                    pa.array([sorted({*a, *b}) for a, b in zip(before_items, found)], pa.list_(pa.string()))],
                    ["row", "id", "text", "n_words", "hits", "items"])

    return run


def _union(a: list[int], b: list[int]) -> list[int]:
    """Two lists begin, end, begin, end, ... of disjoint rising intervals as one."""
    if not a or not b:
        return list(a or b)
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where benchmark windows occur: row (the other columns), id, text, n_words, n_hit, hits, items.

    Words are runs of digits, letters a-z (A-Z lowered) and code points above
    ASCII. hits holds the maximal intervals of hit words as begin, end, begin,
    end, ...; items the ids, as sorted strings, of items with a window in the
    text. Null and empty texts have no words. Items without words, and items
    with a null id, are never met; equal windows of several items count for
    each. An empty benchmark hits nothing. Every row of docs comes out once;
    repeated rows and null ids stay as they are.
    """
    rows = packed(docs, id_col, text_col)
    rows = rows.withColumn("n_words", F.lit(0).cast("long")).withColumn("hits", F.array().cast("array<long>")).withColumn("items", F.array().cast("array<string>"))
    texts = rows.select("text")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    for i, block in enumerate(_blocks(items, item_col, item_text_col, window)):
        if len(block.distinct):
            counts = texts.mapInArrow(_count(block), "value long, n long").groupBy("value").agg(F.sum("n")).collect()  # a number for each shingle of the block at most
            block.order_by_rarity({v: n for v, n in counts})
        else:
            block.order_by_rarity({})
        if i:
            rows = written(rows, "passages")
        rows = rows.mapInArrow(_join(block), schema)
    n_hit = F.aggregate(F.col("hits"), F.lit(0).cast("long"), lambda acc, x: x - acc)  # e1 - b1 + e2 - b2 ... over an even number of ends
    return rows.select("row", "id", "text", "n_words", n_hit.alias("n_hit"), "hits", "items")
