"""SimHash near-duplicates through Gray-order hierarchical indexes.

Fingerprints that differ in few bits agree on at least one of a few disjoint bit
blocks, so each distinct fingerprint goes to one group for each block. A group
is sorted by Gray rank, which puts fingerprints of few differences side by side.
Runs of neighbours form nodes that hold the bits all their members share (a mask
and a pattern); shared bits are factored into the highest node that has them. A
search adds up the differences from the top node down and leaves a whole node as
soon as they exceed the distance. A group with too many members is dealt again
by blocks of its remaining bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import HOT_ROWS, HOT_SHARE, lookup, packed, text_digest, unpacked, written
from ._text import slices, spread
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Members of a node.
FAN = 8
#: Distinct fingerprints above which a group is dealt again.
GROUP_ROWS = 50_000
#: Times that large groups are dealt again.
DEALS = 2
#: Member rows that are indexed and searched at once, and searches that go down at once.
INDEX_ROWS, SEARCH_ROWS = 50_000, 4_096
ROWS_PER_TASK = 250_000


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's k-word shingles, repeats included, as an unsigned 64-bit number."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    end = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begin = np.append(0, end[:-1] + 1)
    k = min(k, len(tokens))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    n = len(tokens) - k + 1
    for at in range(0, n, 1 << 16):  # bounded for very long texts
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at:min(n, at + (1 << 16))].tolist(), end[k - 1 + at:].tolist())], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _digest() -> Column:
    """The text's digest; empty for a null text."""
    return F.coalesce(text_digest(F.col("text")), F.lit(b"")).alias("digest")


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id (null: the least), fp (long) of every row, and the text's digest if asked for; a null text has no words."""
    more = ["digest"] if digest else []
    rows = packed(docs.select(id_col, text_col), id_col, text_col).select("id", "text", *[_digest() for _ in more])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t or b"", k) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64)), *[part.column(c) for c in more]], ["id", "fp", *more])

    return rows.mapInArrow(run, "id long, fp long" + ", digest binary" * digest)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Trees over groups of fingerprints: group numbers rise, members of a group are distinct."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.group, self.fp = group[order], fp[order]
        ones = ~np.uint64(0)
        # levels from the members up: shared bits, their pattern, first child and number of children
        levels = [(np.full(len(fp), ones), self.fp, np.arange(len(fp)), np.ones(len(fp), np.int64), np.arange(len(fp)))]
        owner, all_, any_, last = self.group, self.fp, self.fp, np.arange(len(fp))
        while True:
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(head, len(owner)))
            place = np.arange(len(owner)) - np.repeat(head, count)
            first = np.flatnonzero(place % FAN == 0)
            children = np.diff(np.append(first, len(owner)))
            all_, any_ = np.bitwise_and.reduceat(all_, first), np.bitwise_or.reduceat(any_, first)
            owner, last = owner[first], last[first + children - 1]
            mask = ~(all_ ^ any_)
            levels.append((mask, all_ & mask, first, children, last))
            if count.max() <= FAN:
                break
        self.levels, self.top_group = levels, owner  # at the top, one node for each group

    def links(self, max_bits: int):
        """Pairs of members of a group at max_bits or fewer differing bits, each pair once, in parts."""
        for a in range(0, len(self.fp), SEARCH_ROWS):
            query = np.arange(a, min(a + SEARCH_ROWS, len(self.fp)))
            node = np.searchsorted(self.top_group, self.group[query])
            mask, pattern, first, children, last = self.levels[-1]
            diff = np.bitwise_count((self.fp[query] ^ pattern[node]) & mask[node]).astype(np.int64)
            for level in range(len(self.levels) - 2, -1, -1):
                keep = (diff <= max_bits) & (last[node] > query)
                query, node, diff = query[keep], node[keep], diff[keep]
                n = children[node]
                child = spread(first[node], n)
                above, query, diff = np.repeat(mask[node], n), np.repeat(query, n), np.repeat(diff, n)
                mask, pattern, first, children, last = self.levels[level]
                node = child
                diff += np.bitwise_count((self.fp[query] ^ pattern[node]) & (mask[node] & ~above))
            keep = (diff <= max_bits) & (node > query)
            yield query[keep], node[keep]


def spanning(n: int, parts) -> np.ndarray:
    """Root of each of n members under the links that come in parts."""
    root = np.arange(n)
    for a, b in parts:
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != root[root]).any():
                root = root[root]
    return root


def _link_groups(max_bits: int):
    def linked(key: np.ndarray, fp: np.ndarray):
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        index = GrayIndex(group, fp.view(np.uint64))
        root = spanning(len(fp), index.links(max_bits))
        at = np.flatnonzero(root != np.arange(len(fp)))
        fp = index.fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], ["a", "b"])

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # sorted by key; whole groups are taken as they come
            keys, fps = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([fps, batch.column("fp").to_numpy()])
            if len(keys) > INDEX_ROWS and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                yield linked(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield linked(keys, fps)

    return run


def split_bits(mask: int, parts: int) -> list[int]:
    """The set bits of a mask in so many blocks of neighbours, as even as can be."""
    bits = [i for i in range(64) if mask >> i & 1]
    cut = [round(len(bits) * p / parts) for p in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:]) if a < b]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(members: DataFrame, masks: list[int], blocks: int) -> DataFrame:
    """members (key, fp, left), whose groups share all bits but left (one of masks): a row for each block of those bits.

    The new key stands for the old key, the block and the block's bits; left loses the block.
    """
    choice = F.when(F.lit(False), F.array(F.struct(F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("block"))))
    for mask in masks:
        own = [(_signed(mask & ~m), _signed(m)) for m in split_bits(mask, blocks)]
        choice = choice.when(F.col("left") == _signed(mask), F.array(*[F.struct(F.lit(left).cast("long").alias("left"), F.lit(m).cast("long").alias("block")) for left, m in own]))
    return members.select("key", "fp", F.explode(choice).alias("c")) \
        .select(F.xxhash64("key", "c.block", F.col("fp").bitwiseAND(F.col("c.block"))).alias("key"), "fp", F.col("c.left").alias("left"))


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints (column fp) as all pairs within max_bits bits do.

    Groups are dealt again at most DEALS times, which leaves out ever fewer
    bits; a group that is still large then is searched as it is, in one index.
    """
    whole = (1 << 64) - 1
    start = distinct.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(_signed(whole)).cast("long").alias("left"))
    members, parts = written(_dealt(start, [whole], max_bits + 1), "bit-groups"), []
    for deal in range(DEALS + 1):
        sizes = written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bit-group-sizes")
        hot = sizes.where(F.col("n") > GROUP_ROWS).select("key") if deal < DEALS else sizes.limit(0).select("key")
        own = members.join(sizes.join(hot, "key", "left_anti").select("key"), "key", "left_semi").select("key", "fp")
        tasks = max(1, -(-members.count() // ROWS_PER_TASK))
        parts.append(own.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_link_groups(max_bits), "a long, b long"))
        again = members.join(hot, "key", "left_semi")
        masks = [r[0] & whole for r in again.select("left").distinct().collect()]  # at most (max_bits + 1) ** (deal + 1)
        if not masks:
            break
        members = written(_dealt(again, masks, max_bits + 1), "bit-groups")
    return reduce(DataFrame.union, parts)


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id of every row: the smallest id reachable over links of max_bits or fewer differing bits.

    Words are runs of anything but ASCII white space, A-Z lowered; shingles have
    k words (a shorter text is one shingle). A null or wordless text has
    fingerprint zero and links like any other. A null id counts as the least id
    (NULL_ID). Repeated rows come out once each, in one component. Equal
    fingerprints are one node, so a group of copies of any size is one row in
    the search.
    """
    rows = written(fingerprints(docs, k, id_col, text_col), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    nodes = _rooted(nodes, max_bits)
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return lookup(rows, nodes.join(least, "root").select("fp", "component_id"), "fp", nodes.select("fp", "n")).select("id", "fp", "component_id")


def _rooted(nodes: DataFrame, max_bits: int) -> DataFrame:
    """nodes (one row for each fp) with root, the least fingerprint of each one's component."""
    roots = written(components(near_links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp"), "simhash-roots")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, with one row of each component: that of smallest id, then text digest, then columns.

    Ids may be null or repeat: rows are told apart by id and text digest, and an
    id stays once for each component that it is the smallest of.
    """
    pair = ["id", "digest"]  # the same text has the same fingerprint: a pair lies in one component
    pairs = written(fingerprints(docs, k, id_col, text_col, digest=True).groupBy("fp", *pair).agg(F.count("*").alias("n")), "simhash-pairs")
    nodes = written(pairs.groupBy("fp").agg(F.min(F.struct(*pair, "n")).alias("first")), "simhash-nodes")
    keep = written(_rooted(nodes, max_bits).groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "simhash-kept")
    rows = packed(docs, id_col, text_col).withColumn("digest", _digest())
    total = pairs.agg(F.sum("n")).first()[0] or 0
    many = written(pairs.where(F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE))).select(*pair), "simhash-hot-pairs")  # fewer than 1 / HOT_SHARE
    again = []
    if many.limit(1).count():  # their rows are reduced where they lie
        again.append(rows.join(F.broadcast(keep.join(F.broadcast(many), pair, "left_semi")), pair))
        rows, keep = rows.join(F.broadcast(many), pair, "left_anti"), keep.join(F.broadcast(many), pair, "left_anti")
    rows = rows.hint("merge").join(keep.hint("merge"), pair)  # the same plan at every size
    once = rows.where("n = 1").select("row", "text")
    if keep.where("n > 1").limit(1).count():
        again.append(rows.where("n > 1"))
    for part in again:  # pairs that repeat: the least row by its columns
        once = once.unionByName(part.groupBy(*pair).agg(F.min(F.struct("text", "row")).alias("r")).select("r.row", "r.text"))
    return unpacked(once, docs, text_col)
