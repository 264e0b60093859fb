"""Repeated passages: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt to batches by a hash of id and text. Each batch sends the
set of its window hashes, each with the least document of the batch that holds
it, sorted and packed, to hash shards; a shard finds which hashes a document of
a smaller id holds in another batch and sends one bit for each back. Within a
batch the ids decide. So a window moves once, as about eight bytes, however
many documents share it, and a very common passage is one hash for each batch.

Windows are compared by 64-bit hashes: two different windows among n are taken
for equal with a chance of about n / 2**64 each.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._tables import packed
from ._text import NOT_SPACE, WordHash, flat, slices, windows, words

ROWS_PER_BATCH = 2_000
#: Text bytes of a task's batches, about.
BYTES_PER_TASK = 16_000_000
#: Text bytes for which one shard counts windows (about one window for six bytes).
BYTES_PER_SHARD = 12_000_000
WORD_HASH = WordHash(5)
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(column: pa.Array, n: int):
    """Hash, text number and first word (counted over the column) of every window; each text's number of words."""
    data, offs = flat(column)
    begin, end, first = words(data, offs, NOT_SPACE)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    h = windows(WORD_HASH(data, begin, end), n, BASE)
    whole = np.flatnonzero(owner[:len(h)] == owner[n - 1:]) if len(h) else np.zeros(0, np.int64)
    return h[whole], owner[whole], whole, np.diff(first)


def pack_sorted(h: np.ndarray) -> bytes:
    """Rising 64-bit values as the planes of their differences' low bytes."""
    gap = np.diff(h, prepend=np.uint64(0))
    width = max(1, -(-int(gap.max()).bit_length() // 8))
    return bytes([width]) + gap.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_sorted(body: bytes) -> np.ndarray:
    width = body[0]
    plane = np.frombuffer(body, np.uint8, offset=1).reshape(width, -1)
    gap = np.zeros((plane.shape[1], 8), np.uint8)
    gap[:, :width] = plane.T
    return np.cumsum(gap.view("<u8").ravel(), dtype=np.uint64)


def shard_cuts(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's values begin in rising h; the last entry is the end."""
    lowest = [-(-(s << 64) // shards) for s in range(shards)]
    return np.append(np.searchsorted(h, np.array(lowest, np.uint64)), len(h))


def pack_ids(ids: np.ndarray) -> bytes:
    """Rising distinct ids: the first, then the others as gaps."""
    return ids[:1].astype("<i8").tobytes() + (pack_sorted(ids[1:].view(np.uint64) - ids[:1].view(np.uint64)) if len(ids) > 1 else b"")


def unpack_ids(body: bytes) -> np.ndarray:
    first = np.frombuffer(body, "<i8", 1)
    rest = unpack_sorted(body[8:]) if len(body) > 8 else np.zeros(0, np.uint64)
    return np.concatenate([first, (rest + first.view(np.uint64)).view(np.int64)])


def _send(n: int, shards: int):
    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                h, owner, _, _ = window_hashes(part.column("text"), n)
                at, id_ = part.column("batch").to_numpy()[owner], part.column("id").to_numpy()[owner]
                for b in np.unique(at):
                    held.setdefault(int(b), []).append(_least(h[at == b], id_[at == b]))
        for b in sorted(held):
            h, id_ = _least(*map(np.concatenate, zip(*held.pop(b))))
            cuts = shard_cuts(h, shards)
            own = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            bodies = [[], [], []]
            for s in own:
                ids, who = np.unique(id_[cuts[s]:cuts[s + 1]], return_inverse=True)
                bodies[0].append(pack_sorted(h[cuts[s]:cuts[s + 1]]))
                bodies[1].append(pack_ids(ids))
                bodies[2].append(who.astype("<u2" if len(ids) <= 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([b] * len(own), pa.int64()), *[pa.array(x, pa.binary()) for x in bodies]], ["shard", "batch", "hashes", "ids", "who"])

    return run


def _least(h: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct hash, rising, and the least id that has it."""
    order = np.lexsort((id_, h))
    h, id_ = h[order], id_[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    return h[first], id_[first]


def _count(table: pa.Table) -> pa.Table:
    """For each batch in a shard, a bit for each of its hashes: does another batch hold it in a smaller document?"""
    parts = [unpack_sorted(b) for b in table.column("hashes").to_pylist()]
    least = []
    for ids, who, h in zip(table.column("ids").to_pylist(), table.column("who").to_pylist(), parts):
        least.append(unpack_ids(ids)[np.frombuffer(who, "<u2" if len(who) == 2 * len(h) else "<u4")])
    h, id_ = np.concatenate(parts), np.concatenate(least)
    order = np.lexsort((id_, h))
    head = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    first = id_[order][np.flatnonzero(head)[np.cumsum(head) - 1]]  # the least id of the hash
    seen = np.zeros(len(h), bool)
    seen[order] = first < id_[order]
    cuts = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(seen[a:b]).tobytes() if seen[a:b].any() else None for a, b in zip(cuts, cuts[1:])]
    out = pa.table({"shard": table.column("shard"), "batch": table.column("batch"), "seen": pa.array(bits, pa.binary())})
    return out.filter(pc.is_valid(out.column("seen")))


def _judge(n: int, shards: int, schema: pa.Schema):
    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.sort_by("id").combine_chunks()
        rank = np.unique(docs.column("id").to_numpy(), return_inverse=True)[1]
        hashes, owners, starts, counts = [], [], [], []
        texts = words_before = 0
        for batch in docs.select(["text"]).to_batches():
            for part in slices(batch, "text"):
                h, owner, start, count = window_hashes(part.column("text"), n)
                hashes.append(h)
                owners.append(owner + texts)
                starts.append(start + words_before)
                counts.append(count)
                texts += part.num_rows
                words_before += int(count.sum())
        h, owner, start, count = (np.concatenate(x) for x in (hashes, owners, starts, counts))
        unique, first, number = np.unique(h, return_index=True, return_inverse=True)
        seen = np.zeros(len(unique), bool)
        cuts = shard_cuts(unique, shards)
        for s, body in zip(bits.column("shard").to_pylist(), bits.column("seen").to_pylist()):
            seen[cuts[s]:cuts[s + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=int(cuts[s + 1] - cuts[s])).astype(bool)
        hit = start[seen[number] | (rank[owner] > rank[owner[first]][number])] if len(h) else start
        edge = np.zeros(words_before + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        gone = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(count)
        kept, spans, removed = [], [], np.zeros(len(count), np.int64)
        for i, text in enumerate(docs.column("text").cast(pa.binary()).to_pylist()):
            own = gone[ends[i] - count[i]:ends[i]]
            tokens = (text or b"").split()
            removed[i] = own.sum()
            if removed[i]:
                turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans.append(turn.tolist())
                tokens = compress(tokens, (~own).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(tokens).decode())
        return pa.Table.from_arrays([docs.column("row"), docs.column("id"), pa.array(kept, pa.string()), pa.array(count, pa.int64()),
                                     pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=["row", "id", "text", "n_words", "n_removed", "removed"])

    return run


def remove_repeats(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row without the words of windows that also start in a document with a smaller id.

    Words are runs of anything but ASCII white space; windows are judged on the
    texts as given. Out: row (the other columns), id, text (kept words, one
    space between), n_words, n_removed, and removed: the maximal intervals of
    removed words as begin, end, begin, end, ... A null text has no words; a
    null id counts as the least; rows with equal ids don't remove from one
    another. Texts of fewer than n words lose nothing.
    """
    size, count = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    size = size or 0
    shards, n_batches = max(1, math.ceil(size / BYTES_PER_SHARD)), max(1, math.ceil(count / ROWS_PER_BATCH))
    rows = packed(docs, id_col, text_col)
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(n_batches)))
    dealt = rows.repartition(max(1, min(n_batches, math.ceil(size / BYTES_PER_TASK))), "batch")  # read twice, shuffled once
    sent = dealt.mapInArrow(_send(n, shards), "shard int, batch long, hashes binary, ids binary, who binary")
    bits = sent.groupBy("shard").applyInArrow(_count, "shard int, batch long, seen binary")
    schema = T.StructType([dealt.schema["row"], dealt.schema["id"], dealt.schema["text"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.LongType()))])
    return dealt.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(_judge(n, shards, to_arrow_schema(schema)), schema)
