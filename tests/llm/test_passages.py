"""Substring dedup and benchmark decontamination against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from riskloom.llm import decontaminate, substring_dedup
from riskloom.llm._tables import packed
from riskloom.llm.decontaminate import find_passages
from riskloom.llm.substring_dedup import pack_sorted, remove_repeats, shard_cuts, unpack_sorted

from .data import ASCII_LOWER, odd_docs, order, plain_docs, words


def brute_repeats(rows, n):
    firsts = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - n + 1):
            win = tuple(w[k:k + n])
            firsts[win] = min(firsts.get(win, i), i, key=order) if win in firsts else i
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if order(firsts[tuple(w[k:k + n])]) < order(i):
                gone[k:k + n] = [True] * n
        out.append((i, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return sorted(out, key=str)


def repeats(df):
    rows = df.collect()
    for r in rows:
        assert sum(e - b for b, e in zip(r.removed[::2], r.removed[1::2])) == r.n_removed
        assert all(a < b for a, b in zip(r.removed, r.removed[1:]))  # maximal: never touching
    return sorted(((r.row.doc_id, r.text, r.n_words, r.n_removed) for r in rows), key=str)


def test_sorted_packing():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (unpack_sorted(pack_sorted(h)) == h).all()
        cuts = shard_cuts(h, 7)
        assert cuts[0] == 0 and cuts[-1] == len(h) and (np.diff(cuts) >= 0).all()
    assert unpack_sorted(pack_sorted(np.zeros(1, np.uint64))).tolist() == [0]


def test_repeats_on_odd_rows_many_batches_and_shards(spark, monkeypatch):
    for batch in (2_000, 2):
        monkeypatch.setattr(substring_dedup, "ROWS_PER_BATCH", batch)
        monkeypatch.setattr(substring_dedup, "BYTES_PER_SHARD", 100_000_000 if batch > 2 else 3_000)
        docs = odd_docs(spark)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert repeats(remove_repeats(docs)) == brute_repeats(rows, 13)
        assert remove_repeats(odd_docs(spark, [])).count() == 0


def test_repeats_on_random_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ROWS_PER_BATCH", 9)
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(6)]
    passages = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(3, 30))) for _ in range(12)]
    rows = [(rnd.randint(-50, 50), "  ".join(rnd.choice(passages) if rnd.random() < 0.5 else rnd.choice(pool) for _ in range(rnd.randint(0, 25)))) for _ in range(80)]
    assert repeats(remove_repeats(plain_docs(spark, rows), n=5)) == brute_repeats(rows, 5)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def brute_passages(rows, items, n):
    wins = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        if item is not None and w:
            m = min(n, len(w))
            for k in range(len(w) - m + 1):
                wins[tuple(w[k:k + m])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for i, text in rows:
        w, hit, met = alnum(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (win := tuple(w[k:k + m])) in wins:
                    hit.update(range(k, k + m))
                    met |= wins[win]
        out.append((i, len(w), len(hit), sorted(met)))
    return sorted(out, key=str)


def passages(df):
    rows = df.collect()
    for r in rows:
        assert sum(e - b for b, e in zip(r.hits[::2], r.hits[1::2])) == r.n_hit
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str)


ITEMS = [(1, "the quick brown fox jumps over a lazy dog while seven green"), (2, "Over a LAZY dog while seven green birds sing in the old garden"), (3, "one"),
         (4, ""), (5, None), (None, "the old garden near the river"), (6, "!!! ..."), (7, "À la recherche du temps perdu et plus encore que cela"), (2, "word word"), (10, "one")]


def test_passages_on_odd_rows_and_many_blocks(spark, monkeypatch):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, hits string")
    for block in (1_000_000, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        assert passages(find_passages(docs, items)) == brute_passages(rows, ITEMS, 10)
    assert find_passages(odd_docs(spark, []), items).count() == 0
    assert all(r.n_hit == 0 for r in find_passages(docs, items.limit(0)).collect())


def test_passages_on_random_texts(spark):
    rnd = random.Random(9)
    pool = [f"w{i}" for i in range(5)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(25)]
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    got = find_passages(plain_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=6)
    assert passages(got) == brute_passages(rows, items, 6)


def test_only_the_rarest_shingle_of_a_window_is_joined():
    block = decontaminate.Block([("1", "a b c d e f g h i j k")], 10)
    assert len(block.body) == 2 and len(block.value) == 16
    count = {int(v): 5 for v in block.distinct.astype(np.int64)}
    rare = int(block.value.astype(np.int64)[4])  # e f g, in both windows
    block.order_by_rarity(count | {rare: 1})
    assert block.value.astype(np.int64).tolist() == [rare, rare] and sorted(block.place.tolist()) == [3, 4]


def test_union_of_intervals():
    assert decontaminate._union([0, 3, 8, 9], [2, 5, 9, 11]) == [0, 5, 8, 11]
    assert decontaminate._union([], [1, 2]) == [1, 2]


def test_words_never_cross_texts():
    h, owner, start, count = substring_dedup.window_hashes(pa.array(["a b", "c d e", None, "f"]), 2)
    assert owner.tolist() == [0, 1, 1] and start.tolist() == [0, 2, 3] and count.tolist() == [2, 3, 0, 1]


def test_equal_ids_in_many_batches(spark, monkeypatch):
    """Most rows have no id: they are spread over batches and don't remove from one another."""
    monkeypatch.setattr(substring_dedup, "ROWS_PER_BATCH", 20)
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(None if i % 10 else i, f"start {i} {passage} end {i} " + " ".join(f"x{i % 7}y{j}" for j in range(16))) for i in range(300)]
    docs = plain_docs(spark, rows).repartition(4)
    assert repeats(remove_repeats(docs)) == brute_repeats(rows, 13)
    plan = remove_repeats(docs)._jdf.queryExecution().toString()
    assert "pmod(xxhash64(id" in plan  # the batch is a hash of id and text
    sizes = [r["count"] for r in packed(docs).groupBy(F.pmod(F.xxhash64("id", "text"), F.lit(15))).count().collect()]
    assert len(sizes) == 15 and max(sizes) < 60


def test_packed_ids():
    for ids in ([5], [-(1 << 63), -7, 0, 3], [(1 << 62), (1 << 63) - 1], [-(1 << 63), (1 << 63) - 1]):
        ids = np.array(ids, np.int64)
        assert (substring_dedup.unpack_ids(substring_dedup.pack_ids(ids)) == ids).all()
