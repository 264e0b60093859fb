import hashlib
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import line_dedup
from riskloom.llm.line_dedup import CuckooFilter, CuckooTable, LineIndex, dedup_lines

from .data import ASCII_LOWER, CLASHES, odd_docs, order, plain_docs


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    return k if len(k) >= 10 else None


def brute(corpus, rows=None):
    holders = defaultdict(set)
    for i, text in corpus:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in corpus if rows is None else rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_cuckoo_tables():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    f = CuckooFilter()
    f.add(h[:9000])
    f.add(h[9000:18_000])
    f = CuckooFilter(f.body())
    assert f.holds(h[:18_000]).all() and f.holds(h[18_000:]).mean() < 0.01
    f.remove(h[:9000])
    assert f.holds(h[9000:18_000]).all() and f.holds(h[:9000]).mean() < 0.01
    assert CuckooFilter(b"").holds(h[:3]).tolist() == [False] * 3
    t = CuckooTable.sized(1)
    assert t.add(h[:10]) and not t.add(h[:2000]) and t.holds(h[:10]).all()  # a refused batch leaves no trace
    twice = CuckooFilter()
    twice.add(np.repeat(h[:1], 40))  # more equal prints than two buckets hold
    assert twice.holds(h[:1]).all()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    index = LineIndex(spark).insert(docs)
    assert result(index.keep_first(docs)) == brute(rows)
    kept = dedup_lines(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in kept.select(CLASHES).collect()))) == sorted(map(str, (tuple(r) for r in docs.select(CLASHES).collect())))
    assert dedup_lines(odd_docs(spark, [])).count() == 0


def test_inserts_and_deletes_are_reversible(spark):
    a = [(10, "a line of some length\nmine only, number ten"), (11, "a line of some length\nshared line number two")]
    b = [(5, "A LINE of some length\nshared line number two\nx"), (12, "mine only, number ten\nshared line number two")]
    c = [(1, "mine only, number ten")]
    da, db, dc = (plain_docs(spark, x) for x in (a, b, c))
    index = LineIndex(spark, shards=4).insert(da)
    assert result(index.keep_first(da)) == brute(a)
    index.insert(db)
    assert result(index.keep_first(da.union(db))) == brute(a + b)
    index.insert(dc)
    assert result(index.keep_first(da)) == brute(a + b + c, a)
    index.delete(db)
    assert result(index.keep_first(da.union(dc))) == brute(a + c)
    refs = {r.key: (r.n_docs, r.keeper) for r in index.references().collect()}
    assert refs[hashlib.sha256(b"mine only, number ten").digest()[:16]] == (2, 1)
    index.delete(dc)
    assert result(index.keep_first(da)) == brute(a)
    index.insert(db)  # keys that had gone come back
    assert result(index.keep_first(da.union(db))) == brute(a + b)
    live = {r.key for r in index.references().collect()}
    held = {r.shard: CuckooFilter(bytes(r.body)) for r in index._filters().collect()}
    keys = index.references().select("key", index._shard(), line_dedup.F.xxhash64("key", line_dedup.F.lit(7)).alias("h")).collect()
    assert len(keys) == len(live) and all(held[r.shard].holds(np.array([r.h]).view(np.uint64))[0] for r in keys)


def test_a_batch_looks_up_only_keys_that_may_be_known(spark):
    index = LineIndex(spark, shards=2).insert(plain_docs(spark, [(1, "the first known line\nthe second known line")]))
    entries = line_dedup.line_entries(plain_docs(spark, [(2, "the first known line\nan unknown new line")]), "doc_id", "text").select("key").distinct()
    assert [bytes(r.key) for r in index._unknown(entries).collect()] == [hashlib.sha256(b"an unknown new line").digest()[:16]]


def test_a_line_in_every_document(spark):
    rows = [(i, f"copyright notice of all\nown text of number {i}") for i in range(500)]
    docs = plain_docs(spark, rows).repartition(6)
    assert result(LineIndex(spark).insert(docs).keep_first(docs)) == brute(rows)


def test_an_index_is_opened_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 4)
    a = [(10, "a line of some length\nmine only, number ten"), (11, "a line of some length\nshared line number two")]
    b = [(i, f"A LINE of some length\nshared line number two\nown line of number {i}") for i in range(20, 60)]
    c = [(5, "mine only, number ten\nown line of number 33")]
    da, db, dc = (plain_docs(spark, x) for x in (a, b, c))
    path = str(tmp_path / "index")
    LineIndex(spark, path).insert(da)
    second, late = LineIndex(spark, path), LineIndex(spark, path)
    assert (second.epoch, second.shards, second.deletes) == (1, 8, False)
    second.insert(db)  # outgrows the shards
    assert result(second.keep_first(db)) == brute(a + b, b)
    with pytest.raises(Exception, match="exist"):
        late.insert(dc)  # that epoch is taken
    assert (late.epoch, late.shards) == (1, 8)
    third = LineIndex(spark, path)
    assert third.epoch == 2 and third.shards == second.shards > 16
    held = {r.shard: CuckooFilter(bytes(r.body)) for r in third._filters().collect()}
    keys = third.references().select("key", third._shard(), line_dedup.F.xxhash64("key", line_dedup.F.lit(7)).alias("h")).collect()
    assert len(held) > 8 and len(keys) == 43 and all(held[r.shard].holds(np.array([r.h]).view(np.uint64))[0] for r in keys)
    third.insert(dc)
    LineIndex(spark, path).delete(da)
    last = LineIndex(spark, path)
    assert last.deletes and last.epoch == 4 and result(last.keep_first(db.union(dc))) == brute(b + c)
    assert result(LineIndex(spark, path).delete(dc).keep_first(db)) == brute(b)


def test_a_repeated_delete_takes_nothing(spark):
    a, b = [(1, "one line that both of them hold")], [(2, "one line that both of them hold"), (3, "a line of the third alone")]
    da, db = plain_docs(spark, a), plain_docs(spark, b)
    key = hashlib.sha256(b"one line that both of them hold").digest()[:16]
    index = LineIndex(spark, shards=2).insert(da.union(db))
    index.delete(da).delete(da).delete(plain_docs(spark, [(9, "one line that both of them hold\na line that was never there")]))
    assert {bytes(r.key): (r.n_docs, r.keeper) for r in index.references().collect()}[key] == (1, 2)
    index.insert(da)
    assert {bytes(r.key): (r.n_docs, r.keeper) for r in index.references().collect()}[key] == (2, 1)
    assert result(index.keep_first(da.union(db))) == brute(a + b)
    assert index.lines >= 3


def test_a_job_that_runs_twice(spark):
    a, b = [(1, "one line that both of them hold"), (4, "mine alone and no other's")], [(2, "one line that both of them hold")]
    da, db = plain_docs(spark, a), plain_docs(spark, b)
    index = LineIndex(spark, shards=2).insert(da).insert(da).insert(db)
    assert result(index.keep_first(da.union(db))) == brute(a + b)
    index.delete(da).delete(da).delete(da)
    assert result(index.keep_first(db)) == brute(b)


def test_rows_depend_on_the_filters(spark, monkeypatch):
    """A batch's lines are looked up only if the filters of the batches before may hold them."""
    a, b = [(1, "a line that the second batch repeats")], [(2, "a line that the second batch repeats\ninside the batch itself"), (3, "inside the batch itself")]
    db = plain_docs(spark, b)
    index = LineIndex(spark, shards=2).insert(plain_docs(spark, a)).insert(db)
    assert result(index.keep_first(db)) == brute(a + b, b)
    monkeypatch.setattr(LineIndex, "_filters", lambda self, epoch=None: self.spark.createDataFrame([], "shard int, body binary"))
    assert result(index.keep_first(db)) == brute(b)


def test_many_rows_without_an_id(spark):
    rows = [(None, f"a line in every one of them\nown line of number {i}\n{'more of it ' * (i % 3)}") for i in range(300)] + [(1, "a line in every one of them")]
    docs = plain_docs(spark, rows).repartition(5)
    got = result(LineIndex(spark).insert(docs).keep_first(docs))
    assert got == brute(rows)
