import random
import zlib
from collections import defaultdict

import pytest

from riskloom.llm import sharding
from riskloom.llm.queries import Q

from ..conftest import SF_SMALL
from .data import odd_docs, plain_docs, read


def naive_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s] if s <= capacity else []
        if not fits:
            rooms.append(max(0, capacity - s))
            out.append(len(rooms) - 1)
        else:
            r, i = min(fits)
            rooms[i] = r - s
            out.append(i)
    return out


def test_tree_packs_as_a_plain_search_does():
    rnd = random.Random(3)
    for _ in range(40):
        sizes = sorted((rnd.randint(1, rnd.choice([5, 60, 140])) for _ in range(rnd.randint(0, 200))), reverse=True)
        got, want = sharding.best_fit(sizes, 100), naive_best_fit(sizes, 100)
        assert max(got, default=-1) == max(want, default=-1)
        loads = defaultdict(int)
        for s, b in zip(sizes, got):
            loads[b] += s
        assert all(v <= 100 or list(got).count(b) == 1 for b, v in loads.items())
        assert sorted(loads.values()) == sorted(sum(s for s, b in zip(sizes, want) if b == k) for k in set(want))


def test_fit_into_spreads_evenly_beside_big_groups():
    sizes = sorted([5000, *range(1, 200), *[3] * 400], reverse=True)
    got = sharding.fit_into(sizes, 7)
    loads = [sum(s for s, b in zip(sizes, got) if b == k) for k in range(7)]
    assert max(loads) == 5000 and max(loads[1:]) - min(loads[1:]) < 0.02 * max(loads[1:])
    assert sharding.fit_into([], 3) == [] and sharding.fit_into([4], 3) == [0]


def test_query_on_documents(spark):
    docs = read(SF_SMALL, "documents").set_index("doc_id")
    got = Q["op1_sharding"](spark, SF_SMALL).toPandas()
    assert sorted(got.doc_id) == sorted(docs.index) and got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    raw = docs.text.loc[got.doc_id].str.encode("utf-8")
    assert (got["size"].to_numpy() == raw.str.len().to_numpy() + 16).all()
    assert got.text_crc32.tolist() == [zlib.crc32(b) for b in raw]
    assert set(got.shard) <= set(range(40))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    got["text"] = docs.text.loc[got.doc_id].to_numpy()
    assert (got.groupby("text").shard.nunique() == 1).all()
    share = got["size"].sum() / 40
    loads, groups = got.groupby("shard")["size"].sum(), got.groupby("text")["size"].sum()
    assert loads.max() <= max(share * 1.1, groups.max())


def test_odd_rows_small_tasks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 4)
    monkeypatch.setattr(sharding, "ROWS_PER_SLOT_RUN", 1)
    docs = odd_docs(spark)
    got = sharding.shard_documents(docs, 4).toPandas()
    assert len(got) == docs.count()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert (got[got["size"] == 16].text_crc32 == 0).all()
    assert sharding.shard_documents(odd_docs(spark, []), 4).count() == 0


def test_a_hot_group_has_a_shard_of_its_own(spark):
    rows = [(i, "the same text again and again") for i in range(300)] + [(1000 + i, f"text {i} " * (i % 7 + 1)) for i in range(300)]
    got = sharding.shard_documents(plain_docs(spark, rows), 5).toPandas()
    hot = got[got.doc_id < 1000]
    assert hot.shard.nunique() == 1 and not set(got[got.doc_id >= 1000].shard) & set(hot.shard)
    loads = got[got.doc_id >= 1000].groupby("shard")["size"].sum()
    assert len(loads) == 4 and loads.max() - loads.min() < 0.02 * loads.max()


def test_fixed_capacity_uses_few_shards(spark):
    groups = spark.createDataFrame([(bytes([i]), 10 + i % 5) for i in range(100)], "key binary, bytes long")
    got = sharding.pack_groups(groups, capacity=120).toPandas()
    assert got.groupby("shard")["bytes"].sum().max() <= 120
    assert got.shard.nunique() <= -(-got["bytes"].sum() // 120) + 1


@pytest.mark.parametrize("per_task", [200_000, 1000])
def test_many_small_groups_are_packed_in_tasks(spark, monkeypatch, per_task):
    """Level by level; about as few shards as one best-fit pass over everything."""
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", per_task)
    rnd = random.Random(4)
    sizes = [rnd.choice([2250, 2250, 2249, 1100, 3000, 9000, rnd.randrange(1, 8192)]) for _ in range(12_000)]
    groups = spark.createDataFrame([(str(i).encode(), n) for i, n in enumerate(sizes)], "key binary, bytes long")
    got = sharding.pack_groups(groups, capacity=8192).toPandas()
    assert len(got) == len(sizes) and {int(k): b for k, b in zip(got["key"], got["bytes"])} == dict(enumerate(sizes))
    shards = got.groupby("shard")["bytes"].agg(["sum", "count", "max"])
    assert sorted(shards.index) == list(range(len(shards)))
    assert ((shards["sum"] <= 8192) | (shards["count"] == 1)).all()
    assert len(shards) <= 1.02 * (max(sharding.best_fit(sorted(sizes, reverse=True), 8192)) + 1)
    assert sharding.pack_groups(groups.limit(0), capacity=10).count() == 0
