import random

import numpy as np
import pytest
import xxhash

from riskloom.llm import simhash
from riskloom.llm.components import components
from riskloom.llm.simhash import GrayIndex, drop_near_duplicates, fingerprint, gray_rank, near_duplicates, near_links, spanning, split_bits

from ..conftest import SF_SMALL
from .data import ASCII_LOWER, odd_docs, order, plain_docs, read, words


def brute_fingerprint(text, k=3):
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d) if r in least else d
    return [least[find(i)] for i in range(len(ids))]


def clustered(rnd, n):
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 9, 40])):
            out.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    return sorted(out)[:n]


def test_fingerprint_is_the_majority_of_xxh64():
    rnd = random.Random(2)
    texts = ["", "  ", "One", "one TWO", "Straße ÀB ÀB ÀB", "a b c a b c a b c"] + [" ".join(rnd.choice(["x", "Yy", "zé", "€"]) for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    for t in texts:
        assert fingerprint(t.encode()) == brute_fingerprint(t)
    assert fingerprint(b"a b c d", 2) == brute_fingerprint("a b c d", 2)


def test_gray_rank_orders_the_gray_sequence():
    codes = np.array([i ^ (i >> 1) for i in range(2000)] + [1 << 63], np.uint64)
    assert gray_rank(codes)[:2000].tolist() == list(range(2000)) and gray_rank(codes)[-1] == (1 << 64) - 1


@pytest.mark.parametrize("bits", [0, 3, 8])
def test_index_finds_every_link(bits):
    rnd = random.Random(bits)
    fp = np.array(clustered(rnd, 900), np.uint64)
    group = np.sort(np.array([rnd.randrange(4) ** 2 for _ in fp]))
    index = GrayIndex(np.unique(group, return_inverse=True)[1], fp)
    got = {(int(a), int(b)) for x, y in index.links(bits) for a, b in zip(x, y)}
    near = np.bitwise_count(index.fp[:, None] ^ index.fp[None, :]) <= bits
    want = np.argwhere(np.triu(near & (index.group[:, None] == index.group[None, :]), 1))
    assert got == {(a, b) for a, b in want.tolist()}


def test_index_leaves_whole_nodes_out():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    index = GrayIndex(np.zeros(len(fp), np.int64), fp)
    seen = 0
    real, simhash.spread = simhash.spread, lambda a, n: (lambda out: counted.append(len(out)) or out)(real(a, n))
    counted: list[int] = []
    try:
        for x, _ in index.links(3):
            seen += len(x)
    finally:
        simhash.spread = real
    assert sum(counted) < 0.3 * len(fp) ** 2 / 2


def test_spanning_matches_union_find():
    rnd = random.Random(7)
    a, b = np.array([[rnd.randrange(300), rnd.randrange(300)] for _ in range(200)]).T
    root = spanning(300, [(a[:90], b[:90]), (a[90:], b[90:])])
    assert (root[a] == root[b]).all()
    edges = list(zip(a.tolist(), b.tolist()))
    seen, parts = {}, 0
    for i in range(300):
        if i not in seen:
            parts, todo = parts + 1, [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = parts
                    todo += [q for p, q in edges if p == x] + [p for p, q in edges if q == x]
    assert len(set(root.tolist())) == parts


def test_components(spark):
    rnd = random.Random(8)
    links = [(rnd.randint(-40, 200), rnd.randint(-40, 200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for p in links if p[0] != p[1] for x in p}
    changed = True
    while changed:
        changed = False
        for p, q in links:
            if p != q and label[p] != label[q]:
                label[p] = label[q] = min(label[p], label[q])
                changed = True
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_groups_dealt_again(spark, monkeypatch):
    rnd = random.Random(3)
    fps = clustered(rnd, 500)
    near = [f & ~0xFFFF for f in fps[:200]]  # one large group: the same low block
    fps = sorted({*fps, *near})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for limit in (50_000, 20):
        monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
        root = {r.node: r.root for r in components(near_links(rows)).collect()}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        assert [root.get(s, s) for s in signed] == brute_components(signed, fps)


def test_split_bits():
    assert split_bits((1 << 64) - 1, 4) == [0xFFFF, 0xFFFF << 16, 0xFFFF << 32, 0xFFFF << 48]
    parts = split_bits(0b1011_0111_0001, 4)
    assert sum(parts) == 0b1011_0111_0001 and len(parts) == 4
    assert split_bits(0b11, 4) and sum(split_bits(0b11, 4)) == 3


def test_documents(spark):
    docs = read(SF_SMALL, "documents")
    fps = [brute_fingerprint(t) for t in docs.text]
    want = dict(zip(docs.doc_id, brute_components(docs.doc_id.tolist(), fps)))
    got = near_duplicates(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    assert {r.id: r.component_id for r in got} == want
    assert {r.id: r.fp & (1 << 64) - 1 for r in got} == dict(zip(docs.doc_id, fps))


def one_of_each(ids, fps):
    """The least id of each component of rows, null for the least of all."""
    label = brute_components(range(len(ids)), fps)
    least = [min(i for i, x in zip(ids, label) if x == y) for y in set(label)]
    return [None if i == -(1 << 63) else i for i in least]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = [i if i is not None else -(1 << 63) for i, _ in rows]
    want = brute_components(ids, [brute_fingerprint(t) for _, t in rows])
    assert sorted((r.id, r.component_id) for r in near_duplicates(docs).collect()) == sorted(zip(ids, want))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=order) == sorted(one_of_each(ids, [brute_fingerprint(t) for _, t in rows]), key=order)
    assert near_duplicates(odd_docs(spark, [])).count() == 0 and drop_near_duplicates(odd_docs(spark, [])).count() == 0


def test_a_group_of_many_copies(spark):
    rows = [(i, "the very same text for all of them") for i in range(400)] + [(900, "quite another text that has other words")]
    got = {r.id: r.component_id for r in near_duplicates(plain_docs(spark, rows)).collect()}
    assert got == {i: 0 for i in range(400)} | {900: 900}


def test_one_row_of_each_component_stays_whatever_the_ids(spark, monkeypatch):
    a, b, c, d = ("first text that has its own words entirely", "second text about quite other matters here",
                  "third one with nothing in common at all", "fourth and last of these unrelated documents")
    rows = [(None, a), (None, b), (3, b), (None, None), (4, ""), (5, c), (6, c), (2, d), (5, d), (7, a), (9, c), (9, "a fifth text under an id met before")] + [(None, b)] * 5
    ids = [-(1 << 63) if i is None else i for i, _ in rows]
    label = brute_components(range(len(rows)), [brute_fingerprint(t) for _, t in rows])
    want = sorted(min((i, r[1] or "") for i, r, x in zip(ids, rows, label) if x == y) for y in set(label))
    for hot in (500, 2):
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        kept = drop_near_duplicates(plain_docs(spark, rows)).collect()
        assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in kept) == want
    assert len(want) == len(set(label)) == 6
