import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, vector array<long>, score int, cell int, block int, windows int"


def brute(rows, is_anchor, n_pos=5, n_neg=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score) over (id, label, vector) rows."""
    least = -(1 << 63)
    rows = [(least if i is None else i, label, v) for i, label, v in rows if label is not None and v is not None and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, done = [], set()
    for i, label, v in rows:
        if not is_anchor(i) or (i, label, tuple(v)) in done:
            continue
        done.add((i, label, tuple(v)))
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:n_pos]:
            near = [x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -high * s][:n_neg]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], SCHEMA).repartition(3)
    got = H.mine(df, F.col("vec_id") % every == 0, **options).collect()
    return sorted(tuple(-(1 << 63) if x is None and i in (0, 1, 3) else x for i, x in enumerate((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score))) for r in got)


def clustered(n, seed, spread=20):
    """Vectors around a few centres, some of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, 8))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.integers(-spread, spread + 1, 8) * (rng.random() < 0.8)
        rows.append((i, int(rng.integers(3)), v.tolist()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_triples_match_brute_force(spark, monkeypatch, seed):
    """Over several cells, blocks and trees."""
    monkeypatch.setattr(H, "LEAST_ROWS", 40)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 7)
    rows = clustered(300, seed)
    got = mined(spark, rows)
    assert len(got) > 100 and got == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 4]), (2, 2, [3, 4]), (3, None, [9, 9]), (4, 2, None), (5, 2, [1, None]), (6, 1, [0, 0]),
            (7, 2, []), (8, 2, [3, 3, 100]), (10, 2, [5, 0, 1]), (10, 2, [5, 0, 1]), (None, 1, [4, 3]), (None, 2, [3, 4]), (20, 3, [1, 1]), (30, 1, [-3, -4]),
            (11, 2, [4, 1]), (12, 1, [5, 1])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0 and i >= 0)
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [1]), (11, 1, [1])]) == []  # no row of another label
    assert mined(spark, [(11, 1, [1]), (12, 2, [1])]) == []  # no anchor


def test_other_windows_and_numbers(spark):
    rows = clustered(120, 4)
    assert mined(spark, rows, positives=2, negatives=7, low=50, high=120) == brute(rows, lambda i: i % 10 == 0, 2, 7, 50, 120)


def test_scores_beyond_exact_floats(spark):
    rows = [(i, i % 2, [(1 << 28) + i, (1 << 28) - 3 * i, i]) for i in range(0, 40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_bounds_spare_far_candidates():
    """Anchors of one tight cluster: all but the first rescore little of a cell that lies mostly elsewhere."""
    rng = np.random.default_rng(3)
    near = rng.integers(-3, 4, (200, 8)) + 300
    far = rng.integers(-3, 4, (3000, 8)) - 300
    x = np.concatenate([near, far])
    cell = H.Cell(pa.table({"id": np.arange(len(x)), "label": np.arange(len(x)) % 2, "vector": pa.array(list(x), pa.list_(pa.int64()))}))
    anchors = pa.table({"key": np.arange(50), "id": np.arange(50), "label": np.arange(50) % 2, "vector": pa.array(list(x[:50]), pa.list_(pa.int64())),
                        "windows": pa.array([[None]] * 50, pa.list_(pa.int64()))})
    found = cell.search(anchors, 5, 80, 100)
    assert len(found[0]) == 250
    assert cell.rescored < len(x) + 50 * 300


def test_tree_is_a_least_spanning_tree():
    a = np.array([[0, 0], [10, 0], [10, 1], [0, 1], [5, 0]])
    parent, length = H.spanning_tree(a)
    assert parent[0] == -1 and (parent[1:] >= 0).all()
    assert sorted(length[1:].round(6).tolist()) == [1.0, 1.0, 5.0, 5.0]
    seen, kept = [], []
    for node, above, _, own in H.walk(np.arange(100)[:, None]):
        assert above is None or above in seen
        seen.append(node)
        own[:] = np.zeros(1), np.zeros(1)
    assert sorted(seen) == list(range(100)) and not kept
