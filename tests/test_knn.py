import numpy as np
import pytest

from riskloom.operators.knn import knn, visited_blocks


def clustered(n, seed=0, d=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 50, (12, d))
    return np.round(centre[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, d)), 1)


def frame(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, v array<double>").repartition(3)


@pytest.mark.parametrize("block_rows", [4096, 60, 9])
@pytest.mark.parametrize("k", [1, 5])
def test_equal_to_brute_force(spark, block_rows, k):
    x = clustered(400)
    x[30:50] = x[30]  # repeated points: ties go by id
    q = x[:120]
    got = {}
    for r in knn(frame(spark, q, "q"), frame(spark, x, "c"), k, "q", "c", "v", block_rows=block_rows).collect():
        got.setdefault(int(r.qid), []).append((r.rank, r.cid, r.dist))
    for i in range(len(q)):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        want = sorted((d[j], str(j)) for j in range(len(x)) if j != i)[:k]
        assert [(c, pytest.approx(dist)) for _, c, dist in sorted(got[i])] == [(c, dist) for dist, c in want]


def test_queries_visit_few_blocks_of_clustered_data(spark):
    x = clustered(1500, 1)
    visits = visited_blocks(frame(spark, x[:200], "q"), frame(spark, x, "c"), 5, "q", "c", "v", block_rows=30).toPandas()
    assert len(visits) == 200 and visits.n_blocks.mean() < 0.35 * 1500 / 30


def test_null_vectors_and_empty_sides(spark):
    some = spark.createDataFrame([(1, [0.0]), (2, None), (3, [1.0])], "i long, v array<double>")
    rows = knn(some, some, 5, "i", "i", "v").collect()
    assert sorted((r.qid, r.cid) for r in rows) == [("1", "3"), ("3", "1")]
    assert knn(some, some.limit(0), 5, "i", "i", "v").count() == 0 and knn(some.limit(0), some, 5, "i", "i", "v").count() == 0
    vectors = knn(some, some, 1, "i", "i", "v", with_vectors=True).collect()
    assert {r.qid: r.cvec for r in vectors} == {"1": [1.0], "3": [0.0]}


def test_yielded_batches_are_bounded():
    """Unclustered rows of 47 dimensions, of which each query visits nearly all of 252 cells."""
    import pyarrow as pa
    from riskloom.operators import knn as K
    rng = np.random.default_rng(2)
    cells = K._Cells(rng.normal(size=(4096, 47)), [], np.full(252, 9.0), np.full(252, 4096), 4096)
    x = rng.normal(size=(2000, 47))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(2000)]), pa.array(list(x), pa.list_(pa.float64()))], ["qid", "vec"])
    sizes = [b.num_rows for b in K._visits(cells, 5, True)([batch])]
    assert sum(sizes) > 200_000 and max(sizes) <= K.VISIT_ROWS


def test_the_filter_keeps_every_neighbour():
    """Far from the origin, and nearly equal distances: single precision alone would mix them up."""
    from riskloom.operators import knn as K
    rng = np.random.default_rng(7)
    c = 1e4 + rng.normal(size=(3000, 20)) * 1e-2
    q = c[:40] + rng.normal(size=(40, 20)) * 1e-3
    row, col, dist = K.nearest_in_block(q, c, np.arange(40), np.arange(3000), 7, True)
    for i in range(40):
        d = np.sqrt(((c - q[i]) ** 2).sum(1))
        d[i] = np.inf
        assert sorted(col[row == i]) == sorted(np.argsort(d, kind="stable")[:7])
