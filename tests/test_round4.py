"""Steps that are made once, blocks that grow with the rows, and trainers whose tasks don't grow in number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import balance as bal, knn as K, models as mdl
from riskloom.operators.features import DEFAULT_CHUNK_ROWS
from riskloom.plans import workflow as wf
from riskloom.sources.transactions import fixture_transactions

from .conftest import SF_SMALL


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(8).normal(size=(240, 3))
    return spark.createDataFrame([(f"r{i}", v.tolist(), float(i % 8 == 0)) for i, v in enumerate(x)], "id string, vec array<double>, label double").repartition(3).persist()


def test_rows_are_dealt_once_and_vectors_come_last(spark, rows):
    got = plan(K.knn(rows, rows, 3, "id", "id", "vec", block_rows=40))
    assert "Join" not in got and "cvec" not in got
    merge = [x for x in plan(K.knn(rows, rows, 3, "id", "id", "vec", with_vectors=True)).splitlines() if "FlatMapCoGroupsInArrow" in x]
    assert merge and not any("cvec" in x for x in merge)


def test_default_blocks_grow_with_the_rows(spark, rows, monkeypatch):
    """However many rows there are, a row is sent to about sqrt(BLOCK_PAIRS) blocks, and not to rows / 8192."""
    monkeypatch.setattr(K, "DEFAULT_BLOCK_ROWS", 5)
    monkeypatch.setattr(K, "BLOCK_PAIRS", 9)
    visits = K.visited_blocks(rows, rows, 3, "id", "id", "vec", block_rows=None).toPandas()
    assert len(visits) == 240 and visits.n_blocks.max() <= 8
    monkeypatch.setattr(K, "MAX_BLOCK_ROWS", 6)
    assert K.visited_blocks(rows, rows, 3, "id", "id", "vec", block_rows=None).toPandas().n_blocks.max() > 15


def test_repeated_candidate_ids_keep_their_vectors(spark):
    q = spark.createDataFrame([("q", [0.0])], "id string, vec array<double>")
    c = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("a", [2.0]), (None, [3.0]), ("b", [9.0])], "id string, vec array<double>")
    got = sorted((r["rank"], r.cid, r.dist, r.cvec) for r in K.knn(q, c, 4, "id", "id", "vec", with_vectors=True).collect())
    assert [(d, v) for _, _, d, v in got] == [(1.0, [1.0]), (1.0, [1.0]), (2.0, [2.0]), (3.0, [3.0])]


def test_rows_that_come_twice_have_whole_neighbours(spark, rows):
    """No row with the query's own id counts towards its bound."""
    got = K.knn(rows.limit(60).localCheckpoint(), rows.unionByName(rows), 5, "id", "id", "vec", block_rows=30).collect()
    x = {r.id: np.array(r.vec) for r in rows.collect()}
    found = {}
    for r in got:
        found.setdefault(r.qid, []).append(r.dist)
    assert len(found) == 60
    for q, dist in found.items():
        want = np.sort([np.sqrt(((x[q] - v) ** 2).sum()) for i, v in x.items() if i != q for _ in range(2)])[:5]
        assert sorted(dist) == pytest.approx(want)


@pytest.mark.parametrize("exclude", [True, False])
def test_bounds_leave_out_no_neighbour(exclude):
    rng = np.random.default_rng(9)
    c = 1e4 + rng.normal(size=(2500, 12)) * 1e-2
    q = c[:50]
    d2 = ((q[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    if exclude:
        d2[np.arange(50), np.arange(50)] = np.inf
    want = np.sort(d2, axis=1)[:, :6]
    for bound in (None, want[:, 5].copy(), np.where(np.arange(50) % 2, np.inf, 3 * want[:, 5])):
        row, col, dist = K.nearest_in_block(q, c, np.arange(50), np.arange(2500), 6, exclude, bound)
        assert len(row) == 300 and np.allclose(dist.reshape(50, 6) ** 2, want, rtol=1e-9)


def test_hybrid_and_adasyn_search_once(spark, rows):
    assert "FlatMapCoGroupsInArrow" not in plan(bal.hybrid(rows, "id", "vec", "label"))
    assert plan(bal.adasyn(rows, "id", "vec", "label")).count("FlatMapCoGroupsInArrow") == 1


def test_adasyn_searches_in_rounds(spark, rows, monkeypatch):
    def made():
        return sorted((r.id, r.label, r.synthetic, r.vec) for r in bal.adasyn(rows, "id", "vec", "label").collect())

    want, searched, search = made(), [], bal.knn
    monkeypatch.setattr(bal, "knn", lambda q, *a, **k: searched.append(q.count()) or search(q, *a, **k))
    monkeypatch.setattr(bal, "ROUND_ROWS", 12)
    up = bal.adasyn(rows, "id", "vec", "label")
    assert len(searched) == 4 and sum(searched[:3]) == searched[3] == 30  # three rounds, and the neighbours to mix with
    assert sorted((r.id, r.label, r.synthetic, r.vec) for r in up.collect()) == want


@pytest.mark.parametrize("n, cores, want", [(0, 12, 1), (800_000, 12, 8), (8_000_000, 12, 24), (48_000_000, 12, 24), (480_000_000, 12, 240)])
def test_training_partitions_are_bounded(n, cores, want):
    """Two partitions a core, until they would hold over 2,000,000 rows."""
    assert mdl.training_partitions(n, cores) == want


def test_trainers_keep_their_columns_only(rows):
    wide = mdl.from_array(rows, "vec").withColumn("weight", F.lit(1.0))
    with mdl.kept_for_training(wide) as kept:
        assert sorted(kept.columns) == ["features", "label", "weight"] and kept.count() == 240


def test_the_design_reads_kept_transactions(spark, monkeypatch):
    seen, txn = [], fixture_transactions(spark, SF_SMALL)
    fit = wf.feat.fit_global_stats
    monkeypatch.setattr(wf.feat, "fit_global_stats", lambda df, **k: seen.append(plan(df)) or fit(df, **k))
    wf.build_design(txn, fit="all")
    assert "InMemoryTableScan" in seen[0] and "Join" not in seen[0].partition("InMemoryRelation")[0]
    assert not txn.storageLevel.useMemory and not txn.storageLevel.useDisk


def test_a_customer_of_half_a_million_rows_is_one_part_at_most():
    """A task holds a part: its rows don't grow with the largest customer."""
    assert DEFAULT_CHUNK_ROWS <= 500_000
