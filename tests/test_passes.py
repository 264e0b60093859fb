"""Passes of iterative trainers: what a pass reads, equal sums, Spark's network from packed blocks."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from riskloom.operators import many_models as mm, models as mdl, network as net, sigmoid_network as sn


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 4))
    y = (x[:, 0] * x[:, 1] + 0.5 * rng.normal(size=1000) > 0.3).astype(float)
    df = spark.createDataFrame([(str(i), a.tolist(), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))],
                               "row_id string, features_arr array<double>, label double, fold int")
    return mdl.from_array(df.repartition(3, "row_id"), "features_arr").persist()


def test_a_mini_batch_reads_its_own_files_only(spark, rows, monkeypatch):
    monkeypatch.setattr(net, "BLOCK_ROWS", 50)
    blocks = net.packed_rows(rows, "row_id", "features_arr", "label", None, "test-batches", 4)
    assert blocks.where("batch <> pmod(block, 4)").count() == 0 and blocks.agg(F.sum("n")).first()[0] == 1000
    for b in range(4):
        read = blocks.where(F.col("batch") == b).select(F.input_file_name().alias("f")).distinct().collect()
        assert read and all(f"/batch={b}/" in r.f for r in read)
    assert sorted(blocks.inputFiles()) == sorted({f for f in blocks.inputFiles() if "/batch=" in f})


@pytest.mark.parametrize("block_size", [7, 256, 5000])
def test_the_packed_network_is_sparks(spark, rows, block_size):
    mlp = MultilayerPerceptronClassifier(layers=[4, 6, 3, 2], maxIter=6, blockSize=block_size, seed=5)
    want, got = mlp.fit(rows), sn.fit(mlp, rows)
    assert got.weights.toArray() == pytest.approx(want.weights.toArray(), abs=1e-9)
    assert type(got) is type(want)
    a, b = ({r.row_id: r.proba for r in mdl.score(m, rows, "nn").collect()} for m in (want, got))
    assert a == pytest.approx(b, abs=1e-9)


def test_many_rows_are_trained_on_packed_blocks(spark, rows, monkeypatch):
    want = mdl.neural_network(rows, 4, hidden=(5,), max_iter=4).weights.toArray()
    monkeypatch.setattr(mdl, "ROWS_PER_PARTITION", 500)
    packed = []
    monkeypatch.setattr(sn, "stacked", lambda *a, f=sn.stacked: packed.append(a) or f(*a))
    got = mdl.neural_network(rows.repartition(2, "row_id"), 4, hidden=(5,), max_iter=4).weights.toArray()
    assert packed and got == pytest.approx(want, abs=0.05)  # other stacks: the mean of means differs


def test_the_descent_ends_at_a_least_point():
    centre = np.array([1.0, -2.0, 3.0])
    calls = []

    def bowl(x):
        calls.append(x)
        return float(((x - centre) ** 2 * [1, 10, 100]).sum()), 2 * (x - centre) * [1, 10, 100]

    assert sn.descend(bowl, np.zeros(3), 100, 1e-12) == pytest.approx(centre, abs=1e-4)
    assert len(calls) < 60
    assert (sn.descend(bowl, centre, 100, 1e-12) == centre).all()


def test_blocks_lie_in_small_files_and_pieces_add_up(spark, rows, monkeypatch):
    monkeypatch.setattr(mm, "BLOCK_ROWS", 10)
    monkeypatch.setattr(mm, "PIECE", 3)
    blocks = mm.Blocks(rows, weight=None)
    per_file = blocks.rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file <= mm.FILE_BLOCKS
    got = blocks.sums(lambda x, y, w, fold: np.concatenate([x.sum(0), [y.sum(), w.sum(), (fold == 1).sum()]]), 7)
    want = rows.agg(*[F.sum(F.col("features_arr")[i]) for i in range(4)], F.sum("label"), F.count("label"), F.count_if(F.col("fold") == 1)).first()
    blocks.close()
    assert got == pytest.approx(list(want))


def test_a_pass_is_the_sum_over_the_rows_that_a_model_sees(spark, rows, monkeypatch):
    monkeypatch.setattr(mm, "SLICE", 64)
    blocks = mm.Blocks(rows, weight=None)
    tasks = [mm.Task(0.1, 0.0, f) for f in (None, 2, 0, 9)]
    got, _ = mm.fit_many(blocks, tasks, max_iter=40, tol=1e-12)
    blocks.close()
    data = rows.select("features_arr", "label", "fold").toPandas()
    for t, c in zip(tasks, got):
        seen = data[data.fold != t.leave_out] if t.leave_out is not None else data
        x = np.column_stack([np.vstack(seen.features_arr), np.ones(len(seen))])
        slope = x.T @ (1 / (1 + np.exp(-(x @ c))) - seen.label) / len(seen) + 0.1 * np.append(c[:-1], 0.0)
        assert np.abs(slope).max() < 1e-4


def test_a_pass_reads_a_few_blocks_at_a_time(spark, rows, monkeypatch, tmp_path):
    """No batch grows with a partition, and the session's own setting is as before."""
    monkeypatch.setattr(mm, "BLOCK_ROWS", 10)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = mm.Blocks(rows.withColumn("weight", F.lit(1.0)).coalesce(1))
    frame = type(blocks.rows)
    sizes, real = str(tmp_path / "sizes"), frame.mapInArrow

    def seen(self, fn, *a, **k):
        def run(batches):
            def noted():
                for batch in batches:
                    with open(sizes, "a") as f:
                        f.write(f"{batch.num_rows}\n")
                    yield batch
            yield from fn(noted())
        return real(self, run, *a, **k)

    try:
        monkeypatch.setattr(frame, "mapInArrow", seen)
        total = blocks.sums(lambda x, y, w, fold: np.append(x.sum(0), len(y)), 5)
    finally:
        blocks.close()
    with open(sizes) as f:
        got = [int(n) for n in f]
    assert sum(got) == 100 and max(got) <= 2 and total[4] == 1000
    assert spark.conf.get(key) == before
