import zlib

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import quality
from riskloom.llm.queries import Q

from ..conftest import SF_MID
from .data import odd_docs, read


def test_held_out_accuracy_and_contract(spark):
    labels = read(SF_MID, "labels").set_index("doc_id")
    got = Q["op9_quality_classifier"](spark, SF_MID).toPandas()
    assert sorted(got.doc_id) == sorted(read(SF_MID, "documents").doc_id)
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    own = got[got.held_out & got.doc_id.isin(labels.index)]
    truth = labels.quality.loc[own.doc_id].to_numpy()
    assert (own.predicted.to_numpy() == truth).mean() > 0.95
    assert own.predicted.to_numpy()[truth == 1].mean() > 0.97 and own.predicted.to_numpy()[truth == 0].mean() < 0.25


def tables(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet")


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    docs, labels = tables(spark)
    a = quality.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.fit(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), flipped)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all() and a.prior == b.prior
    assert len(a.labels) <= quality.SAMPLE_ROWS


def test_votes_match_brute_force(spark, monkeypatch):
    docs, labels = tables(spark)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 100)
    votes = quality.fit(docs, labels)
    assert len(votes.labels) == 100 and votes.labels.sum() <= 64
    rows = quality.score(docs, votes).limit(40).collect()
    for r in rows:
        counts = quality.term_counts(__import__("pyarrow").array([r.text]))[0]
        z = (counts * votes.idf) @ votes.axes
        c = votes.vectors @ z / np.linalg.norm(z)
        near = np.argsort(-c, kind="stable")[:quality.NEIGHBOURS]
        w = np.maximum(c[near], 0)
        assert abs((w * votes.labels[near]).sum() / w.sum() - r.score) < 0.08  # ties may swap a neighbour


def test_document_frequency_covers_all_rows(spark):
    texts = ["aaa bbb", "aaa aaa", "", None, "zz"]
    n, frequency = quality.document_frequency(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    counts = quality.term_counts(__import__("pyarrow").array(texts))
    assert n == 5 and frequency.tolist() == (counts > 0).sum(0).tolist()


def test_odd_rows(spark):
    docs, labels = tables(spark)
    votes = quality.fit(docs, labels)
    odd = odd_docs(spark)
    got = quality.score(odd, votes).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {votes.prior}
    assert quality.score(odd_docs(spark, []), votes).count() == 0
    nothing = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}
    odd_labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None), (5, 0), (3, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, quality.fit(odd, odd_labels)).collect())
    assert quality.score(odd, quality.fit(odd_docs(spark, []), odd_labels)).count() == odd.count()


def test_equal_texts_score_alike(spark):
    docs, labels = tables(spark)
    got = quality.score(docs, quality.fit(docs, labels)).toPandas()
    assert (got.groupby("text").score.agg(lambda s: s.max() - s.min()) < 0.08).all()


def test_equal_texts_score_exactly_alike_in_every_block():
    docs, labels = read(SF_MID, "documents"), read(SF_MID, "labels").set_index("doc_id").quality
    counts = quality.term_counts(__import__("pyarrow").array(docs.text.tolist()))
    known = docs.doc_id.isin(labels.index).to_numpy()
    learned, truth = counts[known][:300], labels.loc[docs.doc_id[known][:300]].to_numpy()
    # each labelled vector three times, under both labels: ties at the last neighbour are the rule
    votes = quality.Votes(np.repeat(learned, 3, 0), np.stack([truth, 1 - truth, truth], 1).ravel(), len(counts), (counts > 0).sum(0), 0.5)
    counts = counts[:300]
    whole = votes(counts)
    for size in (1, 7, 100):
        assert np.concatenate([votes(counts[a:a + size]) for a in range(0, len(counts), size)]).tolist() == whole.tolist()
    turn = np.random.default_rng(3).permutation(len(counts))
    assert votes(counts[turn]).tolist() == whole[turn].tolist()
    # labelled copies of a text among others: the 15 of least id vote on it
    mixed = learned.copy()
    mixed[np.random.default_rng(4).permutation(300)[:40]] = learned[0]
    voters = np.flatnonzero((mixed == learned[0]).all(1))[:quality.NEIGHBOURS]
    votes = quality.Votes(mixed, np.isin(np.arange(300), voters).astype(np.int64), len(docs), (mixed > 0).sum(0), 0.5)
    assert votes(learned[:1]).tolist() == [1.0]


def test_ids_with_two_texts_learn_the_same_under_any_partitioning(spark):
    rows = [(i, f"{'good plain words of prose' if i % 2 else 'zzz ### 123 qqq'} number {i} version {v} " * (v + 1)) for i in range(40) for v in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = [quality.fit(docs.repartition(n), labels) for n in (1, 2, 3, 5, 8)]
    assert len(models[0].labels) > 15
    for m in models[1:]:
        assert (m.vectors == models[0].vectors).all() and (m.labels == models[0].labels).all() and (m.idf == models[0].idf).all()
