import random

from pyspark.sql import functions as F

from riskloom.llm import _tables
from riskloom.llm._tables import id_batches, lookup

from .data import plain_docs


def test_lookup_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(_tables, "HOT_ROWS", 10)
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, rnd.choice([1, 1, 1, 2, 3, 4 + i])) for i in range(900)], "i long, k long").repartition(5)
    table = spark.createDataFrame([(k, k * 10, None) for k in [1, 2, *range(4, 600)]], "k long, v long, w string")
    got = lookup(rows, table, "k", rows.groupBy("k").agg(F.count("*").alias("n")))
    assert sorted(map(tuple, got.select("i", "k", "v", "w").collect())) == sorted(map(tuple, rows.join(table, "k").select("i", "k", "v", "w").collect()))
    joined = rows.join(F.broadcast(spark.createDataFrame([(1,)], "k long").withColumn("hot", F.lit(True))), "k", "left")
    assert joined.count() == 900
    assert lookup(rows.limit(0), table, "k", rows.limit(0).groupBy("k").agg(F.count("*").alias("n"))).count() == 0


def test_batches_follow_the_ids(spark):
    docs = plain_docs(spark, [(i // 3 if i % 11 else None, str(i)) for i in range(300)])
    got, lower = id_batches(docs, "doc_id", 25, "batch")
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "batch"] and len(rows) == 300
    assert {r.batch for r in rows if r.doc_id is None} == {min(r.batch for r in rows)}
    by_id = sorted((r.doc_id, r.batch) for r in rows if r.doc_id is not None)
    assert [b for _, b in by_id] == sorted(b for _, b in by_id) and len({b for _, b in by_id}) > 5
    assert len(dict(by_id)) == len(set(by_id))  # equal ids share a batch
    one, lower = id_batches(docs, "doc_id", 1000, "batch")
    assert {r.batch for r in one.collect()} == {0} and len(lower) == 1
