"""A transaction stream scored micro-batch by micro-batch equals the batch result."""

import os
import tempfile

from riskloom.functions.expressions import round_doubles
from riskloom.operators import features as feat
from riskloom.sources.transactions import fixture_transactions
from riskloom.streaming import transaction_stream, apply_per_batch
from tools.oracle_check import frame_key

from .conftest import SF_SMALL


def test_stream_rows_match_batch(spark):
    root = tempfile.mkdtemp(prefix="riskloom-stream-")
    src, out, ck = (os.path.join(root, n) for n in ("src", "out", "ck"))
    txn = fixture_transactions(spark, SF_SMALL)
    txn.repartition(4).write.parquet(src)
    stats = feat.fit_global_stats(txn)

    def fn(b):
        return feat.stat_features(feat.row_features(b), stats)

    q = apply_per_batch(transaction_stream(spark, src, max_files_per_trigger=1), fn, out, ck,
                        once=True)
    q.awaitTermination(120)
    got = round_doubles(spark.read.parquet(out).drop("batch_id")).toPandas()
    want = round_doubles(fn(spark.read.parquet(src))).toPandas()
    assert len(got) == txn.count()
    assert frame_key(got[sorted(got.columns)]) == frame_key(want[sorted(want.columns)])
