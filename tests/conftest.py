import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from riskloom.session import DEFAULT_CONF, ensure_checkpoint_dir
    b = SparkSession.builder.master("local[4]").appName("riskloom-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8")
    b = b.config("spark.local.dir", tempfile.mkdtemp(prefix="riskloom-test-local-"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tools.oracle_check import duck as make
    return make(SF_SMALL)


@pytest.fixture(scope="module", autouse=True)
def transactions_kept_by_a_module_go_with_it():
    """Spark finds kept tables by their plan, so another module's test would see them."""
    yield
    from pyspark.sql import SparkSession
    from riskloom.sources.transactions import fixture_transactions
    session = SparkSession.getActiveSession()
    if session is not None:
        fixture_transactions(session, SF_SMALL).unpersist()
