import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from turnstile.session import get_spark
    ck = tempfile.mkdtemp(prefix="turnstile-test-ckpt-", dir="/tmp")
    wh = tempfile.mkdtemp(prefix="turnstile-test-warehouse-", dir="/tmp")
    s = get_spark(master="local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": ck, "spark.sql.shuffle.partitions": "4",
                         "spark.sql.warehouse.dir": wh})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF001
