import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lakesonar.session import get_spark
    s = get_spark("local[4]", 4)
    # tests run without a cluster-provided shared folder: set our own
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="lakesonar-test-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


@pytest.fixture(scope="session")
def nulls_nan(spark):
    rows = [(1, 1, 1.0, "a"), (2, None, float("nan"), None), (3, 3, float("inf"), "b"),
            (4, 4, -0.0, "a"), (5, None, 0.0, ""), (6, 6, None, "c")]
    return spark.createDataFrame(rows, "id long, i int, d double, s string")
