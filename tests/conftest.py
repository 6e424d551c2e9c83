import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from contrail.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4, app_name="contrail-tests")
    # tests run without a cluster folder: a scratch checkpoint location
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="contrail-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def smoke_dir():
    return SMOKE


@pytest.fixture(scope="session")
def L(spark, smoke_dir):
    from contrail.plans.layers import Loyalty
    return Loyalty(spark, smoke_dir)
