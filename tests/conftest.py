import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hearth.session import get_spark
    s = get_spark("local[4]", app="hearth-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearth-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    from hearth.plans.catalog import Catalog
    return Catalog.of(spark, SF_SMALL)
