import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from canopy.session import get_spark, shared_dir
    s = get_spark("canopy-tests", master="local[8]", shuffle_partitions=8)
    shared_dir(s)  # tests run with a private checkpoint folder when none is configured
    yield s


@pytest.fixture(scope="session")
def duck():
    from oracle import duck as make
    return make(SF01)
