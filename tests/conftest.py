import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sqltally.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, app="sqltally-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
