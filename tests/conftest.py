import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from windowlab.session import build_session

    s = build_session("tests", master="local[8]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.windowlab.fixtures.spread", "8")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
