import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from babelgrid.session import build_session, drop_scratch
    s = build_session("local[4]", 8)
    yield s
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL
