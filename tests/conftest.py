import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trustframe.session import build_session

    return build_session("local[8]", "trustframe-tests")


@pytest.fixture(scope="session")
def sf():
    return SF
