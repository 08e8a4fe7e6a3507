import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from postgrain.session import build_session

    return build_session(4, spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__default__parallelism="4")


@pytest.fixture(scope="session")
def data():
    return DATA
